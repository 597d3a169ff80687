"""Operators for building training corpora, each a DataFrame -> DataFrame Spark job."""
