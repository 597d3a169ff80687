"""Sinks (S8, S9, S10, S17): CSV with optional BOM, JSON Lines, data dictionary, and
model packages. All writes go through Spark writers (parallel part files)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, bom: bool = True, single_file: bool = False, mode: str = "overwrite") -> None:
    """Header CSV, UTF-8; ``bom`` prefixes U+FEFF to the first header name (Spark
    writes no BOM itself). ``single_file`` coalesces to one part - for small results."""
    out = df
    if bom and df.columns:
        out = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    if single_file:
        out = out.coalesce(1)
    out.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Record-oriented JSON Lines, non-ASCII kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {column: description} -> (column, description) rows."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("column", "description"))


def upsert_dictionary(current: DataFrame, new: DataFrame) -> DataFrame:
    """S10 import: new descriptions win, others kept (full outer join + coalesce)."""
    return (current.alias("c").join(new.alias("n"), "column", "full_outer")
            .select("column", F.coalesce(F.col("n.description"), F.col("c.description")).alias("description")))


def dictionary_json(dictionary: DataFrame) -> DataFrame:
    """S10 export: one JSON object (one row; the dictionary has one entry per column)."""
    return dictionary.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "description")))))
                          .alias("json"))


def keep_known_columns(dictionary: DataFrame, table: DataFrame) -> DataFrame:
    """dictionary entries whose key is a real column and whose text is not blank."""
    cols = table.sparkSession.createDataFrame([(c,) for c in table.columns], "column string")
    return (dictionary.where(F.length(F.trim("description")) > 0).join(cols, "column", "left_semi"))


def save_model_package(model, path: str, metadata: dict) -> None:
    """PipelineModel directory + metadata JSON (features, metrics, task, time)."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    meta = {k: v for k, v in metadata.items() if isinstance(v, (int, float, str, bool, list, dict, type(None)))}
    spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "metadata string").select(
        "metadata", F.current_timestamp().alias("exported_at")).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model_package(path: str):
    from pyspark.ml import PipelineModel
    spark = SparkSession.getActiveSession()
    model = PipelineModel.load(f"{path}/model")
    meta = spark.read.json(f"{path}/meta").first()
    return model, json.loads(meta["metadata"]), meta["exported_at"]
