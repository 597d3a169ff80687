"""Query registry shared by the plan modules."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def qs_sql(n_bins: int) -> str:
    """The quantile list numpy's linspace gives, as DuckDB doubles."""
    return "[" + ", ".join(f"{repr(float(q))}::DOUBLE" for q in np.linspace(0, 1, n_bins + 1)) + "]"
