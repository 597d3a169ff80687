"""Column-expression helpers shared by all operators (JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Threshold ladders that must equal the reference's cut points.
# Labels are English renderings of the reference's labels.
# ---------------------------------------------------------------------------
PSI_LADDER = [(0.1, "stable"), (0.25, "slight shift")]
PSI_ELSE = "major shift"
IV_LADDER = [(0.02, "not predictive"), (0.1, "weak"), (0.3, "medium"), (0.5, "strong")]
IV_ELSE = "very strong (check)"
CRAMER_LADDER = [(0.1, "negligible"), (0.3, "weak"), (0.5, "moderate")]
CRAMER_ELSE = "strong"
ETA_LADDER = [(0.01, "negligible"), (0.06, "small"), (0.14, "medium")]
ETA_ELSE = "large"
CORR_LADDER = [(0.1, "none"), (0.3, "weak"), (0.5, "moderate"), (0.7, "strong")]
CORR_ELSE = "very strong"


def ladder(value: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """``CASE WHEN v < t1 THEN l1 WHEN v < t2 ... ELSE otherwise END`` (null stays null)."""
    expr = None
    for thr, label in steps:
        expr = F.when(value < F.lit(thr), F.lit(label)) if expr is None else expr.when(value < F.lit(thr), F.lit(label))
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(otherwise)))


def ladder_sql(expr: str, steps: Sequence[tuple[float, str]], otherwise: str) -> str:
    """Same ladder as SQL text (used by the DuckDB oracle strings)."""
    parts = " ".join(f"WHEN {expr} < {thr} THEN '{label}'" for thr, label in steps)
    return f"CASE WHEN {expr} IS NULL THEN NULL {parts} ELSE '{otherwise}' END"


def safe_div(a: Column, b: Column) -> Column:
    """Division that yields null on a zero divisor under ANSI mode."""
    return F.try_divide(a, b)


def col_of(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType) and not isinstance(dt, T.BooleanType)


def numeric_cols(df: DataFrame) -> list[str]:
    """Numeric columns (bool excluded, as in the reference's dtype selection)."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def categorical_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def require_columns(df: DataFrame, cols: Iterable[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"column(s) not found: {', '.join(missing)}")


def nan_to_null(c: str | Column) -> Column:
    """pandas treats NaN as missing; Spark does not. Normalise on entry."""
    c = col_of(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()


def round6(c: Column) -> Column:
    return F.round(c, 6)


def count_edges(x: Column, edges: Sequence[float], strict: bool = True) -> Column:
    """Number of edges e with e < x (``strict``) or e <= x, as a binary search written
    out as nested CASE expressions: log2(edges) comparisons a row, compiled by codegen (a
    lambda over an array literal would be evaluated interpreted). A null x counts 0."""
    edges = sorted(float(e) for e in edges)

    def search(lo: int, hi: int) -> Column:
        # the count lies in lo..hi
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        e = F.lit(edges[mid])
        return F.when((e < x) if strict else (e <= x), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(edges))


def count_edges_by_key(key: Column, x: Column, edges_by_key: dict, strict: bool = True) -> Column:
    """``count_edges`` with a different edge list per key value (CASE over the keys);
    null for a key without edges."""
    expr = None
    for k, es in edges_by_key.items():
        c = count_edges(x, es, strict)
        expr = F.when(key == F.lit(k), c) if expr is None else expr.when(key == F.lit(k), c)
    return expr if expr is not None else F.lit(None).cast("int")


def sort_small(df: DataFrame, *cols) -> DataFrame:
    """Order a result that is bin-sized by construction (one row per feature, decile,
    class ...) inside a single partition: no range-sampling job, no exchange. Never use
    it on data that grows with the input."""
    return df.coalesce(1).orderBy(*cols)
