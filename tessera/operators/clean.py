"""Cleaning operators (P4-P9): type conversion, value replacement, missing-value fills.

Fill statistics for all requested columns come from one aggregate (mean) and one
distinct-value pass (median, mode) - never one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import is_numeric_type, numeric_cols, require_columns
from .binning import distinct_counts, exact_quantiles, long_values

_DTYPES = {"int": "long", "float": "double", "str": "string", "bool": "boolean"}


def convert_type(df: DataFrame, column: str, dtype: str, strict: bool = True) -> DataFrame:
    """Cast ``column`` to int/float/str/bool. float->int truncates toward zero; a
    value that cannot be converted raises ``TypeError`` naming column and type (checked
    with one aggregate); nulls stay null."""
    require_columns(df, [column])
    if dtype not in _DTYPES:
        raise ValueError(f"unsupported type: {dtype}")
    target = _DTYPES[dtype]
    src = F.col(column)
    if dtype == "bool" and isinstance(df.schema[column].dataType, T.StringType):
        src = F.lower(F.trim(src))
    casted = src.try_cast(target)
    if strict:
        bad = df.agg(F.count_if(F.col(column).isNotNull() & casted.isNull())).first()[0]
        if bad:
            raise TypeError(f"column '{column}' cannot be converted to {dtype}")
    return df.withColumn(column, casted)


def to_datetime(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    """P5: parse to timestamp; unparsable values become null."""
    c = F.col(column).cast("string")
    parsed = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return df.withColumn(column, parsed)


def replace_value(df: DataFrame, column: str, old, new):
    """Replace ``old`` by ``new`` in ``column``; returns (df, n_replaced). Numeric
    columns parse ``old`` as float. With no match the frame is returned unchanged. A
    replacement that does not fit the column type turns the column into strings."""
    require_columns(df, [column])
    dt = df.schema[column].dataType
    numeric = is_numeric_type(dt)
    old_v = float(old) if numeric else old
    match = F.col(column) == F.lit(old_v)
    n = df.agg(F.count_if(match)).first()[0]
    if not n:
        return df, 0
    if numeric:
        try:
            new_v = float(new)
            return df.withColumn(column, F.when(match, F.lit(new_v)).otherwise(F.col(column).cast("double"))), int(n)
        except (TypeError, ValueError):
            return df.withColumn(column, F.when(match, F.lit(str(new))).otherwise(F.col(column).cast("string"))), int(n)
    return df.withColumn(column, F.when(match, F.lit(new)).otherwise(F.col(column))), int(n)


def _fill_stats(df: DataFrame, cols: Sequence[str], need: set[str]) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {c: {} for c in cols}
    if not cols:
        return out
    long = long_values(df, cols)
    if "mean" in need:
        for r in long.groupBy("feature").agg(F.avg("value").alias("m")).collect():
            out[r["feature"]]["mean"] = r["m"]
    if need & {"median", "mode"}:
        dist = distinct_counts(long)
        if "median" in need:
            for k, (vals, _n) in exact_quantiles(dist, ["feature"], [0.5]).items():
                out[k[0]]["median"] = vals[0]
        if "mode" in need:
            for r in dist.groupBy("feature").agg(
                    F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")).collect():
                out[r["feature"]]["mode"] = r["mode"]
    return out


def fill_missing(df: DataFrame, strategy: str = "mean", columns: Sequence[str] | None = None,
                 fill_value=None) -> DataFrame:
    """One strategy over numeric columns: mean | median | mode (smallest mode) | drop |
    fill_value. Non-numeric names in ``columns`` are ignored."""
    nums = numeric_cols(df)
    cols = [c for c in (columns if columns is not None else nums) if c in nums]
    if strategy == "drop":
        return df.dropna(how="any", subset=cols) if cols else df
    if strategy == "fill_value":
        if fill_value is None:
            raise ValueError("fill_value strategy needs a value")
        return df.fillna({c: fill_value for c in cols})
    if strategy not in ("mean", "median", "mode"):
        raise ValueError(f"unknown strategy: {strategy}")
    stats = _fill_stats(df, cols, {strategy})
    vals = {c: stats[c][strategy] for c in cols if stats[c].get(strategy) is not None}
    return _fill(df, vals)


def _fill(df: DataFrame, vals: dict) -> DataFrame:
    if not vals:
        return df
    exprs = []
    for f in df.schema.fields:
        if f.name in vals:
            v = vals[f.name]
            c = F.col(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                c = F.when(F.isnan(c), None).otherwise(c)
            if isinstance(f.dataType, T.StringType):
                exprs.append(F.coalesce(c, F.lit(str(v))).alias(f.name))
            elif is_numeric_type(f.dataType) and not isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                # an integral column filled with a fractional mean becomes double, as in pandas
                exprs.append(F.coalesce(c.cast("double"), F.lit(float(v))).alias(f.name))
            else:
                exprs.append(F.coalesce(c, F.lit(v)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def fill_missing_per_column(df: DataFrame, strategies: dict[str, dict]) -> DataFrame:
    """``{col: {"strategy": ..., "fill_value": ...}}`` applied in order; a ``drop`` step
    changes the rows later statistics see. Statistics of consecutive non-drop steps are
    computed together. mean/median on non-numeric columns are skipped; unknown columns
    are skipped."""
    pending: list[tuple[str, str, object]] = []
    out = df

    def flush(frame):
        if not pending:
            return frame
        need = {s for _, s, _ in pending if s in ("mean", "median", "mode")}
        stat_cols = [c for c, s, _ in pending if s in ("mean", "median", "mode")
                     and is_numeric_type(frame.schema[c].dataType)]
        stats = _fill_stats(frame, stat_cols, need)
        vals = {}
        for c, s, fv in pending:
            if s == "fill_value":
                if fv is None:
                    raise ValueError(f"fill_value missing for column '{c}'")
                vals[c] = fv
            elif s == "mode" and not is_numeric_type(frame.schema[c].dataType):
                m = (frame.where(F.col(c).isNotNull()).groupBy(c).count()
                     .agg(F.min_by(c, F.struct(-F.col("count"), F.col(c)))).first()[0])
                if m is not None:
                    vals[c] = m
            elif c in stats and stats[c].get(s) is not None:
                vals[c] = stats[c][s]
        pending.clear()
        return _fill(frame, vals)

    for col, spec in strategies.items():
        if col not in out.columns:
            continue
        strat = spec.get("strategy")
        if strat == "drop":
            out = flush(out)
            out = out.dropna(subset=[col])
        elif strat in ("mean", "median") and not is_numeric_type(out.schema[col].dataType):
            continue
        elif strat in ("mean", "median", "mode", "fill_value"):
            pending.append((col, strat, spec.get("fill_value")))
        else:
            raise ValueError(f"unknown strategy for '{col}': {strat}")
    return flush(out)


def dropna_guard(df: DataFrame, cols: Sequence[str], min_rows: int = 10) -> DataFrame:
    """Select + drop rows with any null; fewer than ``min_rows`` remaining is an error."""
    require_columns(df, cols)
    out = df.select(*cols).dropna(how="any")
    n = out.limit(min_rows).count()
    if n < min_rows:
        raise ValueError(f"only {n} complete rows; at least {min_rows} are needed")
    return out
