"""WOE / IV and PSI - the scorecard core.

All features are handled by one job: the input is scanned once into a distinct
(feature, value) table with counts and event sums (partial aggregation before the
shuffle), bin edges are computed from that table, and the WOE / PSI arithmetic runs on
bin-sized aggregates. No per-feature passes, no collect of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import (IV_ELSE, count_edges_by_key, sort_small, IV_LADDER, PSI_ELSE, PSI_LADDER, is_numeric_type, ladder,
                               numeric_cols, require_columns)
from .binning import equal_width_edges, persist, quantile_edges_from_distinct
from .order import dedupe_edges, ordered_prefix


WOE_SCHEMA = ("feature string, bin_id int, lower double, upper double, category string, count long, "
              "events long, non_events long, event_rate double, woe double, iv_component double")


def _bin_by_edges(value, feature, edges: dict, include_lowest: bool):
    """1-based right-closed bin of value over its feature's edges (pandas cut/qcut):
    count(edges < value); with ``include_lowest`` the first edge itself is bin 1; outside
    the edges -> null."""
    cnt = count_edges_by_key(feature, value, edges)
    k = count_edges_by_key(feature, F.lit(float("inf")), edges)  # number of edges
    first = None
    for f, es in edges.items():
        first = (F.when(feature == F.lit(f), F.lit(float(es[0]))) if first is None
                 else first.when(feature == F.lit(f), F.lit(float(es[0]))))
    if include_lowest and first is not None:
        cnt = F.when(value == first, F.lit(1)).otherwise(cnt)
    return F.when(value.isNull() | cnt.isNull() | (cnt == 0) | (cnt > k - 1), F.lit(None)).otherwise(cnt).cast("int")


def _long_with_category(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    items = []
    for f in features:
        dt = df.schema[f].dataType
        num = is_numeric_type(dt)
        v = F.col(f).cast("double") if num else F.lit(None).cast("double")
        v = F.when(F.isnan(v), None).otherwise(v) if num else v
        items.append(F.struct(F.lit(f).alias("feature"), v.alias("value"),
                              F.col(f).cast("string").alias("cat"), F.lit(num).alias("is_num")))
    return df.select(F.col(target).cast("double").alias("_y"), F.inline(F.array(*items)))


def woe_tables(df: DataFrame, features: Sequence[str], target: str, n_bins: int = 10,
               method: str = "quantile"):
    """WOE tables of many features at once.

    Returns ``(woe_df, errors)``: ``woe_df`` has WOE_SCHEMA, ``errors`` maps a feature to the
    reason it could not be scored (one target class absent). Semantics per feature follow
    the reference: strings, or numerics with <= n_bins distinct values, get one bin per
    value (nulls become their own 'nan' bin); other numerics are cut into quantile or
    equal-width bins with empty bins kept; +0.5 smoothing on both distributions.
    """
    require_columns(df, [*features, target])
    spark = df.sparkSession
    long = _long_with_category(df, features, target)
    y = F.col("_y")
    dist = persist(long.groupBy("feature", "is_num", "value", "cat").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(y).alias("n_valid"),
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("events"),
        F.sum(F.when(y.isNotNull() & (y != 0) & (y != 1), 1).otherwise(0)).cast("long").alias("bad")))
    stats = {r["feature"]: r for r in dist.groupBy("feature").agg(
        F.first("is_num").alias("is_num"), F.count("value").alias("nunique"),
        F.sum("bad").alias("bad"),
        # per-feature totals for the smoothing, known before any binning: continuous
        # features count non-null values, categorical ones every row (nulls are a bin)
        F.sum(F.when(F.col("value").isNotNull(), F.col("events")).otherwise(0)).alias("ev_nn"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n_valid")).otherwise(0)).alias("nv_nn"),
        F.sum("events").alias("ev_all"), F.sum("n_valid").alias("nv_all"),
        F.count_if(F.col("n_valid") > 0).alias("kcat")).collect()}
    if any((r["bad"] or 0) > 0 for r in stats.values()):
        raise ValueError(f"target '{target}' must be binary 0/1")
    categorical = [f for f in features if not stats[f]["is_num"] or stats[f]["nunique"] <= n_bins]
    continuous = [f for f in features if f not in categorical]

    parts = []
    edges_cont: dict[str, list[float]] = {}
    if continuous:
        cdist = dist.where(F.col("feature").isin(continuous) & F.col("value").isNotNull())
        if method == "quantile":
            raw = quantile_edges_from_distinct(cdist, n_bins)
            edges = {f: dedupe_edges(e) for f, (e, _n) in raw.items()}
            include_lowest = True
        elif method == "equal_width":
            mm = cdist.groupBy("feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx")).collect()
            edges = {r["feature"]: dedupe_edges(equal_width_edges(r["mn"], r["mx"], n_bins)) for r in mm}
            include_lowest = False
        elif method == "tree":
            from .treebins import tree_edges
            edges = tree_edges(cdist, n_bins)
            include_lowest = False
        else:
            raise ValueError(f"unknown binning method: {method}")
        edges_cont = edges
        binned = (cdist.withColumn("bin_id", _bin_by_edges(F.col("value"), F.col("feature"), edges, include_lowest))
                  .where(F.col("bin_id").isNotNull())
                  .groupBy("feature", "bin_id")
                  .agg(F.sum("n_valid").alias("count"), F.sum("events").alias("events")))
        dim = spark.createDataFrame(
            [(f, i + 1, float(es[i]), float(es[i + 1])) for f, es in edges.items() for i in range(len(es) - 1)],
            "feature string, bin_id int, lower double, upper double")
        cont = (dim.join(binned, ["feature", "bin_id"], "left")
                .select("feature", "bin_id", "lower", "upper", F.lit(None).cast("string").alias("category"),
                        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                        F.coalesce("events", F.lit(0)).cast("long").alias("events")))
        parts.append(cont)
    if categorical:
        cat = (dist.where(F.col("feature").isin(categorical))
               .withColumn("category", F.coalesce(F.col("cat"), F.lit("nan")))
               .groupBy("feature", "category")
               .agg(F.sum("n_valid").alias("count"), F.sum("events").alias("events"))
               .where(F.col("count") > 0))
        # bin ids = rank of the category within its feature; a window would put all
        # categories of a feature in one task
        cat, _ = ordered_prefix(cat, ["category"], ["feature"], collect_totals=False)
        cat = cat.select("feature", (F.col("_start") + 1).cast("int").alias("bin_id"),
                         F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"),
                         "category", F.col("count").cast("long").alias("count"),
                         F.col("events").cast("long").alias("events"))
        parts.append(cat)
    if not parts:
        return spark.createDataFrame([], WOE_SCHEMA), {}
    tab = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    tab = tab.withColumn("non_events", (F.col("count") - F.col("events")).cast("long"))
    # per-feature totals (bins k, events, non-events) from the statistics collected above:
    # literals, no extra aggregation over the bin table
    totals = {}
    for f in features:
        r = stats[f]
        if f in categorical:
            totals[f] = (int(r["kcat"]), int(r["ev_all"] or 0), int((r["nv_all"] or 0) - (r["ev_all"] or 0)))
        elif f in edges_cont:
            totals[f] = (len(edges_cont[f]) - 1, int(r["ev_nn"] or 0), int((r["nv_nn"] or 0) - (r["ev_nn"] or 0)))

    def lit_map(i):
        return F.element_at(F.create_map(*[x for f, t in totals.items() for x in (F.lit(f), F.lit(t[i]))]),
                            F.col("feature"))

    tab = (tab.withColumn("_k", lit_map(0)).withColumn("_te", lit_map(1)).withColumn("_tn", lit_map(2))
           .withColumn("_de", (F.col("events") + 0.5) / (F.col("_te") + 0.5 * F.col("_k")))
           .withColumn("_dn", (F.col("non_events") + 0.5) / (F.col("_tn") + 0.5 * F.col("_k"))))
    ok = (F.col("_te") > 0) & (F.col("_tn") > 0)
    woe = F.when(ok, F.log(F.col("_de") / F.col("_dn")))
    tab = tab.select("feature", "bin_id", "lower", "upper", "category", "count", "events", "non_events",
                     F.try_divide(F.col("events").cast("double"), F.col("count").cast("double")).alias("event_rate"),
                     woe.alias("woe"), F.when(ok, (F.col("_de") - F.col("_dn")) * woe).alias("iv_component"),
                     F.when(~ok, F.lit("target has a single class")).alias("_err"))
    return tab, dist


def woe_table(df: DataFrame, feature: str, target: str, n_bins: int = 10, method: str = "quantile") -> DataFrame:
    """WOE table of one feature (WOE_SCHEMA); raises when one target class is absent."""
    tab, _ = woe_tables(df, [feature], target, n_bins, method)
    tab = persist(tab)
    if tab.where(F.col("_err").isNotNull()).limit(1).count() > 0:
        raise ValueError("target has a single class; WOE/IV undefined")
    return tab.drop("_err")


def iv_table(df: DataFrame, features: Sequence[str], target: str, n_bins: int = 10,
             method: str = "quantile") -> DataFrame:
    """IV ranking (feature, iv, predictive_power, error), one job for all features."""
    tab, _ = woe_tables(df, features, target, n_bins, method)
    agg = tab.groupBy("feature").agg(F.sum("iv_component").alias("_iv"), F.max("_err").alias("error"))
    iv = F.when(F.col("error").isNull(), F.round(F.col("_iv"), 4)).otherwise(F.lit(0.0))
    return (agg.select("feature", iv.alias("iv"), "error")
            .select("feature", "iv", ladder(F.col("iv"), IV_LADDER, IV_ELSE).alias("predictive_power"), "error")
            .transform(lambda d: sort_small(d, F.desc("iv"), "feature")))


# ---------------------------------------------------------------------------
# PSI
# ---------------------------------------------------------------------------

PSI_SCHEMA = ("variable string, bin_id int, lower double, upper double, expected_count long, "
              "actual_count long, expected_pct double, actual_pct double, psi_component double")


def common_numeric_columns(expected: DataFrame, actual: DataFrame) -> list[str]:
    return sorted(set(numeric_cols(expected)) & set(numeric_cols(actual)))


def psi_tables(expected: DataFrame, actual: DataFrame, columns: Sequence[str] | None = None,
               bins: int = 10, method: str = "quantile"):
    """PSI tables of many variables in one job. Returns (table_df, errors dict)."""
    spark = expected.sparkSession
    columns = list(columns) if columns is not None else common_numeric_columns(expected, actual)
    require_columns(expected, columns)
    require_columns(actual, columns)

    def long(df):
        items = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns]
        out = df.select(F.inline(F.array(*items)))
        return out.where(F.col("value").isNotNull() & ~F.isnan("value"))

    le = long(expected)
    dist = persist(le.groupBy(F.col("variable").alias("feature"), "value").agg(F.count(F.lit(1)).alias("n")))
    errors: dict[str, str] = {}
    if method == "quantile":
        raw = quantile_edges_from_distinct(dist, bins)
    elif method == "equal_width":
        mm = dist.groupBy("feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx"),
                                         F.sum("n").alias("n")).collect()
        raw = {r["feature"]: (equal_width_edges(r["mn"], r["mx"], bins), int(r["n"])) for r in mm}
    else:
        raise ValueError(f"unknown binning method: {method}")
    edges = {}
    for c in columns:
        if c not in raw:
            errors[c] = "no baseline values"
            continue
        es = dedupe_edges(raw[c][0])
        if len(es) < 2:
            errors[c] = "constant baseline"
            continue
        es = [float("-inf"), *es[1:-1], float("inf")]
        edges[c] = es
    empty = spark.createDataFrame([], PSI_SCHEMA)
    if not edges:
        return empty, errors
    inner = {c: es[1:-1] for c, es in edges.items()}

    def binned(name_col):
        return 1 + count_edges_by_key(F.col(name_col), F.col("value"), inner)

    ecnt = (dist.where(F.col("feature").isin(list(edges)))
            .groupBy(F.col("feature").alias("variable"), binned("feature").cast("int").alias("bin_id"))
            .agg(F.sum("n").alias("expected_count")))
    acnt = (long(actual).where(F.col("variable").isin(list(edges)))
            .groupBy("variable", binned("variable").cast("int").alias("bin_id"))
            .agg(F.count(F.lit(1)).alias("actual_count")))
    dim = spark.createDataFrame(
        [(c, i + 1, es[i], es[i + 1]) for c, es in edges.items() for i in range(len(es) - 1)],
        "variable string, bin_id int, lower double, upper double")
    tab = (dim.join(ecnt, ["variable", "bin_id"], "left").join(acnt, ["variable", "bin_id"], "left")
           .withColumn("expected_count", F.coalesce("expected_count", F.lit(0)).cast("long"))
           .withColumn("actual_count", F.coalesce("actual_count", F.lit(0)).cast("long")))
    wv = Window.partitionBy("variable")
    k = F.count(F.lit(1)).over(wv)
    tab = (tab.withColumn("_k", k)
           .withColumn("expected_pct", (F.col("expected_count") + 0.5)
                       / (F.sum("expected_count").over(wv) + 0.5 * F.col("_k")))
           .withColumn("actual_pct", (F.col("actual_count") + 0.5)
                       / (F.sum("actual_count").over(wv) + 0.5 * F.col("_k")))
           .withColumn("psi_component", (F.col("actual_pct") - F.col("expected_pct"))
                       * F.log(F.col("actual_pct") / F.col("expected_pct")))
           .drop("_k"))
    return tab.select(*[c.split()[0] for c in PSI_SCHEMA.split(", ")]), errors


def psi_table(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10,
              method: str = "quantile") -> DataFrame:
    """PSI table of one variable."""
    tab, errors = psi_tables(expected, actual, [column], bins, method)
    return tab


def psi_report(expected: DataFrame, actual: DataFrame, columns: Sequence[str] | None = None,
               bins: int = 10, method: str = "quantile") -> DataFrame:
    """(variable, psi, stability, error) sorted by psi desc, nulls last."""
    spark = expected.sparkSession
    columns = list(columns) if columns is not None else common_numeric_columns(expected, actual)
    tab, errors = psi_tables(expected, actual, columns, bins, method)
    ok = tab.groupBy("variable").agg(F.round(F.sum("psi_component"), 4).alias("psi"))
    ok = ok.withColumn("error", F.lit(None).cast("string"))
    rows = [(c, 0.0 if e == "constant baseline" else None, e) for c, e in errors.items()]
    if rows:
        bad = spark.createDataFrame(rows, "variable string, psi double, error string")
        ok = ok.unionByName(bad)
    stab = F.when(F.col("error").isNotNull() & F.col("psi").isNull(), F.lit("error")).otherwise(
        ladder(F.col("psi"), PSI_LADDER, PSI_ELSE))
    return sort_small(ok.select("variable", "psi", stab.alias("stability"), "error"),
                      F.desc_nulls_last("psi"), "variable")


def psi_value_schema():
    return T.StructType([T.StructField("variable", T.StringType()), T.StructField("psi", T.DoubleType())])
