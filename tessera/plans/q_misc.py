"""Remaining operator queries: datetime describe (A5), edge tables (A18, A19), memory
usage (A25), common columns (J10), balancing report (L6), file round trips through
our sources and sinks (S1, S2, S8, S9, S10, S17) and random search (M10, K4)."""

from __future__ import annotations

import os
import uuid


from pyspark.sql import functions as F

from ..operators import binning, models, prep, profile, scorecard, tuning
from ..session import ensure_checkpoint_dir
from ..sources import readers, sinks
from .q_profile import NUM8, _unpivot_sql
from .registry import qs_sql, register
from .tables import round_doubles, table


def _scratch(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


@register("a05_describe_datetime", """
WITH x AS (SELECT epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL)
SELECT 'ts' AS "column", count(*) AS count, make_timestamp(CAST(round(avg(us)) AS BIGINT)) AS mean,
       make_timestamp(min(us)) AS min, make_timestamp(CAST(round(quantile_cont(us, 0.25)) AS BIGINT)) AS p25,
       make_timestamp(CAST(round(quantile_cont(us, 0.5)) AS BIGINT)) AS p50,
       make_timestamp(CAST(round(quantile_cont(us, 0.75)) AS BIGINT)) AS p75, make_timestamp(max(us)) AS max FROM x""")
def q_a05_describe_datetime(spark, sf):
    return profile.describe_datetime(table(spark, sf, "events"), ["ts"])


@register("a18_quantile_edges", f"""
WITH q AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {qs_sql(10)}))) AS e
           FROM {_unpivot_sql('lineitem', NUM8)} GROUP BY feature)
SELECT feature, CAST(i - 1 AS INTEGER) AS edge_id, round(e[i], 6) AS edge FROM (SELECT feature, e, unnest(range(1, len(e) + 1)) AS i FROM q)""")
def q_a18_quantile_edges(spark, sf):
    edges = binning.feature_edges(table(spark, sf, "lineitem"), NUM8, 10, "quantile")
    return round_doubles(binning.edges_frame(spark, edges))


@register("a19_equal_width_edges", f"""
WITH s AS (SELECT feature, min(value) AS mn, max(value) AS mx FROM {_unpivot_sql('lineitem', NUM8)} GROUP BY feature),
b AS (SELECT feature, mn, mx,
             CASE WHEN mn = mx THEN mn - (CASE WHEN mn <> 0 THEN 0.001 * abs(mn) ELSE 0.001 END) ELSE mn END AS lo,
             CASE WHEN mn = mx THEN mx + (CASE WHEN mx <> 0 THEN 0.001 * abs(mx) ELSE 0.001 END) ELSE mx END AS hi FROM s),
e AS (SELECT feature, list_transform(range(0, 11), lambda k: CASE WHEN k = 10 THEN hi
             WHEN k = 0 AND mn <> mx THEN lo - (mx - mn) * 0.001 ELSE k * ((hi - lo) / 10) + lo END) AS e FROM b)
SELECT feature, CAST(i - 1 AS INTEGER) AS edge_id, round(e[i], 6) AS edge FROM (SELECT feature, e, unnest(range(1, 12)) AS i FROM e)""")
def q_a19_equal_width_edges(spark, sf):
    edges = binning.feature_edges(table(spark, sf, "lineitem"), NUM8, 10, "equal_width")
    return round_doubles(binning.edges_frame(spark, edges))


_CUST = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@register("a25_memory_usage", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(coalesce(sum(strlen({c})), 0) AS BIGINT) AS bytes FROM customer" if t == "string"
    else f"SELECT '{c}' AS \"column\", CAST(count({c}) * {8 if t in ('bigint', 'double') else 4} AS BIGINT) AS bytes FROM customer"
    for c, t in _CUST.items()))
def q_a25_memory_usage(spark, sf):
    return profile.memory_usage(table(spark, sf, "customer"))


@register("j10_common_numeric", """
SELECT column_name AS "column" FROM (DESCRIBE lineitem) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE')""")
def q_j10_common_numeric(spark, sf):
    li = table(spark, sf, "lineitem")
    cols = scorecard.common_numeric_columns(li.where("l_shipdate < '1998-06-01'"), li.where("l_shipdate >= '1998-06-01'"))
    return spark.createDataFrame([(c,) for c in cols], "column string")


@register("l06_balance_distribution", """
WITH b AS (SELECT o_orderkey, o_orderstatus,
                  row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '-42')), o_orderkey) - 1 AS pos
           FROM orders),
m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)),
af AS (SELECT o_orderstatus FROM b, m WHERE pos < m),
d AS (SELECT 'before' AS stage, CAST(o_orderstatus AS VARCHAR) AS class, count(*) AS count FROM orders GROUP BY 2
      UNION ALL SELECT 'after', CAST(o_orderstatus AS VARCHAR), count(*) FROM af GROUP BY 2)
SELECT class, count, round(CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY stage), 4) AS ratio, stage FROM d""")
def q_l06_balance_distribution(spark, sf):
    o = table(spark, sf, "orders")
    after = prep.balance(o, "o_orderstatus", "o_orderkey", "undersample")
    return prep.class_distribution_before_after(o, after, "o_orderstatus")


def _cast_like(df, schema):
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


@register("s01_csv_roundtrip", "SELECT * FROM customer")
def q_s01_csv_roundtrip(spark, sf):
    """S8 write (UTF-8 with BOM) -> S1/S3/S4 read (encoding detected in tasks)."""
    c = table(spark, sf, "customer")
    path = _scratch(spark, "csv")
    sinks.write_csv(c, path, bom=True)
    return _cast_like(readers.read_csv(spark, path), c.schema)


@register("s02_txt_roundtrip", "SELECT * FROM customer")
def q_s02_txt_roundtrip(spark, sf):
    """Whitespace-separated text with a header line -> S2 reader (regex separator)."""
    c = table(spark, sf, "customer")
    path = _scratch(spark, "txt")
    c.write.option("header", True).option("sep", " ").csv(path)
    return _cast_like(readers.read_txt(spark, path), c.schema)


@register("s09_json_roundtrip", "SELECT * FROM customer")
def q_s09_json_roundtrip(spark, sf):
    c = table(spark, sf, "customer")
    path = _scratch(spark, "json")
    sinks.write_json(c, path)
    return _cast_like(spark.read.json(path), c.schema)


_CUST_KIND = {c: ("numeric" if t in ("bigint", "int", "double") else "categorical") for c, t in _CUST.items()}


@register("s10_dictionary_upsert", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS missing, "
    f"round(CAST(count(*) - count({c}) AS DOUBLE) * 100.0 / count(*), 6) AS missing_rate, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, '{_CUST_KIND[c]}' AS kind, "
    f"'{('numeric: ' + c) if _CUST_KIND[c] == 'numeric' else (t + ' column')}' AS description FROM customer"
    for c, t in _CUST.items()))
def q_s10_dictionary_upsert(spark, sf):
    """S10 + J9 + F10: export a data dictionary as one JSON object, import it back, upsert
    newer descriptions, keep entries naming real columns, join to the overview."""
    c = table(spark, sf, "customer")
    ov = profile.column_overview(c)
    first = ov.select("column", F.concat(F.col("dtype"), F.lit(" column")).alias("description"))
    path = _scratch(spark, "dict")
    sinks.dictionary_json(first).coalesce(1).write.text(path)
    loaded = sinks.read_dictionary(spark, path)
    newer = ov.where(F.col("kind") == "numeric").select("column", F.concat(F.lit("numeric: "), F.col("column")).alias("description"))
    merged = sinks.keep_known_columns(sinks.upsert_dictionary(loaded, newer), c)
    return round_doubles(profile.column_overview(c, merged))


@register("s17_model_package")
def q_s17_model_package(spark, sf):
    o = table(spark, sf, "orders")
    sp = prep.stratified_split(o, "o_orderstatus", "o_orderkey", 0.2, 42).cache()
    train, test = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
    model, pred = models.train_and_score("decision_tree", "classification", train, test, ["o_totalprice"], [],
                                         "o_orderstatus")
    acc = pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    path = _scratch(spark, "model")
    sinks.save_model_package(model, path, {"features": ["o_totalprice"], "task": "classification",
                                           "metrics": {"accuracy": acc}})
    loaded, meta, _ts = sinks.load_model_package(path)
    return loaded.transform(test).select("o_orderkey", "prediction")


@register("m10_random_search")
def q_m10_random_search(spark, sf):
    return models.random_search(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], ["o_orderpriority"],
                                "o_orderstatus", "o_orderkey", "decision_tree",
                                {"maxDepth": ("int", 2, 12), "minInstancesPerNode": ("int", 1, 20)}, n_trials=50, k=3)


@register("k04_top_trials")
def q_k04_top_trials(spark, sf):
    """The ten best of a search's trials, made from the table each time."""
    found = tuning.sequential_search(table(spark, sf, "orders"), ["o_totalprice"], [], "o_orderstatus", "o_orderkey",
                                     "logistic_regression", n_trials=12, k=2)
    return models.top_trials(found.trials, 10)


@register("c11_cv_score_box")
def q_c11_cv_score_box(spark, sf):
    cv = models.kfold_cv("classification", table(spark, sf, "orders"), ["o_totalprice", "o_custkey"],
                         ["o_orderpriority"], "o_orderstatus", "o_orderkey", "naive_bayes", 5)
    return models.cv_scores_long(cv)
