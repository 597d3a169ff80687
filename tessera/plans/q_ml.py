"""Chart-data (C2-C10), evaluation (M1-M11), preparation (L1-L8) and model (E*) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chartdata, evaluate, models, prep
from .q_scorecard import SHIP_SPLIT
from .registry import register
from .tables import round_doubles, table, ts


def _edges_sql(col: str, src: str, b: int, name: str) -> str:
    """SQL for numpy-linspace edges of ``col`` (with the +-0.5 constant-column widening)."""
    return (f"{name} AS (SELECT {b} AS b, list_transform(range(0, {b} + 1), lambda k: CASE WHEN k = {b} THEN hi "
            f"ELSE k * ((hi - lo) / {b}) + lo END) AS edges FROM (SELECT CASE WHEN min({col}) = max({col}) "
            f"THEN min({col}) - 0.5 ELSE min({col}) END AS lo, CASE WHEN min({col}) = max({col}) THEN max({col}) + 0.5 "
            f"ELSE max({col}) END AS hi FROM {src}))")


def _bin_sql(v: str, e: str) -> str:
    return f"CAST(1 + len(list_filter({e}.edges[2:{e}.b], lambda t: t <= {v})) AS INTEGER)"


# ---------------------------------------------------------------------------
# Chart data
# ---------------------------------------------------------------------------

@register("c02_scatter_trend", """
SELECT CAST(l_returnflag AS VARCHAR) AS "group", count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY l_returnflag""")
def q_c02_scatter_trend(spark, sf):
    return round_doubles(chartdata.scatter_trend(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice",
                                                 "l_returnflag"))


@register("c03_box_stats", """
WITH s AS (SELECT c_mktsegment AS grp, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS med,
                  quantile_cont(c_acctbal, 0.75) AS q3, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM s)
SELECT b.grp AS "group", any_value(b.n) AS n, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median,
       round(any_value(q3), 6) AS q3, round(min(c_acctbal) FILTER (WHERE c_acctbal BETWEEN lo AND hi), 6) AS whisker_low,
       round(max(c_acctbal) FILTER (WHERE c_acctbal BETWEEN lo AND hi), 6) AS whisker_high,
       count(*) FILTER (WHERE c_acctbal < lo OR c_acctbal > hi) AS outliers
FROM customer c JOIN b ON c.c_mktsegment = b.grp WHERE c_acctbal IS NOT NULL GROUP BY b.grp""")
def q_c03_box_stats(spark, sf):
    return round_doubles(chartdata.box_stats(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment"))


@register("p09_prepare_data", """
WITH li AS (SELECT l_orderkey * 10 + l_linenumber AS k, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS q, l_tax,
                   CASE WHEN l_orderkey % 13 <> 0 THEN l_returnflag END AS y FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat(CAST(k AS VARCHAR), '-42')), k) - 1 AS pos,
             count(*) OVER (PARTITION BY y) AS n FROM li WHERE q IS NOT NULL AND l_tax IS NOT NULL AND y IS NOT NULL)
SELECT k, q, l_tax, y, CASE WHEN pos < ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split FROM r""")
def q_p09_prepare_data(spark, sf):
    order = F.col("l_orderkey")
    li = table(spark, sf, "lineitem").select(
        (order * 10 + F.col("l_linenumber")).alias("k"), F.when(order % 7 != 0, F.col("l_quantity")).alias("q"), "l_tax",
        F.when(order % 13 != 0, F.col("l_returnflag")).alias("y"))
    return models.prepare_data(li, ["q", "l_tax"], [], "y", "k")


@register("c03_box_many_groups", """
WITH v AS (SELECT CAST(l_partkey AS VARCHAR) AS grp, l_extendedprice AS x FROM lineitem
           WHERE l_partkey IS NOT NULL AND l_extendedprice IS NOT NULL),
s AS (SELECT grp, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3, count(*) AS n
      FROM v GROUP BY 1)
SELECT grp AS "group", n, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3 FROM s""")
def q_c03_box_many_groups(spark, sf):
    out = chartdata.box_stats(table(spark, sf, "lineitem"), "l_extendedprice", "l_partkey")
    return out.select("group", "n", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")])


@register("c05_pie_all", """
SELECT p_type AS label, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent
FROM part WHERE p_type IS NOT NULL GROUP BY 1""")
def q_c05_pie_all(spark, sf):
    return round_doubles(chartdata.pie_data(table(spark, sf, "part"), "p_type"))


@register("c04_bar", """
SELECT l_returnflag, l_linestatus, round(CAST(sum(l_quantity) AS DOUBLE), 6) AS value FROM lineitem
WHERE l_returnflag IS NOT NULL GROUP BY ALL""")
def q_c04_bar(spark, sf):
    return round_doubles(chartdata.bar_data(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_linestatus"))


@register("c05_pie", """
WITH t AS (SELECT CAST(o_orderpriority AS VARCHAR) AS label, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL
           GROUP BY 1 ORDER BY count DESC, label LIMIT 10)
SELECT label, count, round(count * 100.0 / sum(count) OVER (), 6) AS percent FROM t""")
def q_c05_pie(spark, sf):
    return round_doubles(chartdata.pie_data(table(spark, sf, "orders"), "o_orderpriority", 10))


PAIR_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _pair_sql() -> str:
    edges = ", ".join(_edges_sql(c, "lineitem", 10, f"e_{c}") for c in PAIR_COLS)
    parts = []
    for i in range(len(PAIR_COLS)):
        for j in range(i + 1, len(PAIR_COLS)):
            a, b = PAIR_COLS[i], PAIR_COLS[j]
            parts.append(f"SELECT '{a}' AS col_x, '{b}' AS col_y, {_bin_sql(a, f'e_{a}')} AS bx, {_bin_sql(b, f"e_{b}")} AS \"by\" "
                         f"FROM lineitem, e_{a}, e_{b} WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    return f"WITH {edges}, l AS ({' UNION ALL '.join(parts)}) SELECT col_x, col_y, bx, \"by\", count(*) AS count FROM l GROUP BY ALL"


@register("c07_pair_bins", _pair_sql())
def q_c07_pair_bins(spark, sf):
    return chartdata.pair_bins(table(spark, sf, "lineitem"), PAIR_COLS, 10)


@register("c08_distribution_shift", f"""
WITH x AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '{SHIP_SPLIT}' THEN 'expected' ELSE 'actual' END AS dataset,
                  l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL),
{_edges_sql('v', 'x', 30, 'e')},
c AS (SELECT dataset, {_bin_sql('x.v', 'e')} AS bin_id, count(*) AS cnt FROM x, e GROUP BY ALL),
d AS (SELECT ds.dataset, CAST(i AS INTEGER) AS bin_id, edges[i] AS lower, edges[i + 1] AS upper
      FROM (SELECT unnest(['expected', 'actual']) AS dataset) ds, (SELECT edges, unnest(range(1, 31)) AS i FROM e))
SELECT d.dataset, d.bin_id, round(d.lower, 6) AS lower, round(d.upper, 6) AS upper, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM d LEFT JOIN c USING (dataset, bin_id)""")
def q_c08_distribution_shift(spark, sf):
    li = table(spark, sf, "lineitem")
    exp = li.where(F.col("l_shipdate") < ts(SHIP_SPLIT))
    act = li.where(F.col("l_shipdate") >= ts(SHIP_SPLIT))
    return round_doubles(chartdata.distribution_shift(exp, act, "l_extendedprice", 30))


@register("c10_pred_range", """
SELECT CAST(least(min(l_discount), min(l_tax)) AS DOUBLE) AS lo, CAST(greatest(max(l_discount), max(l_tax)) AS DOUBLE) AS hi
FROM lineitem""")
def q_c10_pred_range(spark, sf):
    return chartdata.actual_vs_predicted_range(table(spark, sf, "lineitem"), "l_discount", "l_tax")


# ---------------------------------------------------------------------------
# Evaluation over a scoring rule on orders (label = status; rule by date and price)
# ---------------------------------------------------------------------------

RULE_SQL = ("CASE WHEN o_orderdate < TIMESTAMP '1995-06-17' THEN 'F' WHEN o_totalprice > 250000 THEN 'O' "
            "ELSE 'P' END")


def _rule_pred(spark, sf):
    o = table(spark, sf, "orders")
    rule = (F.when(F.col("o_orderdate") < ts("1995-06-17"), "F").when(F.col("o_totalprice") > 250000, "O")
            .otherwise("P"))
    return o.withColumn("pred", rule)


_REPORT_SQL = f"""
WITH p AS (SELECT o_orderstatus AS y, {RULE_SQL} AS yhat FROM orders),
cells AS (SELECT y, yhat, count(*) AS c FROM p GROUP BY ALL),
cls AS (SELECT y AS class FROM cells UNION SELECT yhat FROM cells),
rep AS (SELECT class,
          coalesce((SELECT sum(c) FROM cells WHERE y = class AND yhat = class), 0) AS tp,
          coalesce((SELECT sum(c) FROM cells WHERE y = class), 0) AS support,
          coalesce((SELECT sum(c) FROM cells WHERE yhat = class), 0) AS predicted FROM cls),
m AS (SELECT class, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall, CAST(support AS BIGINT) AS support
      FROM rep),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)"""


@register("m01_classification_metrics", _REPORT_SQL + """
SELECT round((SELECT avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) FROM p), 6) AS accuracy,
       round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall,
       round(sum(f1 * support) / sum(support), 6) AS f1 FROM f WHERE support > 0""")
def q_m01_classification_metrics(spark, sf):
    return round_doubles(evaluate.classification_metrics(_rule_pred(spark, sf), "o_orderstatus", "pred"))


@register("m04_classification_report", _REPORT_SQL + """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f""")
def q_m04_classification_report(spark, sf):
    return round_doubles(evaluate.classification_report(_rule_pred(spark, sf), "o_orderstatus", "pred"))


@register("m03_confusion_many_classes", """
WITH p AS (SELECT p_size AS y, p_partkey % 60 AS yhat FROM part),
cells AS (SELECT CAST(y AS VARCHAR) AS y, CAST(yhat AS VARCHAR) AS yhat, count(*) AS c FROM p GROUP BY ALL),
cls AS (SELECT y AS v FROM cells UNION SELECT yhat FROM cells)
SELECT a.v AS label, b.v AS prediction, CAST(coalesce(c.c, 0) AS BIGINT) AS count
FROM cls a, cls b LEFT JOIN cells c ON c.y = a.v AND c.yhat = b.v""")
def q_m03_confusion_many_classes(spark, sf):
    p = table(spark, sf, "part").withColumn("guess", F.col("p_partkey") % 60)
    return evaluate.confusion_matrix(p, "p_size", "guess")


@register("m03_confusion_matrix", f"""
WITH p AS (SELECT o_orderstatus AS y, {RULE_SQL} AS yhat FROM orders),
cells AS (SELECT y, yhat, count(*) AS c FROM p GROUP BY ALL),
cls AS (SELECT y AS v FROM cells UNION SELECT yhat FROM cells)
SELECT a.v AS label, b.v AS prediction, CAST(coalesce(c.c, 0) AS BIGINT) AS count
FROM cls a, cls b LEFT JOIN cells c ON c.y = a.v AND c.yhat = b.v""")
def q_m03_confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_rule_pred(spark, sf), "o_orderstatus", "pred")


@register("m05_roc_curve", """
WITH d AS (SELECT o_totalprice AS s, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS pos, count(*) AS cnt
           FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1),
c AS (SELECT s, row_number() OVER (ORDER BY s DESC) - 1 AS idx,
             sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tps,
             sum(cnt - pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fps FROM d),
a AS (SELECT CAST('inf' AS DOUBLE) AS s, CAST(-1 AS BIGINT) AS idx, 0 AS tps, 0 AS fps UNION ALL SELECT s, idx, tps, fps FROM c),
l AS (SELECT *, lag(tps) OVER (ORDER BY idx) AS tp0, lag(fps) OVER (ORDER BY idx) AS fp0,
             lead(tps) OVER (ORDER BY idx) AS tp2, lead(fps) OVER (ORDER BY idx) AS fp2 FROM a),
t AS (SELECT sum(pos) AS pp, sum(cnt - pos) AS nn FROM d)
SELECT idx AS point, round(fps / nn, 6) AS fpr, round(tps / pp, 6) AS tpr, round(s, 6) AS threshold FROM l, t
WHERE tp0 IS NULL OR tp2 IS NULL OR (fp2 - 2 * fps + fp0) <> 0 OR (tp2 - 2 * tps + tp0) <> 0""")
def q_m05_roc_curve(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return round_doubles(evaluate.roc_curve(o, "y", "o_totalprice"))


@register("m05_auc", """
WITH r AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
                  rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS rk
           FROM orders WHERE o_totalprice IS NOT NULL),
t AS (SELECT sum(y) AS pp, count(*) - sum(y) AS nn, sum(rk) FILTER (WHERE y = 1) AS rs FROM r)
SELECT round((rs - pp * (pp + 1) / 2.0) / (pp * nn), 6) AS auc FROM t""")
def q_m05_auc(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    auc = evaluate.roc_auc(o, "y", "o_totalprice")
    return spark.createDataFrame([(None if auc is None else round(auc, 6),)], "auc double")


@register("m06_regression_metrics", """
SELECT round(avg(power(l_discount - l_tax, 2)), 6) AS mse, round(sqrt(avg(power(l_discount - l_tax, 2))), 6) AS rmse,
       round(avg(abs(l_discount - l_tax)), 6) AS mae,
       round(1 - sum(power(l_discount - l_tax, 2)) / (var_pop(l_discount) * count(*)), 6) AS r2
FROM lineitem WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL""")
def q_m06_regression_metrics(spark, sf):
    return round_doubles(evaluate.regression_metrics(table(spark, sf, "lineitem"), "l_discount", "l_tax"))


# ---------------------------------------------------------------------------
# Preparation
# ---------------------------------------------------------------------------

@register("l01_label_encode", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS label_idx FROM orders""")
def q_l01_label_encode(spark, sf):
    return prep.label_index(table(spark, sf, "orders"), "o_orderstatus").select("o_orderkey", "label_idx")


_SPLIT_SQL = """
WITH b AS (SELECT o_orderkey, o_orderstatus, o_totalprice,
                  row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '-42')), o_orderkey) - 1 AS pos,
                  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
s AS (SELECT *, CASE WHEN pos < ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split FROM b)"""


@register("l02_stratified_split", _SPLIT_SQL + "\nSELECT o_orderkey, o_orderstatus, split FROM s")
def q_l02_stratified_split(spark, sf):
    return prep.stratified_split(table(spark, sf, "orders"), "o_orderstatus", "o_orderkey", 0.2, 42).select(
        "o_orderkey", "o_orderstatus", "split")


@register("l03_standardize", _SPLIT_SQL + """,
st AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM s WHERE split = 'train')
SELECT o_orderkey, split, round((o_totalprice - m) / sd, 6) AS z FROM s, st""")
def q_l03_standardize(spark, sf):
    sp = prep.stratified_split(table(spark, sf, "orders"), "o_orderstatus", "o_orderkey", 0.2, 42)
    z = prep.standardize(sp, ["o_totalprice"], fit_on=sp.where(F.col("split") == "train"), suffix="_z")
    return round_doubles(z.select("o_orderkey", "split", F.col("o_totalprice_z").alias("z")))


@register("l04_one_hot", """
WITH c AS (SELECT list_sort(list_distinct(list(o_orderpriority))) AS cats FROM orders)
SELECT o_orderkey, list_transform(cats, lambda x: CASE WHEN x = o_orderpriority THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)
       AS o_orderpriority_onehot FROM orders, c""")
def q_l04_one_hot(spark, sf):
    return prep.one_hot(table(spark, sf, "orders"), "o_orderpriority").select("o_orderkey", "o_orderpriority_onehot")


@register("l07_class_weights", """
WITH c AS (SELECT CAST(o_orderstatus AS VARCHAR) AS class, count(*) AS count FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1)
SELECT class, count, round(CAST((SELECT sum(count) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * count), 6) AS weight FROM c""")
def q_l07_class_weights(spark, sf):
    return round_doubles(prep.class_weights(table(spark, sf, "orders"), "o_orderstatus"))


@register("l08_undersample", """
WITH b AS (SELECT o_orderkey, o_orderstatus,
                  row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '-42')), o_orderkey) - 1 AS pos
           FROM orders),
m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))
SELECT o_orderkey, o_orderstatus FROM b, m WHERE pos < m""")
def q_l08_undersample(spark, sf):
    return prep.undersample(table(spark, sf, "orders"), "o_orderstatus", "o_orderkey", 42).select(
        "o_orderkey", "o_orderstatus")


# ---------------------------------------------------------------------------
# Models (rows-only: MLlib training is not expressible in SQL)
# ---------------------------------------------------------------------------

ORD_NUM = ["o_totalprice", "o_custkey"]
ORD_CAT = ["o_orderpriority"]


def _orders_split(spark, sf):
    o = table(spark, sf, "orders")
    sp = models.gathered(prep.stratified_split(o, "o_orderstatus", "o_orderkey", 0.2, 42))
    return sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")


@register("m07_compare_classifiers")
def q_m07_compare_classifiers(spark, sf):
    train, test = _orders_split(spark, sf)
    return models.compare_models("classification", train, test, ORD_NUM, ORD_CAT, "o_orderstatus",
                                 ["logistic_regression", "decision_tree", "naive_bayes", "random_forest"])


@register("m07_compare_regressors")
def q_m07_compare_regressors(spark, sf):
    train, test = _orders_split(spark, sf)
    return models.compare_models("regression", train, test, ["o_custkey"], ["o_orderpriority", "o_orderstatus"],
                                 "o_totalprice", ["linear_regression", "ridge", "decision_tree"])


@register("m08_kfold_cv")
def q_m08_kfold_cv(spark, sf):
    return models.kfold_cv("classification", table(spark, sf, "orders"), ORD_NUM, ORD_CAT, "o_orderstatus",
                           "o_orderkey", "decision_tree", 5)


@register("m09_grid_search")
def q_m09_grid_search(spark, sf):
    return models.grid_search(table(spark, sf, "orders"), ORD_NUM, ORD_CAT, "o_orderstatus", "o_orderkey",
                              "decision_tree", {"maxDepth": [3, 5], "minInstancesPerNode": [1, 5]}, k=3)


@register("m11_feature_importance")
def q_m11_feature_importance(spark, sf):
    train, test = _orders_split(spark, sf)
    model, _ = models.train_and_score("random_forest", "classification", train, test, ORD_NUM, [], "o_orderstatus")
    return evaluate.top_abs(evaluate.feature_importance(model.stages[-1], ORD_NUM), "importance", 20)


@register("e13_kmeans")
def q_e13_kmeans(spark, sf):
    emb = table(spark, sf, "embeddings")
    wide = emb.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    pred, sil = models.kmeans(wide, [f"x{i}" for i in range(64)], k=3)
    return pred.groupBy("prediction").agg(F.count(F.lit(1)).alias("n")).withColumn("silhouette_sq", F.lit(sil))


@register("e15_pca")
def q_e15_pca(spark, sf):
    from pyspark.ml.functions import array_to_vector
    emb = table(spark, sf, "embeddings").withColumn("features", array_to_vector("embedding"))
    return models.pca_2d(emb).select("vec_id", "label", "pc1", "pc2")
