"""Model queries beyond MLlib's catalogue: LDA (E7), AdaBoost (E8), RBF SVM (E4),
DBSCAN (E14, J8) and sampled Shapley values (M12)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import models, models_extra, prep
from ..operators.dbscan import dbscan
from ..operators.explain import sampled_shapley
from .registry import register
from .tables import round_doubles, table

FEATS = ["o_totalprice", "o_custkey"]


def _split(spark, sf):
    o = table(spark, sf, "orders")
    sp = models.gathered(prep.stratified_split(o, "o_orderstatus", "o_orderkey", 0.2, 42))
    return sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")


@register("e07_lda_class_stats", """
SELECT CAST(o_orderstatus AS VARCHAR) AS class, count(*) AS n, round(avg(o_totalprice), 6) AS mean_o_totalprice,
       round(avg(CAST(o_custkey AS DOUBLE)), 6) AS mean_o_custkey,
       round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL
                                          AND o_orderstatus IS NOT NULL), 6) AS prior
FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY o_orderstatus""")
def q_e07_lda_class_stats(spark, sf):
    return round_doubles(models_extra.lda_class_stats(table(spark, sf, "orders"), FEATS, "o_orderstatus"))


@register("e07_lda_predict", """
WITH b AS (SELECT o_orderkey, o_orderstatus, o_totalprice AS x1, CAST(o_custkey AS DOUBLE) AS x2,
                  row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '-42')), o_orderkey) - 1 AS pos,
                  count(*) OVER (PARTITION BY o_orderstatus) AS cnt FROM orders),
s AS (SELECT *, CASE WHEN pos < ceil(CAST(0.2 AS DOUBLE) * cnt) THEN 'test' ELSE 'train' END AS split FROM b),
tr AS (SELECT * FROM s WHERE split = 'train' AND x1 IS NOT NULL AND x2 IS NOT NULL),
cls AS (SELECT o_orderstatus AS c, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, coalesce(covar_samp(x1, x1), 0) AS c11,
               coalesce(covar_samp(x1, x2), 0) AS c12, coalesce(covar_samp(x2, x2), 0) AS c22 FROM tr GROUP BY 1),
tot AS (SELECT sum(n) AS nn, count(*) AS k FROM cls),
sg AS (SELECT sum(c11 * (n - 1)) / (any_value(nn) - any_value(k)) AS s11, sum(c12 * (n - 1)) / (any_value(nn) - any_value(k)) AS s12,
              sum(c22 * (n - 1)) / (any_value(nn) - any_value(k)) AS s22 FROM cls, tot),
inv AS (SELECT s22 / (s11 * s22 - s12 * s12) AS i11, -s12 / (s11 * s22 - s12 * s12) AS i12, s11 / (s11 * s22 - s12 * s12) AS i22 FROM sg),
co AS (SELECT c, i11 * m1 + i12 * m2 AS w1, i12 * m1 + i22 * m2 AS w2, m1, m2, n, nn FROM cls, inv, tot),
cf AS (SELECT c, w1, w2, -0.5 * (m1 * w1 + m2 * w2) + ln(CAST(n AS DOUBLE) / nn) AS b FROM co),
sc AS (SELECT t.o_orderkey, t.o_orderstatus, cf.c, cf.w1 * t.x1 + cf.w2 * t.x2 + cf.b AS score
       FROM (SELECT * FROM s WHERE split = 'test') t, cf),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, c ASC) AS rk FROM sc)
SELECT o_orderkey, o_orderstatus, c AS prediction FROM r WHERE rk = 1""")
def q_e07_lda_predict(spark, sf):
    train, test = _split(spark, sf)
    m = models_extra.lda_fit(train, FEATS, "o_orderstatus")
    return m.transform(test).select("o_orderkey", "o_orderstatus", "prediction")


@register("e08_adaboost")
def q_e08_adaboost(spark, sf):
    train, test = _split(spark, sf)
    m = models_extra.adaboost_fit(train, FEATS, "o_orderstatus", n_estimators=100)
    return m.transform(test).select("o_orderkey", "o_orderstatus", "prediction")


@register("e04_rbf_svm")
def q_e04_rbf_svm(spark, sf):
    train, test = _split(spark, sf)
    y = (F.col("o_orderstatus") == "F").cast("int")
    m = models_extra.rbf_svm_fit(train.withColumn("y", y), FEATS, "y", n_components=200)
    return m.transform(test.withColumn("y", y)).select("o_orderkey", "y", "prediction", "probability_1")


@register("e14_dbscan", """
WITH RECURSIVE st AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(CAST(c_nationkey AS DOUBLE)) AS mb, stddev_pop(c_nationkey) AS sb FROM customer),
z AS (SELECT c_custkey AS k, (c_acctbal - ma) / sa AS a, (c_nationkey - mb) / sb AS b FROM customer, st),
e AS (SELECT x.k AS a, y.k AS b FROM z x JOIN z y ON sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) <= 0.5),
core AS (SELECT a AS k FROM e GROUP BY a HAVING count(*) >= 5),
ce AS (SELECT a, b FROM e WHERE a <> b AND a IN (SELECT k FROM core) AND b IN (SELECT k FROM core)),
r(k, m) AS (SELECT k, k FROM core UNION SELECT ce.b, r.m FROM r JOIN ce ON ce.a = r.k),
low AS (SELECT k, min(m) AS m FROM r GROUP BY k),
num AS (SELECT k, CAST(dense_rank() OVER (ORDER BY m) - 1 AS INTEGER) AS cluster FROM low),
border AS (SELECT e.a AS k, min(num.cluster) AS cluster FROM e JOIN num ON num.k = e.b WHERE e.a NOT IN (SELECT k FROM core) GROUP BY e.a)
SELECT c_custkey, coalesce(num.cluster, border.cluster, -1) AS cluster FROM customer LEFT JOIN num ON num.k = c_custkey LEFT JOIN border ON border.k = c_custkey""")
def q_e14_dbscan(spark, sf):
    c = table(spark, sf, "customer")
    z = prep.standardize(c, ["c_acctbal", "c_nationkey"], suffix="_z")  # L13: scaled on all rows
    return dbscan(z, "c_custkey", ["c_acctbal_z", "c_nationkey_z"], eps=0.5, min_samples=5)


class _PositiveProbability:
    """A fitted pipeline without its label indexer, exposing P(class index 1)."""

    def __init__(self, pipeline_model):
        self.inner = PipelineModel(stages=pipeline_model.stages[1:])

    def transform(self, df):
        return self.inner.transform(df).withColumn("p1", vector_to_array("probability")[1])


@register("m12_shap")
def q_m12_shap(spark, sf):
    train, test = _split(spark, sf)
    y = F.when(F.col("o_orderstatus") == "F", "F").otherwise("other")
    train, test = train.withColumn("y", y), test.withColumn("y", y)
    model, _ = models.train_and_score("logistic_regression", "classification", train, test, FEATS, [], "y")
    return round_doubles(sampled_shapley(_PositiveProbability(model), "p1", test, train, "o_orderkey", FEATS,
                                         n_rows=100, n_background=100, n_samples=64))


@register("e10_mlp_regressor")
def q_e10_mlp_regressor(spark, sf):
    li = table(spark, sf, "lineitem")
    sp = prep.stratified_split(li.withColumn("_k", F.concat_ws("-", "l_orderkey", "l_linenumber")), None, "_k", 0.2, 42)
    train, test = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
    m = models_extra.mlp_regressor_fit(train, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return m.transform(test).select("l_orderkey", "l_linenumber", "l_extendedprice", "prediction")
