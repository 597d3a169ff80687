"""Neighbour queries: exact kNN self-join (J6), kNN classification (E5/J7) and the
over-sampling family (L9-L11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbors, prep, sampling
from .registry import register
from .tables import round_doubles, table

_EMB = "CAST(embedding AS DOUBLE[])"


@register("j06_knn_self_join", f"""
WITH e AS (SELECT vec_id, {_EMB} AS v FROM embeddings),
d AS (SELECT a.vec_id AS qid, b.vec_id AS pid, list_distance(a.v, b.v) AS distance FROM e a, e b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, pid) AS rk FROM d)
SELECT qid, pid, round(distance, 6) AS distance, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 5""")
def q_j06_knn_self_join(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("v"))
    out = neighbors.knn_join(e.withColumnRenamed("vec_id", "qid"), e.withColumnRenamed("vec_id", "pid"), 5,
                             exclude_self=True)
    return round_doubles(out)


_SPLIT = """s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
       row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(vec_id AS VARCHAR), '-42')), vec_id) - 1 AS pos,
       count(*) OVER (PARTITION BY label) AS n FROM embeddings),
tr AS (SELECT * FROM s WHERE pos >= ceil(CAST(0.2 AS DOUBLE) * n)), te AS (SELECT * FROM s WHERE pos < ceil(CAST(0.2 AS DOUBLE) * n))"""


@register("e05_knn_classify", f"""
WITH {_SPLIT},
d AS (SELECT te.vec_id AS qid, tr.vec_id AS pid, tr.label AS lab, list_distance(te.v, tr.v) AS dist FROM te, tr),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, pid) AS rk FROM d),
votes AS (SELECT qid, lab, count(*) AS c FROM r WHERE rk <= 5 GROUP BY ALL)
SELECT qid AS vec_id, CAST(min(lab) FILTER (WHERE c = mc) AS INTEGER) AS prediction
FROM (SELECT *, max(c) OVER (PARTITION BY qid) AS mc FROM votes) GROUP BY qid""")
def q_e05_knn_classify(spark, sf):
    e = table(spark, sf, "embeddings")
    sp = prep.stratified_split(e, "label", "vec_id", 0.2, 42)
    train = sp.where(F.col("split") == "train").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    test = sp.where(F.col("split") == "test").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    out = neighbors.knn_classify(train, test, 5, label="label", vec="v", key="id")
    return out.select(F.col("id").alias("vec_id"), F.col("prediction").cast("int").alias("prediction"))


def _toxic_features(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars",
                                               F.size(F.split(F.trim("text"), r"\s+")).cast("double").alias("n_words"))
    return table(spark, sf, "labels").join(docs, "doc_id").select(F.col("doc_id").cast("string").alias("key"),
                                                                  F.col("n_chars").cast("double").alias("n_chars"),
                                                                  "n_words", F.col("toxic").cast("string").alias("toxic"))


@register("l09_smote")
def q_l09_smote(spark, sf):
    return sampling.smote(_toxic_features(spark, sf), "toxic", "key", ["n_chars", "n_words"])


@register("l10_adasyn")
def q_l10_adasyn(spark, sf):
    return sampling.adasyn(_toxic_features(spark, sf), "toxic", "key", ["n_chars", "n_words"])


@register("l11_smote_tomek")
def q_l11_smote_tomek(spark, sf):
    return sampling.smote_tomek(_toxic_features(spark, sf), "toxic", "key", ["n_chars", "n_words"])
