"""Synthetic over-sampling (L9-L11): SMOTE, ADASYN and SMOTE + Tomek-link removal.

Every minority class is raised to the majority count. Neighbours come from the exact
``knn_join`` (k = 5 within the class, excluding the row itself). Which rows seed the
synthetic samples and which neighbour / interpolation step each uses are derived from
hashes of (key, replica, seed), so results are reproducible:
row i of a class (in md5 order) seeds floor(G / n) or floor(G / n) + 1 samples, the
neighbour is pmod(hash, k) + 1 and the step is a hash-derived uniform in [0, 1).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .neighbors import knn_join
from .order import ordered_prefix

_MASK53 = (1 << 53) - 1


def _vec(features):
    return F.array(*[F.col(c).cast("double") for c in features])


def _uniform(*cols):
    return F.pmod(F.xxhash64(*cols), F.lit(_MASK53 + 1)).cast("double") / F.lit(float(1 << 53))


def _kept(df: DataFrame, label: str, key: str, features: Sequence[str]) -> DataFrame:
    """The columns used, checkpointed: the neighbour joins read them many times."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.select(*dict.fromkeys([key, *features, label])).checkpoint()


def _class_counts(df, label):
    return {r[0]: r[1] for r in df.groupBy(F.col(label).cast("string")).count().collect()}


def _generate(rows: DataFrame, nn: DataFrame, pts: DataFrame, k: int, seed: int, features, label_value) -> DataFrame:
    """rows: (key, v, reps) -> synthetic (key, v) rows interpolated toward neighbours."""
    ex = rows.select("key", "v", F.explode(F.sequence(F.lit(0), F.col("reps") - 1)).alias("j")).where(F.col("reps") > 0)
    ex = ex.withColumn("rank", (F.pmod(F.xxhash64("key", "j", F.lit(seed)), F.lit(k)) + 1).cast("int"))
    ex = ex.withColumn("step", _uniform("key", "j", F.lit(seed), F.lit("step")))
    j = (ex.join(nn.select(F.col("qid").alias("key"), "rank", "pid"), ["key", "rank"])
         .join(pts.select(F.col("key").alias("pid"), F.col("v").alias("nv")), "pid"))
    newv = F.zip_with("v", "nv", lambda a, b: a + F.col("step") * (b - a))
    out = j.select(F.concat(F.lit("syn-"), F.col("key"), F.lit("-"), F.col("j").cast("string")).alias("key"),
                   newv.alias("v"))
    return out.withColumn("_label", F.lit(label_value))


def _replicas(cls_rows: DataFrame, n_new: int, seed: int) -> DataFrame:
    n = cls_rows.count()
    if n == 0 or n_new <= 0:
        return cls_rows.withColumn("reps", F.lit(0))
    base, extra = divmod(n_new, n)
    h = cls_rows.withColumn("_h", F.md5(F.concat(F.col("key"), F.lit(f"-{seed}"))))
    pref, _ = ordered_prefix(h, ["_h", "key"])
    return pref.withColumn("reps", (F.lit(base) + F.when(F.col("_start") < extra, 1).otherwise(0)).cast("int")).drop(
        "_h", "_start", "_w")


def _finish(df, label, key, features, synth_parts):
    orig = df.select(F.col(key).cast("string").alias(key), *[F.col(c).cast("double") for c in features],
                     F.col(label).cast("string").alias(label))
    if not synth_parts:
        return orig
    syn = synth_parts[0]
    for s in synth_parts[1:]:
        syn = syn.unionByName(s)
    syn = syn.select(F.col("key").alias(key), *[F.col("v")[i].alias(c) for i, c in enumerate(features)],
                     F.col("_label").alias(label))
    return orig.unionByName(syn)


def smote(df: DataFrame, label: str, key: str, features: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """SMOTE to the majority count for every minority class."""
    features = list(features)
    df = _kept(df, label, key, features)
    counts = _class_counts(df, label)
    top = max(counts.values())
    parts = []
    for cls, n in counts.items():
        if n >= top or n < 2:
            continue
        kk = min(k, n - 1)
        pts = df.where(F.col(label).cast("string") == cls).select(F.col(key).cast("string").alias("key"),
                                                                   _vec(features).alias("v"))
        nn = knn_join(pts.withColumnRenamed("key", "qid"), pts.withColumnRenamed("key", "pid"), kk, exclude_self=True)
        rows = _replicas(pts, top - n, seed)
        parts.append(_generate(rows, nn, pts, kk, seed, features, cls))
    return _finish(df, label, key, features, parts)


def adasyn(df: DataFrame, label: str, key: str, features: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """ADASYN - per minority row, samples in proportion to the share of other-class
    rows among its k nearest neighbours over all rows (rounded), neighbours for the
    interpolation from its own class."""
    features = list(features)
    df = _kept(df, label, key, features)
    counts = _class_counts(df, label)
    top = max(counts.values())
    allp = df.select(F.col(key).cast("string").alias("key"), _vec(features).alias("v"),
                     F.col(label).cast("string").alias("lab"))
    parts = []
    for cls, n in counts.items():
        if n >= top or n < 2:
            continue
        kk = min(k, n - 1)
        pts = allp.where(F.col("lab") == cls).select("key", "v")
        nn_all = knn_join(pts.withColumnRenamed("key", "qid"), allp.select(F.col("key").alias("pid"), "v"), k,
                          exclude_self=True)
        ratio = (nn_all.join(allp.select(F.col("key").alias("pid"), "lab"), "pid")
                 .groupBy("qid").agg((F.sum(F.when(F.col("lab") != cls, 1).otherwise(0)) / F.lit(float(k))).alias("r")))
        tot = ratio.agg(F.sum("r")).first()[0] or 0.0
        if tot == 0:
            continue
        g = float(top - n)
        reps = ratio.select(F.col("qid").alias("key"), F.rint(F.col("r") / F.lit(tot) * F.lit(g)).cast("int").alias("reps"))
        rows = pts.join(reps, "key", "left").withColumn("reps", F.coalesce("reps", F.lit(0)))
        nn = knn_join(pts.withColumnRenamed("key", "qid"), pts.withColumnRenamed("key", "pid"), kk, exclude_self=True)
        parts.append(_generate(rows, nn, pts, kk, seed, features, cls))
    return _finish(df, label, key, features, parts)


def tomek_links(df: DataFrame, label: str, key: str, features: Sequence[str]) -> DataFrame:
    """Pairs of rows of different classes that are each other's nearest neighbour."""
    p = df.select(F.col(key).cast("string").alias("key"), _vec(features).alias("v"), F.col(label).cast("string").alias("lab"))
    nn = knn_join(p.select(F.col("key").alias("qid"), "v"), p.select(F.col("key").alias("pid"), "v"), 1,
                  exclude_self=True)
    a = nn.select("qid", "pid")
    mutual = a.alias("x").join(a.alias("y"), (F.col("x.qid") == F.col("y.pid")) & (F.col("x.pid") == F.col("y.qid")))
    lab = p.select("key", "lab")
    m = (mutual.select(F.col("x.qid").alias("a"), F.col("x.pid").alias("b"))
         .join(lab.withColumnRenamed("key", "a").withColumnRenamed("lab", "la"), "a")
         .join(lab.withColumnRenamed("key", "b").withColumnRenamed("lab", "lb"), "b"))
    return m.where(F.col("la") != F.col("lb")).select("a", "b")


def smote_tomek(df: DataFrame, label: str, key: str, features: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """SMOTE, then both members of every Tomek link are removed. The rows made are checkpointed: the
    neighbour join reads them many times, and their plan would be in it as often."""
    ensure_checkpoint_dir(df.sparkSession)
    res = smote(df, label, key, features, k, seed).checkpoint()
    links = tomek_links(res, label, key, features)
    drop = links.select(F.col("a").alias(key)).union(links.select(F.col("b").alias(key))).distinct()
    return res.join(drop, key, "left_anti")
