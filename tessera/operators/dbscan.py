"""DBSCAN (E14), exact.

1. Identical vectors collapse to one row with a multiplicity (a hot duplicate is one row).
2. Up to three features: a grid whose cells are so small that all points of a cell are within eps
   of each other. Points of a cell with min_samples rows are core. Only the others, fewer than
   min_samples a cell, are compared with the points of the cells around.
3. Core points of a cell are in one cluster, so clusters are connected components of cells. Two cells
   are joined by a pair of core points within eps: looked for among one point of each part of a
   cell, in ever smaller parts, then, for cells not yet in one cluster, among all points of
   those parts that are near enough. Pairs of points are never kept.
4. More features: all pairs within eps, found by an equi-join on grid cells of the first three,
   are the edges between core vectors; they grow with the square of a dense region.
5. Components: minimum-label propagation with pointer jumping, checkpointed to the session's
   checkpoint dir every round, until no label changes.
6. Cluster numbers follow scikit-learn's discovery order (by the smallest row key of
   a cluster's core points); a border row joins the smallest-numbered adjacent cluster;
   everything else is noise (-1).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .order import ordered_prefix


def _dist(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def _by_pairs(vec: DataFrame, g: int, eps: float, min_samples: int):
    """(labels of core vectors, their border): over all pairs within eps."""
    vec = vec.withColumn("cell", F.array(*[F.floor(F.col("v")[j] / F.lit(eps)).cast("long") for j in range(g)]))
    # neighbour cells: the 3^g offsets of each vector's own cell
    offs = vec.select("vid", "v", "cell")
    for j in range(g):
        offs = offs.withColumn(f"o{j}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    offs = offs.select("vid", "v", F.array(*[F.col("cell")[j] + F.col(f"o{j}") for j in range(g)]).alias("ncell"))
    other = vec.select(F.col("vid").alias("nid"), F.col("v").alias("nv"), F.col("cell").alias("ncell"), "mult")
    edges = (offs.join(other, "ncell").where(_dist(F.col("v"), F.col("nv")) <= F.lit(eps))
             .select("vid", "nid", "mult").persist(StorageLevel.MEMORY_AND_DISK))
    deg = edges.groupBy("vid").agg(F.sum("mult").alias("deg"))
    core = deg.where(F.col("deg") >= min_samples).select("vid").persist(StorageLevel.MEMORY_AND_DISK)
    core_edges = (edges.join(core, "vid").join(core.withColumnRenamed("vid", "nid"), "nid")
                  .where(F.col("vid") != F.col("nid")).select("vid", "nid").persist(StorageLevel.MEMORY_AND_DISK))

    def border_of(core_cluster: DataFrame) -> DataFrame:
        return (edges.join(core_cluster.withColumnRenamed("vid", "nid"), "nid")
                .join(core, "vid", "left_anti").groupBy("vid").agg(F.min("cluster").alias("cluster")))

    return _components(core, core_edges), border_of


def _components(core: DataFrame, core_edges: DataFrame) -> DataFrame:
    """(vid, lab): the least vid of each one's component; edges (vid, nid) in both directions."""
    lab = core.withColumn("lab", F.col("vid"))
    it = 0
    while True:
        it += 1
        nb = core_edges.join(lab.withColumnRenamed("vid", "nid").withColumnRenamed("lab", "nlab"), "nid") \
            .groupBy("vid").agg(F.min("nlab").alias("m"))
        new = lab.join(nb, "vid", "left").select("vid", F.least("lab", F.coalesce("m", F.col("lab"))).alias("lab"))
        # pointer jumping: take the label of your label
        jump = new.select(F.col("vid").alias("lab"), F.col("lab").alias("lab2"))
        new = new.join(jump, "lab", "left").select("vid", F.least("lab", F.coalesce("lab2", F.col("lab"))).alias("lab"))
        # a reliable checkpoint every round: each round references the previous labels
        # twice, so an uncut logical plan would double in size per round
        new = new.checkpoint(eager=True)
        changed = new.join(lab.withColumnRenamed("lab", "old"), "vid").where(F.col("lab") != F.col("old")).limit(1).count()
        lab.unpersist()
        lab = new
        if changed == 0:
            break
    return lab


def _parts(v, n: int, side: float):
    return F.transform(v, lambda x: F.floor(x / F.lit(side / n)).cast("long"))


def _by_cells(vec: DataFrame, d: int, eps: float, min_samples: int):
    """(labels of core vectors, their border): by cells whose points are all within eps of each other."""
    side = eps / math.sqrt(d) * (1 - 1e-6)
    pts = vec.select("vid", "v", "mult", _parts(F.col("v"), 1, side).alias("cell")).persist(StorageLevel.MEMORY_AND_DISK)
    around = [o for o in product(range(-2, 3), repeat=d)]  # eps is less than two cells

    def moved(offsets):
        arr = F.array(*[F.array(*[F.lit(x).cast("long") for x in o]) for o in offsets])
        return F.explode(F.transform(arr, lambda o: F.zip_with("cell", o, lambda a, b: a + b)))

    dense = pts.groupBy("cell").agg(F.sum("mult").alias("mass")).where(F.col("mass") >= min_samples).select("cell")
    sparse = pts.join(dense, "cell", "left_anti").persist(StorageLevel.MEMORY_AND_DISK)
    other = pts.select(F.col("v").alias("nv"), F.col("cell").alias("ncell"), F.col("mult").alias("nmult"))
    close = _dist(F.col("v"), F.col("nv")) <= F.lit(eps)
    met = sparse.select("vid", "v", moved(around).alias("ncell")).join(other, "ncell").where(close)
    enough = met.groupBy("vid").agg(F.sum("nmult").alias("deg")).where(F.col("deg") >= min_samples).select("vid")
    some = sparse.join(enough, "vid", "left_semi").select("vid", "v", "cell")
    core = pts.join(dense, "cell", "left_semi").select("vid", "v", "cell").unionByName(some).checkpoint()

    nodes = core.groupBy("cell").agg(F.min("vid").alias("node")).checkpoint()
    there = nodes.select(F.col("cell").alias("ncell"), F.col("node").alias("nnode"))
    half = [o for o in around if o > (0,) * d]
    pairs = nodes.select("cell", "node", moved(half).alias("ncell")).join(there, "ncell")
    edges, lab, n = None, nodes.select(F.col("node").alias("vid"), F.col("node").alias("lab")), 1

    def joined(found: DataFrame) -> DataFrame:
        nonlocal edges
        both = F.explode(F.array(F.struct(F.col("node").alias("vid"), F.col("nnode").alias("nid")),
                                 F.struct(F.col("nnode").alias("vid"), F.col("node").alias("nid")))).alias("e")
        found = found.select("node", "nnode").distinct().select(both).select("e.*")
        edges = (found if edges is None else edges.unionByName(found)).checkpoint()
        return _components(nodes.select(F.col("node").alias("vid")), edges)

    def apart() -> DataFrame:
        a, b = (lab.select(F.col("vid").alias(x), F.col("lab").alias(f"lab_{x}")) for x in ("node", "nnode"))
        return pairs.join(a, "node").join(b, "nnode").where(F.col("lab_node") != F.col("lab_nnode")).select("cell", "node", "ncell", "nnode").checkpoint()

    for n in (4, 16, 64):
        pairs = apart()
        if pairs.isEmpty():
            break
        one = core.groupBy("cell", _parts(F.col("v"), n, side).alias("part")).agg(F.min("v").alias("v")).drop("part")
        two = one.select(F.col("cell").alias("ncell"), F.col("v").alias("nv"))
        lab = joined(pairs.join(one, "cell").join(two, "ncell").where(close))
    else:
        pairs = apart()
        if not pairs.isEmpty():
            parts = core.select("cell", "v", _parts(F.col("v"), n, side).alias("part")).join(
                pairs.select(F.explode(F.array("cell", "ncell")).alias("cell")).distinct(), "cell", "left_semi")
            each = parts.select("cell", "part").distinct()
            gap = F.aggregate(F.zip_with("part", "npart", lambda a, b: F.greatest(F.abs(a - b) - 1, F.lit(0)) * F.lit(side / n)),
                              F.lit(0.0), lambda acc, x: acc + x * x)
            far = each.select(F.col("cell").alias("ncell"), F.col("part").alias("npart"))
            near = pairs.join(each, "cell").join(far, "ncell").where(gap <= F.lit(eps * eps * (1 + 1e-6)))
            end = parts.select(F.col("cell").alias("ncell"), F.col("part").alias("npart"), F.col("v").alias("nv"))
            lab = joined(near.join(parts, ["cell", "part"]).join(end, ["ncell", "npart"]).where(close))

    def border_of(core_cluster: DataFrame) -> DataFrame:
        inner = core.join(core_cluster, "vid").select(F.col("v").alias("nv"), F.col("cell").alias("ncell"), "cluster")
        rest = sparse.join(core, "vid", "left_anti").select("vid", "v", moved(around).alias("ncell"))
        return rest.join(inner, "ncell").where(close).groupBy("vid").agg(F.min("cluster").alias("cluster"))

    of_cell = nodes.join(lab, F.col("node") == F.col("vid")).select("cell", "lab")
    return core.join(of_cell, "cell").select("vid", "lab"), border_of


def dbscan(df: DataFrame, key: str, features: Sequence[str], eps: float = 0.5, min_samples: int = 5,
           grid_dims: int = 3) -> DataFrame:
    """(key, cluster) - cluster -1 is noise; rows without a key or a feature are left out."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    features = list(features)
    g = max(1, min(grid_dims, len(features)))
    known = df.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    pts = known.dropna().select("_key", F.array(*[f"_x{i}" for i in range(len(features))]).alias("v"))
    vec = pts.groupBy("v").agg(F.count(F.lit(1)).alias("mult"), F.min("_key").alias("vid")).persist(StorageLevel.MEMORY_AND_DISK)
    if len(features) <= min(grid_dims, 3):
        lab, border_of = _by_cells(vec, len(features), eps, min_samples)
    else:
        lab, border_of = _by_pairs(vec, g, eps, min_samples)
    # cluster numbers in order of each cluster's smallest core key
    firsts = lab.groupBy("lab").agg(F.min("vid").alias("first"))
    ranked, _ = ordered_prefix(firsts, ["first"])  # distributed rank; no single-partition window
    num = ranked.select("lab", F.col("_start").cast("int").alias("cluster"))
    core_cluster = lab.join(num.select("lab", "cluster"), "lab").select("vid", "cluster")
    # border: non-core vectors next to a core vector take the smallest adjacent cluster
    vlab = core_cluster.unionByName(border_of(core_cluster))
    out = pts.join(vec.select("v", "vid"), "v").join(vlab, "vid", "left")
    return out.select(F.col("_key").alias(key), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))
