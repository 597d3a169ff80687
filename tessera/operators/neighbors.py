"""Exact k-nearest-neighbour join (J6, J7, and the SMOTE family).

1. Duplicates collapse: points are grouped by vector (multiplicity + the k+1 smallest ids,
   taken with a per-vector row limit), queries by vector. A vector shared by a third
   of the rows is one row from here on. Vectors get numbers, fixed by a checkpoint.
2. Cells: a k-d tree cuts the space at medians of some vectors (about 64 a cell, chosen by
   their hash). They only balance the cells; every vector is put in one, whatever they were.
3. Home cells: each query is compared with the points of its own cell. The distance at which
   their multiplicities reach k (+1 when a query may meet itself) is an upper bound r on its
   true k-th neighbour distance (infinite where the cell is too thin).
4. Other cells: a query goes to every cell whose box is within r, and meets only points
   within r there. The k nearest by (distance, id) of all cells are kept with
   ``row_number() <= k`` (a partial group limit).

A task compares a chunk of queries with one cell, as matrices of bounded size; the points of a cell
go to each of its chunks. Distances that decide anything are summed up dimension by dimension.
With few dimensions a query meets a handful of cells. With many, boxes do not prune and every
query meets every cell: the work is that of all pairs, but as matrix products, in even tasks, and
with ``BLOCK`` numbers at most on each side.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_partitions, ensure_checkpoint_dir

BLOCK = 4_000_000  # numbers in a task's matrix
SOME = 8192  # points that give a query without a limit its first one
FEW = 8  # dimensions up to which differences are taken one by one


class Cells:
    """A k-d tree: leaf numbers of vectors, and the leaves within a distance of each."""

    def __init__(self, some: np.ndarray, n_cells: int):
        self.dim, self.cut, self.left, self.leaf, self.n = [], [], [], [], 0
        self._grow(some, max(0, math.ceil(math.log2(max(n_cells, 1)))))

    def _grow(self, some: np.ndarray, levels: int) -> None:
        """Breadth first, so that children of a node are neighbours."""
        todo, at = [(some, levels)], 0
        while at < len(todo):
            x, levels = todo[at]
            at += 1
            spread = x.max(0) - x.min(0) if len(x) > 1 else np.zeros(1)
            j = int(spread.argmax())
            if levels and spread[j] > 0:
                cut = float(np.sort(x[:, j])[(len(x) - 1) // 2])
                if cut >= x[:, j].max():  # more than half are the greatest
                    cut = float(x[x[:, j] < cut, j].max())
                on = x[:, j] <= cut
                self.dim.append(j)
                self.cut.append(cut)
                self.left.append(len(todo))
                self.leaf.append(-1)
                todo += [(x[on], levels - 1), (x[~on], levels - 1)]
            else:
                for col, v in ((self.dim, -1), (self.cut, 0.0), (self.left, 0), (self.leaf, self.n)):
                    col.append(v)
                self.n += 1

    def of(self, x: np.ndarray) -> np.ndarray:
        dim, cut, left, leaf = (np.array(c) for c in (self.dim, self.cut, self.left, self.leaf))
        node, row = np.zeros(len(x), np.int64), np.arange(len(x))
        while (on := dim[node] >= 0).any():
            node = np.where(on, left[node] + (x[row, np.maximum(dim[node], 0)] > cut[node]), node)
        return leaf[node]

    def within(self, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of x, leaves): every leaf whose box is at most r away."""
        limit = r * r * (1 + 1e-9)
        rows, leaves, todo = [], [], [(0, np.arange(len(x)), {})]
        while todo:
            node, at, box = todo.pop()
            if not len(at):
                continue
            if (j := self.dim[node]) < 0:
                rows.append(at)
                leaves.append(np.full(len(at), self.leaf[node]))
                continue
            lo, hi = box.get(j, (-np.inf, np.inf))
            for child, ends in ((self.left[node], (lo, self.cut[node])), (self.left[node] + 1, (self.cut[node], hi))):
                inner = {**box, j: ends}
                away = sum(np.maximum(np.maximum(a - x[at, i], x[at, i] - b), 0) ** 2 for i, (a, b) in inner.items())
                todo.append((child, at[away <= limit[at]], inner))
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def nearest(q: np.ndarray, p: np.ndarray, need: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of p, distance), by row and distance: of each q the ``need`` nearest p within its limit, and
    those as far as the last of them."""
    found = []
    step = max(1, BLOCK // max(1, len(p)))
    middle = p.mean(0)
    pc = p - middle
    pp = (pc * pc).sum(1)
    for a in range(0, len(q), step):
        x = q[a:a + step]
        lim = limit[a:a + step] ** 2
        if q.shape[1] <= FEW:
            far = np.zeros((len(x), len(p)))
            for j in range(q.shape[1]):
                diff = x[:, j, None] - p[:, j]
                diff *= diff
                far += diff
            slack = lim * 1e-12
        else:
            xc = x - middle
            xx = (xc * xc).sum(1)
            far = xc @ pc.T
            far *= -2
            far += xx[:, None]
            far += pp
            slack = 1e-11 * (xx + pp.max()) + np.where(np.isfinite(lim), lim * 1e-12, 0)
        top = lim.copy()
        if need < len(p):
            wide = np.flatnonzero(~np.isfinite(lim))  # without a limit: the need-th nearest of some is one
            if len(wide):
                top[wide] = np.partition(far[wide, :max(need, SOME)], need - 1, axis=1)[:, need - 1]
        row, col = np.nonzero(far <= (top + np.where(np.isfinite(slack), slack, 0))[:, None])
        total = np.zeros(len(row))
        for j in range(q.shape[1]):
            diff = x[row, j] - p[col, j]
            total += diff * diff
        dist = np.sqrt(total)
        on = dist <= limit[a:a + step][row]
        row, col, dist = row[on], col[on], dist[on]
        order = np.lexsort((dist, row))
        row, col, dist = row[order], col[order], dist[order]
        begin = np.searchsorted(row, np.arange(len(x)))
        last = begin[row] + need - 1
        inside = np.minimum(last, len(row) - 1)
        same = (last < len(row)) & (row[inside] == row)
        on = ~same | (dist <= dist[inside])
        found.append((row[on] + a, col[on], dist[on]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def reached(row: np.ndarray, dist: np.ndarray, mult: np.ndarray, need: int, n: int) -> np.ndarray:
    """Of each of n rows, the distance at which the multiplicities reach ``need``, else infinity."""
    out = np.full(n, np.inf)
    total = np.cumsum(mult)
    begin = np.searchsorted(row, np.arange(n))
    before = np.append(0, total)[begin]
    enough = np.flatnonzero(total - before[row] >= need)
    np.minimum.at(out, row[enough], dist[enough])
    return out


def knn_join(queries: DataFrame, points: DataFrame, k: int, qid: str = "qid", pid: str = "pid", vec: str = "v",
             exclude_self: bool = False, target_cell: int | None = None) -> DataFrame:
    """(qid, pid, distance, rank) - the k nearest points of every query (ties by pid).
    With ``exclude_self`` a point whose id equals the query id is skipped (self-join).
    Vectors that are null or hold a null have no neighbours; those of other lengths are not compared."""
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)

    def whole(df, id_, name, as_id):
        df = df.select(F.col(id_).alias(as_id), F.col(vec).cast("array<double>").alias(name))
        return df.where((F.size(name) > 0) & ~F.exists(name, lambda x: x.isNull()))

    P, Q = whole(points, pid, "v", "pid"), whole(queries, qid, "u", "qid")
    need = k + (1 if exclude_self else 0)
    # 1. duplicates collapse (bounded per vector: need ids at most)
    rk = F.row_number().over(Window.partitionBy("v").orderBy("pid"))
    reps = P.withColumn("_r", rk).where(F.col("_r") <= need).groupBy("v").agg(F.array_sort(F.collect_list("pid")).alias("reps"))
    mult = P.groupBy("v").agg(F.count(F.lit(1)).alias("mult"))
    PV = mult.join(reps, "v").withColumn("vid", F.monotonically_increasing_id()).checkpoint()
    QV = Q.select("u").distinct().withColumn("uid", F.monotonically_increasing_id()).checkpoint()
    sizes = sorted((r[0], r[1]) for r in PV.groupBy(F.size("v")).count().collect())
    if not sizes:
        kind = {c: d.schema[c].dataType.simpleString() for c, d in (("qid", Q), ("pid", P))}
        return spark.createDataFrame([], f"qid {kind['qid']}, pid {kind['pid']}, distance double, rank int")
    near = [_near(QV.where(F.size("u") == d), PV.where(F.size("v") == d), d, n, need, target_cell) for d, n in sizes]
    # ids of the vectors found; the nearest by (distance, id) of every query vector
    per = (reduce(DataFrame.union, near).join(PV.select("vid", "reps"), "vid")
           .select("uid", "dist", F.explode("reps").alias("pid")))
    wk = Window.partitionBy("uid").orderBy("dist", "pid")
    per = per.withColumn("_rk", F.row_number().over(wk)).where(F.col("_rk") <= need).drop("_rk")
    # query rows; drop self
    res = Q.join(QV, "u").select("qid", "uid").join(per, "uid")
    if exclude_self:
        res = res.where(F.col("pid") != F.col("qid"))
    wq = Window.partitionBy("qid").orderBy("dist", "pid")
    res = res.withColumn("rank", F.row_number().over(wq)).where(F.col("rank") <= k)
    return res.select("qid", "pid", F.col("dist").alias("distance"), F.col("rank").cast("int").alias("rank"))


def _near(QV: DataFrame, PV: DataFrame, d: int, n_vec: int, need: int, target_cell: int | None) -> DataFrame:
    """(uid, vid, dist) with the nearest points of every query vector among them."""
    spark = PV.sparkSession
    block = max(1, BLOCK // d)
    cores = spark.sparkContext.defaultParallelism
    n_cells = math.ceil(n_vec / (target_cell or min(block, 512 << min(d, 20))))
    # 2. some vectors by their hash, for the cuts alone
    n_some = max(1, min(n_vec, 64 * n_cells, block))
    some = PV.where(F.pmod(F.xxhash64("v"), F.lit(n_vec)) < n_some).select("v").toPandas()["v"] if n_cells > 1 else []
    cells = Cells(np.stack(some.to_list()) if len(some) else np.zeros((1, d)), n_cells)

    def home(v: pd.Series) -> pd.Series:
        return pd.Series(cells.of(np.stack(v.to_list())) if len(v) else np.zeros(0), dtype="int64")

    home = F.pandas_udf(home, "long")
    PC = PV.select("vid", "v", "mult", home("v").alias("cell")).persist(StorageLevel.MEMORY_AND_DISK)
    QC = QV.select("uid", "u", home("u").alias("cell")).persist(StorageLevel.MEMORY_AND_DISK)

    def met(asked: DataFrame) -> DataFrame:
        """asked: (uid, u, r, cell) -> (uid, vid, dist, reach) of points of that cell within r."""
        counts = {r[0]: r[1] for r in asked.groupBy("cell").count().collect()}  # one row a cell
        rows = max(4096, min(block, math.ceil(sum(counts.values()) / (2 * cores * max(1, len(counts))))))
        n_chunks = {c: math.ceil(n / rows) for c, n in counts.items()}
        n_keys = sum(n_chunks.values())
        parts = max(1, min(n_keys, max(4 * cores, default_partitions(spark))))
        chunks = spark.createDataFrame(list(n_chunks.items()), "cell long, chunks long")
        q = (asked.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("uid"), "chunks"))
             .select("cell", "chunk", "uid", "u", "r").repartition(parts, "cell", "chunk"))
        p = (PC.join(F.broadcast(chunks), "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
             .select("cell", "chunk", "vid", "v", "mult").repartition(parts, "cell", "chunk"))

        def compare(asking: pa.Table, there: pa.Table) -> pa.Table:
            names = ["uid", "vid", "dist", "reach"]
            if not asking.num_rows or not there.num_rows:
                return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
            uid, vid, mult = asking["uid"].to_numpy(), there["vid"].to_numpy(), there["mult"].to_numpy()
            row, col, dist = nearest(matrix(asking["u"]), matrix(there["v"]), need, asking["r"].to_numpy())
            reach = reached(row, dist, mult[col], need, len(uid))[row]
            on = dist <= reach
            return pa.table([uid[row[on]], vid[col[on]], dist[on], reach[on]], names=names)

        return q.groupBy("cell", "chunk").cogroup(p.groupBy("cell", "chunk")).applyInArrow(
            compare, "uid long, vid long, dist double, reach double")

    # 3. the own cell -> bound r
    inf = F.lit(float("inf"))
    first = met(QC.withColumn("r", inf)).persist(StorageLevel.MEMORY_AND_DISK)
    if cells.n == 1:
        return first.select("uid", "vid", "dist")
    bound = first.groupBy("uid").agg(F.min("reach").alias("r"))

    # 4. other cells that can hold a point within r
    def spread(batches):
        for b in batches:
            if not b.num_rows:
                continue
            r = b.column("r").to_numpy(zero_copy_only=False)
            row, leaf = cells.within(matrix(b.column("u")), r)
            other = leaf != b.column("cell").to_numpy()[row]
            at = pa.array(row[other])
            yield pa.RecordBatch.from_arrays([b.column("uid").take(at), pa.array(r[row[other]]), pa.array(leaf[other].astype(np.int64))],
                                             names=["uid", "r", "cell"])

    asked = QC.join(bound, "uid", "left").select("uid", "u", "cell", F.coalesce("r", inf).alias("r"))
    to = asked.mapInArrow(spread, "uid long, r double, cell long").persist(StorageLevel.MEMORY_AND_DISK)
    more = met(to.join(QC.select("uid", "u"), "uid"))
    return first.select("uid", "vid", "dist").union(more.select("uid", "vid", "dist"))


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5, label: str = "label", vec: str = "v",
                 key: str = "id", weights: str = "uniform") -> DataFrame:
    """kNN vote (uniform or 1/distance weights; exact-distance hits win outright);
    ties between classes go to the smallest label. Returns (id, prediction)."""
    nn = knn_join(test.select(F.col(key).alias("qid"), F.col(vec).alias("v")),
                  train.select(F.col(key).alias("pid"), F.col(vec).alias("v")), k)
    lab = train.select(F.col(key).alias("pid"), F.col(label).alias("lab"))
    j = nn.join(lab, "pid")
    if weights == "distance":
        zero = j.where(F.col("distance") == 0).select("qid").distinct().withColumn("_z", F.lit(True))
        j = j.join(zero, "qid", "left").withColumn(
            "w", F.when(F.col("_z"), F.when(F.col("distance") == 0, 1.0).otherwise(0.0))
            .otherwise(1.0 / F.col("distance")))
    else:
        j = j.withColumn("w", F.lit(1.0))
    votes = j.groupBy("qid", "lab").agg(F.sum("w").alias("score"))
    best = votes.groupBy("qid").agg(F.min_by("lab", F.struct(-F.col("score"), F.col("lab"))).alias("prediction"))
    return best.withColumnRenamed("qid", key)
