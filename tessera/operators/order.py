"""Distributed global order without a single-partition window.

``Window.orderBy`` with no partition key plans ``SinglePartition``: every row goes to
one task. The helpers here give each row (or each weighted block of rows) its global
position inside its group instead:

1. ``repartitionByRange`` on (group, order) - the same shuffle a global ``orderBy``
   does; range bounds are sampled, so a hot group/value is split across partitions
   as long as the order key is unique (callers add a tie-break key, or aggregate to
   distinct values first so every row is unique).
2. ``sortWithinPartitions`` then a per-partition running sum. Unweighted positions
   stay in the JVM (``monotonically_increasing_id`` after the sort numbers rows in
   order); weighted and multi-column running sums use a vectorised ``mapInPandas``
   pass (a JVM window would need a second shuffle).
3. The per-(partition, group) totals - at most ``partitions + groups`` rows - become
   exclusive offsets that are joined back: as a broadcast while they are few, else by a
   window over the totals and a shuffled join.

The intermediate is persisted (MEMORY_AND_DISK). Recomputation after executor loss is
deterministic: range bounds are sampled with a fixed seed from deterministic input
splits and the within-partition order is total.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import col_of
from ..session import default_partitions

BROADCAST_ROWS = 200_000  # offset rows (partitions + groups) up to which they are broadcast


def ordered_prefix(df: DataFrame, order_cols: Sequence[str | Column], group_cols: Sequence[str] = (),
                   weight_col: str | None = None, num_partitions: int | None = None,
                   sum_cols: Sequence[str] = (), collect_totals: bool = True, with_total: bool = False):
    """Add ``_start`` = total weight of rows before this one (0-based) inside its group,
    and ``_w`` = the row's weight. For every column in ``sum_cols`` also add
    ``_cum_<col>`` = the exclusive running sum of that column in the same order (one
    pass for several running sums). Returns ``(df_with_start, group_totals)`` where
    ``group_totals`` maps a group tuple to its total weight (bin-sized, on the driver).

    With ``collect_totals=False`` (any number of groups, e.g. one per distinct value)
    ``group_totals`` is None; ``with_total`` adds each row's group total as ``_total``.
    """
    spark = df.sparkSession
    parts = num_partitions or default_partitions(spark)
    gcols = [F.col(c) for c in group_cols]
    okeys = [col_of(c) for c in order_cols]
    if weight_col is None and not sum_cols:
        return _row_positions(df, gcols, okeys, list(group_cols), parts, collect_totals, with_total)
    w = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    base = df.withColumn("_w", w)
    sums = ["_w", *sum_cols]
    ranged = (base.repartitionByRange(parts, *gcols, *okeys)
              .sortWithinPartitions(*gcols, *okeys)
              .withColumn("_pid", F.spark_partition_id()))
    out_schema = T.StructType(ranged.schema.fields + [T.StructField(f"_b{i}", T.LongType(), False)
                                                      for i in range(len(sums))])
    gnames = list(group_cols)

    def local_prefix(batches):
        carry_key = None
        carry = [0] * len(sums)
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                yield pdf.assign(**{f"_b{i}": pd.Series([], dtype="int64") for i in range(len(sums))})
                continue
            if gnames:
                g = pdf[gnames].astype(object)
                g = g.where(g.notna(), "\x00null")
                change = (g != g.shift()).any(axis=1).to_numpy()
                first_key = tuple(g.iloc[0].tolist())
                cont_first = carry_key is not None and first_key == carry_key
                last_key = tuple(g.iloc[-1].tolist())
            else:
                change = np.zeros(n, dtype=bool)
                cont_first = carry_key is not None
                last_key = ()
            change[0] = not cont_first
            starts = np.maximum.accumulate(np.where(change, np.arange(n), 0))
            first_seg = starts == 0
            last_start = starts[-1]
            cols = {}
            for i, c in enumerate(sums):
                wv = pdf[c].fillna(0).to_numpy(dtype=np.int64)
                excl = np.cumsum(wv) - wv
                before = excl - excl[starts]
                if cont_first:
                    before[first_seg] += carry[i]
                carry[i] = int(before[last_start] + wv[last_start:].sum())
                cols[f"_b{i}"] = before.astype(np.int64)
            carry_key = last_key
            yield pdf.assign(**cols)

    local = ranged.mapInPandas(local_prefix, out_schema).persist(StorageLevel.MEMORY_AND_DISK)
    parts_of = local.groupBy("_pid", *gnames).agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)])
    offsets, totals = _offsets(parts_of, gnames, len(sums), collect_totals)
    res = _join_offsets(local, offsets, gnames).withColumn("_start", F.col("_o0") + F.col("_b0"))
    for i, c in enumerate(sum_cols, start=1):
        res = res.withColumn(f"_cum_{c}", F.col(f"_o{i}") + F.col(f"_b{i}"))
    res = res.drop("_pid", *[f"_o{i}" for i in range(len(sums))], *[f"_b{i}" for i in range(len(sums))])
    return (res if with_total else res.drop("_total")), totals


def _offsets(parts_of: DataFrame, gnames, n_sums: int, collect_totals: bool):
    """(offsets, group totals) from one row of sums per (partition, group): columns _pid,
    groups, _o<i> = the sum of _t<i> over the group's earlier partitions, _total = the
    group's whole first sum. Up to BROADCAST_ROWS rows they are added up on the driver and
    broadcast; more stay a table, added up by a window per group and joined by a shuffle."""
    spark = parts_of.sparkSession
    kept = [c for c in parts_of.columns if c == "_first"]
    head = parts_of.limit(BROADCAST_ROWS + 1).collect()
    if len(head) > BROADCAST_ROWS:
        whole = Window.partitionBy(*gnames)
        earlier = whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        table = parts_of.select("_pid", *gnames, *kept, F.sum("_t0").over(whole).cast("long").alias("_total"), *[
            F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).cast("long").alias(f"_o{i}") for i in range(n_sums)])
        if not collect_totals:
            return table, None
        sums = parts_of.groupBy(*gnames).agg(F.sum("_t0").alias("_t")).collect()
        return table, {tuple(r[g] for g in gnames): int(r["_t"] or 0) for r in sums}
    acc: dict[tuple, list[int]] = defaultdict(lambda: [0] * n_sums)
    rows = []
    for r in sorted(head, key=lambda r: r["_pid"]):
        key = tuple(r[g] for g in gnames)
        rows.append(((r["_pid"], *key, *[r[c] for c in kept]), key, acc[key]))
        acc[key] = [had + int(r[f"_t{i}"] or 0) for i, had in enumerate(acc[key])]
    rows = [(*row, acc[key][0], *before) for row, key, before in rows]
    schema = T.StructType([T.StructField("_pid", T.IntegerType(), False)] + [parts_of.schema[c] for c in (*gnames, *kept)]
                          + [T.StructField(c, T.LongType(), False) for c in ("_total", *[f"_o{i}" for i in range(n_sums)])])
    return F.broadcast(spark.createDataFrame(rows, schema)), ({k: v[0] for k, v in acc.items()} if collect_totals else None)


def _join_offsets(local, offsets, gnames):
    """Rows with the offsets of their (partition, group); a null group is a group."""
    renamed = offsets.withColumnsRenamed({c: f"_j{i}" for i, c in enumerate(["_pid", *gnames])})
    same = local["_pid"] == renamed["_j0"]
    for i, g in enumerate(gnames, 1):
        same = same & local[g].eqNullSafe(renamed[f"_j{i}"])
    return local.join(renamed, same).drop(*[f"_j{i}" for i in range(len(gnames) + 1)])


_LOCAL_BITS = 33  # monotonically_increasing_id = partition index << 33 | row index in partition


def _row_positions(df: DataFrame, gcols, okeys, gnames, parts, collect_totals, with_total):
    """Unweighted ``ordered_prefix`` without Python: after the range shuffle and the local
    sort, ``monotonically_increasing_id`` numbers rows in sorted order inside each
    partition (its upper bits are the partition index). The first local index and the
    row count of every (partition, group) - partitions + groups rows - give the offsets."""
    mid = F.monotonically_increasing_id()
    local = (df.withColumn("_w", F.lit(1).cast("long"))
             .repartitionByRange(parts, *gcols, *okeys).sortWithinPartitions(*gcols, *okeys)
             .withColumn("_mid", mid)
             .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS).cast("int"))
             .withColumn("_loc", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), _LOCAL_BITS))
             .drop("_mid").persist(StorageLevel.MEMORY_AND_DISK))
    parts_of = local.groupBy("_pid", *gnames).agg(F.count(F.lit(1)).alias("_t0"), F.min("_loc").alias("_first"))
    offsets, totals = _offsets(parts_of, gnames, 1, collect_totals)
    res = (_join_offsets(local, offsets, gnames)
           .withColumn("_start", F.col("_o0") - F.col("_first") + F.col("_loc")).drop("_pid", "_loc", "_o0", "_first"))
    return (res if with_total else res.drop("_total")), totals


def label_pairs(labels: DataFrame, order_col: str, above: bool = False) -> DataFrame:
    """Every ordered pair of rows of ``labels`` as columns (a, b, ...) of structs; with ``above``
    only pairs in which b comes after a. The pairs are the result wanted (a grid); they are
    made by spreading each row over the positions of its partners and an equality join, so
    any number of labels stays distributed."""
    names = labels.columns
    pos, _ = ordered_prefix(labels, [order_col], collect_totals=False)
    pos = pos.select(F.struct(*names).alias("a"), F.col("_start").alias("_p"))
    last = pos.agg(F.max("_p")).first()[0]
    if last is None or (above and last == 0):
        return pos.select("a", F.col("a").alias("b")).limit(0)
    first = F.col("_p") + 1 if above else F.lit(0).cast("long")
    spread = (pos.where(F.col("_p") < last) if above else pos).select(
        "a", F.explode(F.sequence(first, F.lit(last).cast("long"))).alias("_p"))
    return spread.join(pos.withColumnRenamed("a", "b"), "_p").drop("_p")


# ---------------------------------------------------------------------------
# numpy-exact linear quantiles from order statistics
# ---------------------------------------------------------------------------

def _np_lerp(a: float, b: float, t: float) -> float:
    """numpy's ``_lerp`` (the form used by ``np.percentile(method='linear')``)."""
    a = np.float64(a)
    b = np.float64(b)
    t = np.float64(t)
    diff = b - a
    if t >= 0.5:
        return float(b - diff * (np.float64(1.0) - t))
    return float(a + diff * t)


def linear_quantile_plan(n: int, qs: Sequence[float]):
    """For ``np.percentile(x, qs*100)`` over n sorted values: list of
    (prev_index, next_index, gamma) - the order statistics needed and the weight."""
    q = np.true_divide(np.asarray(qs, dtype=np.float64) * 100.0, 100)
    vi = (n - 1) * q
    plan = []
    for v in vi:
        if v >= n - 1:
            plan.append((n - 1, n - 1, 0.0))
        elif v < 0:
            plan.append((0, 0, 0.0))
        else:
            p = np.floor(v)
            plan.append((int(p), int(p) + 1, float(v - p)))
    return plan


def linear_quantiles_from_stats(plan, value_at) -> list[float]:
    return [_np_lerp(value_at(p), value_at(nx), g) for p, nx, g in plan]


def pandas_qcut_index_edges(n: int, n_bins: int) -> list[float]:
    """Edges pandas' ``qcut(range(n), n_bins)`` uses (before duplicate removal)."""
    qs = np.linspace(0, 1, n_bins + 1)
    return linear_quantiles_from_stats(linear_quantile_plan(n, qs), lambda i: float(i))


def dedupe_edges(edges: Sequence[float]) -> list[float]:
    """``duplicates='drop'`` of pandas cut/qcut (order kept; kept as is for 2 edges)."""
    if len(edges) == 2:
        return list(edges)
    out = []
    for e in edges:
        if not out or e != out[-1]:
            if e not in out:
                out.append(e)
    return out


def searchsorted_bin(x: Column, edges: Sequence[float], include_lowest: bool) -> Column:
    """1-based right-closed bin of x over literal edges, as pandas' cut/qcut assign it:
    ``count(edges < x)``; x equal to the first edge goes to bin 1 with ``include_lowest``;
    outside the edges → null."""
    arr = F.array(*[F.lit(float(e)) for e in edges])
    cnt = F.size(F.filter(arr, lambda e: e < x))
    k = len(edges) - 1
    if include_lowest:
        cnt = F.when(x == F.lit(float(edges[0])), F.lit(1)).otherwise(cnt)
    return F.when(x.isNull() | (cnt == 0) | (cnt > k), F.lit(None).cast("int")).otherwise(cnt.cast("int"))
