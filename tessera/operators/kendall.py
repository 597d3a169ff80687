"""Kendall tau-b (T11) without enumerating pairs.

For one column pair, rows are (x, y) with y replaced by its dense rank r in [0, m).
Two rows i, j with x_i < x_j are concordant when r_i < r_j. Writing ranks in binary,
r_i < r_j exactly when, at the highest bit where they differ (level b), r_i has 0 and
r_j has 1 - and then both share the prefix r >> (b + 1). So

    concordant = sum over levels b, prefixes p, values x of
                 (# rows with prefix p, bit b = 0, x' < x) * (# rows with prefix p, bit b = 1, x' = x)

and discordant swaps the bits. Each row appears once per level (m <= 2^B, B levels), the
(level, prefix, x) cells are aggregated (hot values collapse into one cell), and the
"x' < x" counts are exclusive running sums from ``ordered_prefix``: an O(n log m)
distributed plan; no pair is ever materialised. Ties in x are excluded by the strict
order of the prefix, ties in y by the bit split. tau-b and its p-value follow from these
counts: exact where nothing is tied and n is small, else the tie-corrected normal approximation.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from .order import ordered_prefix


def _num(c: str):
    x = F.col(c).cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def kendall_tau_b(df: DataFrame, pairs) -> DataFrame:
    """(col_a, col_b, n, r, p_value) for each column pair, pairwise-complete rows."""
    spark = df.sparkSession
    items = [F.struct(F.lit(f"{a}\u0001{b}").alias("pair"), _num(a).alias("x"), _num(b).alias("y")) for a, b in pairs]
    long = (df.select(F.inline(F.array(*items))).where(F.col("x").isNotNull() & F.col("y").isNotNull())
            .persist(StorageLevel.MEMORY_AND_DISK))
    # dense rank of y within each pair (distinct values, cumulative count)
    ydist = long.groupBy("pair", "y").agg(F.count(F.lit(1)).alias("ny"))
    yr, ymax = ordered_prefix(ydist.select("pair", "y"), ["y"], ["pair"])
    levels = {k[0]: max(1, int(m - 1).bit_length()) for k, m in ymax.items()}
    bits = F.element_at(F.create_map(*[x for p, b in levels.items() for x in (F.lit(p), F.lit(b))]), F.col("pair"))
    ranked = long.join(yr.select("pair", "y", F.col("_start").alias("r")), ["pair", "y"])
    lv = ranked.select("pair", "x", "r", F.explode(F.sequence(F.lit(0), bits - 1)).alias("lev"))
    cell = (lv.select("pair", "lev", F.expr("shiftright(r, lev + 1)").alias("pre"), "x",
                      F.expr("shiftright(r, lev) % 2").alias("bit"))
            .groupBy("pair", "lev", "pre", "x")
            .agg(F.sum(F.when(F.col("bit") == 0, 1).otherwise(0)).cast("long").alias("c0"),
                 F.sum(F.when(F.col("bit") == 1, 1).otherwise(0)).cast("long").alias("c1")))
    pref, _ = ordered_prefix(cell, ["x"], ["pair", "lev", "pre"], sum_cols=["c0", "c1"], collect_totals=False)
    cd = pref.groupBy("pair").agg((F.sum(F.col("_cum_c0") * F.col("c1")) - F.sum(F.col("_cum_c1") * F.col("c0")))
                                  .alias("s"))

    def ties(col):
        t = long.groupBy("pair", col).agg(F.count(F.lit(1)).cast("double").alias("t"))
        return t.groupBy("pair").agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"{col}_tie"),
                                     F.sum(F.col("t") * (F.col("t") - 1) * (F.col("t") - 2)).alias(f"{col}_t0"),
                                     F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias(f"{col}_t1"),
                                     F.sum("t").alias("n"))

    tx, ty = ties("x"), ties("y").drop("n")
    stats = {r["pair"]: r for r in cd.join(tx, "pair").join(ty, "pair").collect()}
    rows = []
    for a, b in pairs:
        r = stats.get(f"{a}\u0001{b}")
        if r is None:
            rows.append((a, b, 0, None, 1.0))
            continue
        n = int(r["n"])
        tot = n * (n - 1) / 2.0
        s = float(r["s"])
        den = math.sqrt((tot - r["x_tie"]) * (tot - r["y_tie"])) if n > 1 else 0.0
        tau = s / den if den > 0 else None
        p = 1.0
        if tau is not None and n >= 3:
            var = ((n * (n - 1) * (2 * n + 5) - r["x_t1"] - r["y_t1"]) / 18.0
                   + 2.0 * r["x_tie"] * r["y_tie"] / (n * (n - 1))
                   + r["x_t0"] * r["y_t0"] / (9.0 * n * (n - 1) * (n - 2)))
            p = special.norm_sf2(s / math.sqrt(var)) if var > 0 else 1.0
            discordant = round((tot - s) / 2)
            if not r["x_tie"] and not r["y_tie"] and (n <= 33 or min(discordant, tot - discordant) <= 1):
                p = special.kendall_exact_p(n, discordant)  # scipy's rule for the exact distribution
        rows.append((a, b, n, tau, p))
    return spark.createDataFrame(rows, "col_a string, col_b string, n long, r double, p_value double")
