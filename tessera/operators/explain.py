"""Model explanation (M12): sampled Shapley values (Strumbelj & Kononenko, 2014).

For each explained row x, S samples are drawn: a feature permutation and a background
row z (both from hashes of (row, sample, seed)). For feature j of a sample, two
hybrid rows are built - features preceding j in the permutation taken from x, the rest
from z, with j from x or from z - and the model output difference is that sample's
contribution of j. Everything is one exploded DataFrame (rows x samples x features x 2)
scored by a single ``model.transform``; contributions are averaged with a group-by.
Within a sample the contributions telescope to f(x) - f(z), so the Shapley values of a
row sum exactly to f(x) minus the mean output over its sampled backgrounds.

The reference explains the first 100 test rows against 100 background rows; both are
parameters here (explained rows are the first ``n_rows`` by key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sampled_shapley(model, output_col: str, explain: DataFrame, background: DataFrame, key: str,
                    features: Sequence[str], n_rows: int = 100, n_background: int = 100, n_samples: int = 64,
                    seed: int = 42, other_cols: Sequence[str] = ()) -> DataFrame:
    """(row key, feature, shap, base) - ``output_col`` is a scalar model output column
    (for a classifier, e.g. the positive-class probability extracted in ``model``)."""
    features = list(features)
    d = len(features)
    rows = explain.orderBy(key).limit(n_rows).select(F.col(key).alias("_row"), *[F.col(f).alias(f"x_{f}") for f in features],
                                                     *other_cols)
    bg = (background.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))))
          .orderBy("_h", key).limit(n_background)
          # n_background rows after the limit: a window over them is tiny
          .withColumn("_b", F.row_number().over(Window.orderBy("_h", key)) - 1)
          .select("_b", *[F.col(f).alias(f"z_{f}") for f in features]))
    n_found = max(1, bg.count())  # fewer than asked for in a small table
    # samples: permutation keys per feature and a background index from hashes
    s = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("_s"))
    s = s.withColumn("_b", F.pmod(F.xxhash64("_row", "_s", F.lit(seed)), F.lit(n_found)).cast("int"))
    s = s.join(F.broadcast(bg), "_b")
    prio = [F.xxhash64("_row", "_s", F.lit(seed), F.lit(f)) for f in features]
    for i, f in enumerate(features):
        s = s.withColumn(f"_p_{f}", prio[i])
    # one hybrid pair per (sample, feature j): features with priority < p_j come from x
    ex = s.select("*", F.explode(F.array(*[F.lit(f) for f in features])).alias("_feat"))
    pj = F.element_at(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f"_p_{f}"))]), F.col("_feat"))
    ex = ex.withColumn("_pj", pj)
    ex = ex.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_with"))
    cols = []
    for f in features:
        from_x = (F.col(f"_p_{f}") < F.col("_pj")) | ((F.col("_feat") == f) & (F.col("_with") == 1))
        cols.append(F.when(from_x, F.col(f"x_{f}")).otherwise(F.col(f"z_{f}")).alias(f))
    first = (F.col("_pj") == F.least(*[F.col(f"_p_{f}") for f in features])) if d > 1 else F.lit(True)
    hybrid = ex.select("_row", "_s", "_feat", "_with", first.alias("_is_first"), *cols, *other_cols)
    scored = model.transform(hybrid).select("_row", "_s", "_feat", "_with", "_is_first",
                                            F.col(output_col).cast("double").alias("_y"))
    delta = scored.groupBy("_row", "_s", "_feat").agg(
        (F.sum(F.when(F.col("_with") == 1, F.col("_y"))) - F.sum(F.when(F.col("_with") == 0, F.col("_y")))).alias("_d"))
    shap = delta.groupBy("_row", "_feat").agg(F.avg("_d").alias("shap"))
    # base value: model output on the sampled backgrounds (the all-from-z hybrid of
    # each sample: first feature of its permutation, without it)
    base = (scored.where(F.col("_is_first") & (F.col("_with") == 0))
            .groupBy("_row").agg(F.avg("_y").alias("base")))
    return shap.join(base, "_row").select(F.col("_row").alias(key), F.col("_feat").alias("feature"), "shap", "base")
