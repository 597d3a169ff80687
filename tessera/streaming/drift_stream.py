"""ST1: PSI per tumbling event-time window of a stream against fixed baseline edges.

The stream is binned on the driver-fixed baseline edges (a literal array). ``foreachBatch`` adds
each micro-batch's counts per (window, bin) to a ledger, a table in the shared checkpoint
folder with one folder a batch, which a repeated batch overwrites: every row counts once, in
the window of its event time, however late it comes. The ledger also says how many rows of a
cell came later than the delay allows (behind the latest event time of earlier batches), and
the PSI per window is a batch query over its sums, so windows still open when the run stops
are reported too. No state is kept between batches beside the ledger; it has a row a cell and
batch. The query is restartable from its checkpoint.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions.exprs import PSI_ELSE, PSI_LADDER, count_edges, ladder
from ..operators.binning import quantile_edges_from_distinct
from ..operators.order import dedupe_edges
from ..session import ensure_checkpoint_dir


def baseline_edges(baseline: DataFrame, value_col: str, bins: int = 10) -> list[float]:
    """Quantile edges of the baseline (pandas qcut), duplicates dropped, ends opened."""
    v = F.col(value_col).cast("double")
    dist = (baseline.select(F.lit(value_col).alias("feature"), v.alias("value"))
            .where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("feature", "value")
            .agg(F.count(F.lit(1)).alias("n")))
    raw = quantile_edges_from_distinct(dist, bins)
    if value_col not in raw:
        raise ValueError("empty baseline")
    es = dedupe_edges(raw[value_col][0])
    if len(es) < 2:
        raise ValueError("constant baseline")
    return [float("-inf"), *es[1:-1], float("inf")]


def _bin(value, edges):
    return (1 + count_edges(value, edges[1:-1])).cast("int")


def stream_psi(spark: SparkSession, source: DataFrame, baseline: DataFrame, value_col: str = "value",
               ts_col: str = "ts", window: str = "1 day", watermark: str = "1 hour", bins: int = 10,
               work_dir: str | None = None, with_late: bool = False) -> DataFrame:
    """Run the streaming aggregation to completion (``availableNow``) and return
    (window_start, window_end, n_actual, psi, stability) per event-time window; ``with_late``
    adds n_late, the rows that came more than ``watermark`` behind.

    ``source`` is a streaming DataFrame (``spark.readStream...``) holding ``ts_col`` and
    ``value_col``.
    """
    edges = baseline_edges(baseline, value_col, bins)
    k = len(edges) - 1
    root = work_dir or os.path.join(ensure_checkpoint_dir(spark), f"stream-psi-{uuid.uuid4().hex[:12]}")
    out_path, ckpt = os.path.join(root, "counts"), os.path.join(root, "checkpoint")
    old_tz = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        ev = (source.select(F.col(ts_col).cast("timestamp").alias("ts"), F.col(value_col).cast("double").alias("v"))
              .where(F.col("v").isNotNull() & ~F.isnan("v") & F.col("ts").isNotNull()))

        def sink(batch: DataFrame, batch_id: int) -> None:
            session = batch.sparkSession
            try:
                seen = session.read.parquet(out_path).where(F.col("batch_id") < batch_id).agg(F.max("top")).first()[0]
            except AnalysisException:  # the first batch
                seen = None
            behind = F.lit(False) if seen is None else F.col("ts") < F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {watermark}")
            (batch.groupBy(F.window("ts", window).alias("w"), _bin(F.col("v"), edges).alias("bin_id"))
             .agg(F.count(F.lit(1)).alias("cnt"), F.count_if(behind).alias("late"), F.max(F.col("ts").cast("timestamp_ntz")).alias("top"))
             .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                     "bin_id", "cnt", "late", "top")
             .write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}"))

        q = (ev.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        try:
            counts = spark.read.parquet(out_path)
        except AnalysisException:  # no micro-batch produced output
            return spark.createDataFrame([], "window_start timestamp_ntz, window_end timestamp_ntz, n_actual long, "
                                             "psi double" + ", n_late long" * with_late + ", stability string")
        latest = (counts.groupBy("window_start", "window_end", "bin_id")
                  .agg(F.sum("cnt").alias("cnt"), F.sum("late").alias("late")))
        bv = baseline.select(F.col(value_col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
        base_counts = bv.groupBy(_bin(F.col("v"), edges).alias("bin_id")).agg(F.count(F.lit(1)).alias("e"))
        dim = spark.createDataFrame([(i,) for i in range(1, k + 1)], "bin_id int")
        base = dim.join(base_counts, "bin_id", "left").select("bin_id", F.coalesce("e", F.lit(0)).alias("e"))
        n_base = sum(r["e"] for r in base.collect())
        base = base.withColumn("e_pct", (F.col("e") + 0.5) / F.lit(n_base + 0.5 * k))
        # every (window, bin) cell: each window expands to its k bins (no cartesian join)
        cells = (latest.select("window_start", "window_end").distinct()
                 .select("window_start", "window_end", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("bin_id")))
        full = (cells.join(latest, ["window_start", "window_end", "bin_id"], "left")
                .join(F.broadcast(base), "bin_id")
                .withColumn("cnt", F.coalesce("cnt", F.lit(0))))
        w = Window.partitionBy("window_start")
        full = full.withColumn("n_actual", F.sum("cnt").over(w))
        full = full.withColumn("a_pct", (F.col("cnt") + 0.5) / (F.col("n_actual") + 0.5 * k))
        full = full.withColumn("comp", (F.col("a_pct") - F.col("e_pct")) * F.log(F.col("a_pct") / F.col("e_pct")))
        res = full.groupBy("window_start", "window_end").agg(F.first("n_actual").cast("long").alias("n_actual"),
                                                             F.sum("comp").alias("psi"),
                                                             *([F.sum("late").cast("long").alias("n_late")] if with_late else ()))
        return res.withColumn("stability", ladder(F.col("psi"), PSI_LADDER, PSI_ELSE))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old_tz)


def events_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A file stream over one table in any store: a directory source, filtered to the table's file if it is
    one (streaming sources take directories; new files matching the name are picked up)."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
