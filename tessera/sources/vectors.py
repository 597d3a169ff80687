"""Vector collections (S13-S16): a named Parquet table (id, document, embedding, ...)
under a shared root, kept as numbered segments of added rows and deleted ids; writes append a
segment and never rewrite one. One writer at a time per collection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import preview

COLLECTION_SCHEMA = "id string, document string, embedding array<float>"


def as_collection(df: DataFrame, id_col: str, text_col: str, vec_col: str | None = None, extra=()) -> DataFrame:
    """Shape any table as a collection: id (string), document, embedding (optional)."""
    cols = [F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("document")]
    if vec_col:
        cols.append(F.col(vec_col).cast("array<float>").alias("embedding"))
    return df.select(*cols, *[F.col(c) for c in extra])


def with_ids(df: DataFrame) -> DataFrame:
    """Keep given ids, assign a UUID where none is given."""
    if "id" not in df.columns:
        return df.withColumn("id", F.expr("uuid()"))
    return df.withColumn("id", F.coalesce(F.col("id").cast("string"), F.expr("uuid()")))


def _segments(spark: SparkSession, root: str, name: str) -> list[tuple[int, str, str]]:
    """(number, kind, path) of the finished segments of a collection, oldest first, listed
    through Hadoop's file system, so the root may be on any store that Spark reads."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    out = []
    for status in fs.listStatus(base):
        path = status.getPath()
        number, _, kind = path.getName().partition("-")
        kind = kind.partition("-")[0]
        # a writer that died leaves a folder without the success mark
        if kind in ("add", "del", "clear") and fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            out.append((int(number), kind, path.toString()))
    return sorted(out, key=lambda s: (s[0], s[2]))


def get_or_create(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a named collection, or an empty one: every added segment since the
    last clearing, without the rows that a later segment deletes."""
    segments = _segments(spark, root, name)
    start = max((i for i, s in enumerate(segments) if s[1] == "clear"), default=-1) + 1
    rows = gone = None
    for number, kind, path in segments[start:]:
        part = spark.read.parquet(path).withColumn("_seq", F.lit(number))
        if kind == "add":
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        else:
            gone = part if gone is None else gone.unionByName(part)
    if rows is None:
        return spark.createDataFrame([], COLLECTION_SCHEMA)
    if gone is not None:
        last = gone.groupBy(F.col("id").alias("_id")).agg(F.max("_seq").alias("_del"))
        rows = rows.join(last, (F.col("id") == F.col("_id")) & (F.col("_seq") < F.col("_del")), "left_anti")
    return rows.drop("_seq")


def _next_segment(spark: SparkSession, root: str, name: str, kind: str) -> str:
    segments = _segments(spark, root, name)
    number = segments[-1][0] + 1 if segments else 1
    return f"{root}/{name}/{number:08d}-{kind}-{uuid.uuid4().hex[:8]}"


def add_documents(spark: SparkSession, root: str, name: str, docs: DataFrame) -> str:
    """Append the rows as one segment (ids assigned); earlier rows are not rewritten."""
    out = _next_segment(spark, root, name, "add")
    with_ids(docs).write.parquet(out)
    return out


def delete_ids(coll: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not in ``ids`` (anti join; ids may be large)."""
    return coll.join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_anti")


def delete_documents(spark: SparkSession, root: str, name: str, ids: DataFrame) -> str:
    """Record the ids as deleted; rows added later under the same id stay."""
    out = _next_segment(spark, root, name, "del")
    ids.select(F.col("id").cast("string").alias("id")).distinct().write.parquet(out)
    return out


def clear(spark: SparkSession, root: str, name: str) -> str:
    out = _next_segment(spark, root, name, "clear")
    spark.createDataFrame([], "id string").write.parquet(out)
    return out


def collection_stats(coll: DataFrame, n: int = 5) -> DataFrame:
    """First n ids (by id) with a 100-character preview, and the total count."""
    total = coll.count()
    head = coll.orderBy("id").limit(n).select("id", preview("document", 100).alias("preview"))
    return head.withColumn("n_total", F.lit(total).cast("long"))
