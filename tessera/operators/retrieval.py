"""Retrieval (F13, J5, K6, X1-X4) and conversation operators.

Exact cosine top-k: queries go in blocks of at most BLOCK_CELLS numbers; a block's matrix
travels with the task closure; each Arrow batch of the collection is scored with one matrix product and only
the batch-local top k per query leaves Python. The final top k per query is a
``row_number <= k`` window, which Spark plans as a partial group limit before the shuffle,
so even one query over the whole collection never gathers more than k rows per task.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import chunk_array, has_marker, strip_think
from ..session import ensure_checkpoint_dir

BLOCK_CELLS = 4_000_000  # query count x dimensions shipped with each task (32 MB of doubles)


def chunk_documents(df: DataFrame, id_col: str, text_col: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """One row per chunk: id '<doc>-<pos>', doc id, chunk_index, chunk."""
    ch = df.select(F.col(id_col).alias("doc_id"), F.inline(chunk_array(F.col(text_col), size, overlap)))
    return ch.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("id"),
                     "doc_id", F.col("pos").alias("chunk_index"), "chunk")


def centroids(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean vector per key (distributed: posexplode -> avg by (key, pos) -> ordered array)."""
    ex = df.select(F.col(key).alias("key"), F.posexplode(vec).alias("pos", "v"))
    avg = ex.groupBy("key", "pos").agg(F.avg("v").alias("v"))
    return avg.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("pv")).select(
        "key", F.transform("pv", lambda s: s["v"]).alias("vector"))


def topk_cosine(queries: DataFrame, collection: DataFrame, k: int = 3, query_id: str = "query_id",
                query_vec: str = "vector", id_col: str = "id", vec_col: str = "embedding",
                extra_cols=()) -> DataFrame:
    """(query_id, rank, id, distance, similarity, *extra) - the k nearest rows of
    ``collection`` per query by cosine distance 1 - cos (ties by id); fewer when the
    collection is smaller (n = min(k, count)). Rows and queries without a vector, or with the
    zero vector, have no cosine and take no part.

    Any number of queries: they stream to the driver, and every full block is scored in
    one pass over the collection; with several blocks each result (k rows a query) is
    written to the shared folder before the next."""
    spark = collection.sparkSession
    extra = list(extra_cols)
    has_direction = F.exists("emb", lambda v: v != 0)
    src = collection.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).alias("emb"), *extra).where(has_direction)
    q = queries.select(F.col(query_id).cast("string").alias("qid"), F.col(query_vec).alias("emb")).where(has_direction)
    block, done = [], []
    for row in q.toLocalIterator():
        if block and (len(block) + 1) * len(row["emb"]) > BLOCK_CELLS:
            done.append(_written(_score_block(block, src, k, extra)))
            block = []
        block.append(row)
    if block:
        last = _score_block(block, src, k, extra)
        done.append(_written(last) if done else last)
    if not done:
        hits = T.StructType.fromDDL("query_id string, rank int, id string, distance double, similarity double")
        return spark.createDataFrame([], T.StructType(hits.fields + [src.schema[c] for c in extra]))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _written(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared folder and read back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/topk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _score_block(rows, src: DataFrame, k: int, extra) -> DataFrame:
    """Top k of one block of queries."""
    qids = [r["qid"] for r in rows]
    qmat = np.array([r["emb"] for r in rows], dtype=np.float64)
    qunit = qmat / np.linalg.norm(qmat, axis=1)[:, None]
    extra_fields = [src.schema[c] for c in extra]
    schema = T.StructType([T.StructField("qi", T.IntegerType()), T.StructField("id", T.StringType()),
                           T.StructField("distance", T.DoubleType())] + extra_fields)

    def score(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            emb = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["emb"]])
            en = np.linalg.norm(emb, axis=1)
            sims = (qunit @ emb.T) / en[None, :]
            dist = 1.0 - sims
            kk = min(k, dist.shape[1])
            ids = pdf["id"].to_numpy()
            out = []
            for qi in range(dist.shape[0]):
                d = dist[qi]
                # candidates: everything tied with the k-th distance, then exact order by (distance, id)
                if kk < len(d):
                    kth = np.partition(d, kk - 1)[kk - 1]
                    cand = np.flatnonzero(d <= kth)
                else:
                    cand = np.arange(len(d))
                order = sorted(cand, key=lambda j: (d[j], ids[j]))[:kk]
                sel = pd.DataFrame({"qi": qi, "id": ids[order], "distance": d[order]})
                for c in extra:
                    sel[c] = pdf[c].to_numpy()[order]
                out.append(sel)
            yield pd.concat(out, ignore_index=True)

    part = src.mapInPandas(score, schema)
    w = Window.partitionBy("qi").orderBy("distance", "id")
    top = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    qmap = F.element_at(F.array(*[F.lit(x) for x in qids]), F.col("qi") + 1)
    return top.select(qmap.alias("query_id"), F.col("rank").cast("int").alias("rank"), "id", "distance",
                      F.greatest(F.lit(0.0), 1.0 - F.col("distance")).alias("similarity"), *extra)


def concat_context(hits: DataFrame, text_col: str = "document", sep: str = "\n\n---\n\n",
                   empty: str = "No relevant documents found.") -> DataFrame:
    """Per query, the hit texts in rank order joined by ``sep`` (k items per query)."""
    agg = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", text_col))).alias("h"))
    return agg.select("query_id", F.coalesce(F.nullif(F.array_join(F.transform("h", lambda s: s[text_col]), sep),
                                                      F.lit("")), F.lit(empty)).alias("context"))


def last_turns(conv: DataFrame, n: int = 10) -> DataFrame:
    """Per conversation the last ``n`` turns, then assistant turns carrying a system
    marker are dropped (take last n first, filter second)."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = conv.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    return last.where(~((F.col("role") == "assistant") & has_marker(F.col("text"))))


def recent_assistant_text(conv: DataFrame, n: int = 6, sep: str = "\n\n") -> DataFrame:
    """Last ``n`` assistant messages per conversation, think-blocks removed, joined in order."""
    a = conv.where(F.col("role") == "assistant")
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    a = a.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    agg = a.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", strip_think("text").alias("t")))).alias("m"))
    return agg.select("conv_id", F.array_join(F.transform("m", lambda s: s["t"]), sep).alias("text"))


def markdown_blocks(conv: DataFrame) -> DataFrame:
    """One Markdown block per turn (role heading, cleaned content, rule). Written in
    (conv_id, turn) order the blocks form each conversation's export."""
    head = F.when(F.col("role") == "user", F.lit("User")).otherwise(F.lit("Assistant"))
    block = F.concat(F.lit("### "), head, F.lit("\n\n"), strip_think("text"), F.lit("\n\n---\n"))
    return conv.select("conv_id", "turn", block.alias("block"))


def write_markdown(conv: DataFrame, path: str) -> None:
    """S18 sink: one directory per conversation, blocks in turn order. Range partitioning
    on (conv_id, turn) splits even a huge conversation over several tasks; its part
    files, read in part-number order, are in turn order."""
    parts = max(1, int(conv.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (markdown_blocks(conv).repartitionByRange(parts, "conv_id", "turn").sortWithinPartitions("conv_id", "turn")
     .select("conv_id", "block").write.mode("overwrite").partitionBy("conv_id").text(path))


def data_summary_text(df: DataFrame, max_cols: int = 15) -> str:
    """X5 helper: 'Dataset: R rows x C columns' plus the first ``max_cols`` columns with
    their types (one count job; the text is bin-sized)."""
    n = df.count()
    cols = ", ".join(f"{f.name} ({f.dataType.simpleString()})" for f in df.schema.fields[:max_cols])
    return f"Dataset: {n} rows x {len(df.columns)} columns\nColumns: {cols}"


def assemble_prompts(questions: DataFrame, contexts: DataFrame, summary: str) -> DataFrame:
    """Per question the prompt = data summary, retrieved passages, question.
    ``questions``: (query_id, question); ``contexts``: (query_id, context) from X2."""
    q = questions.join(contexts, "query_id", "left")
    return q.select("query_id", F.concat_ws("\n\n", F.lit(summary),
                                           F.concat(F.lit("Relevant passages:\n"), F.coalesce("context", F.lit(""))),
                                           F.concat(F.lit("Question: "), F.col("question"))).alias("prompt"))
