"""Text, conversation and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import retrieval
from ..sources import vectors
from .q_profile import LI_NULLS_SQL, lineitem_nulls
from .registry import register
from .tables import round_doubles, table

# Python's str.strip() whitespace set, as literal characters shared by both engines
_PY_WS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
_WS_CLASS = "[" + _PY_WS + "]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS_CLASS}+|{_WS_CLASS}+$', '', 'g')"


def _think_sql(x: str) -> str:
    return _strip_sql(f"regexp_replace({x}, '<think>.*?</think>', '', 'gs')")


def _intent_sql(x: str) -> str:
    parts = []
    for label, words in tx.INTENT_RULES:
        cond = " OR ".join(f"contains(lower({x}), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + " ELSE NULL END"


def _marker_sql(x: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in tx.SYSTEM_MARKERS) + ")"


@register("f07_strip_think", f"SELECT conv_id, turn, {_think_sql('text')} AS text FROM conversations")
def q_f07_strip_think(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tx.strip_think("text").alias("text"))


@register("f08_strip_code_fence",
          "SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^```(?:json)?\\s*', ''), '\\s*```$', '') AS text "
          "FROM conversations")
def q_f08_strip_code_fence(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tx.strip_code_fence("text").alias("text"))


@register("f09_json_extract", """
SELECT event_id, CAST(json_extract_string(regexp_extract(props, '\\{[\\s\\S]*\\}', 0), '$.k') AS BIGINT) AS k,
       regexp_extract(props, '\\{[\\s\\S]*\\}', 0) <> '' AS has_json FROM events""")
def q_f09_json_extract(spark, sf):
    e = table(spark, sf, "events")
    j = tx.outer_json("props")
    return e.select("event_id", F.get_json_object(j, "$.k").cast("long").alias("k"), (j != "").alias("has_json"))


@register("f12_intent_tag", f"SELECT conv_id, turn, {_intent_sql('text')} AS intent FROM conversations")
def q_f12_intent_tag(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tx.intent_tag("text").alias("intent"))


@register("w06_last_turns", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, turn, role, text FROM r WHERE rn <= 10 AND NOT (role = 'assistant' AND {_marker_sql('text')})""")
def q_w06_last_turns(spark, sf):
    return retrieval.last_turns(table(spark, sf, "conversations"), 10).select("conv_id", "turn", "role", "text")


@register("w06_recent_assistant", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'assistant')
SELECT conv_id, string_agg({_think_sql('text')}, '\n\n' ORDER BY turn) AS text FROM r WHERE rn <= 6 GROUP BY conv_id""")
def q_w06_recent_assistant(spark, sf):
    return retrieval.recent_assistant_text(table(spark, sf, "conversations"), 6)


@register("s18_markdown_blocks", f"""
SELECT conv_id, turn, concat('### ', CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END, '\n\n',
       {_think_sql('text')}, '\n\n---\n') AS block FROM conversations""")
def q_s18_markdown_blocks(spark, sf):
    return retrieval.markdown_blocks(table(spark, sf, "conversations"))


@register("x01_chunk_documents", """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents),
s AS (SELECT doc_id, text, n, unnest(CASE WHEN n <= 500 THEN [0] ELSE range(0, n, 450) END) AS st FROM d)
SELECT concat(CAST(doc_id AS VARCHAR), '-', CAST(st // 450 AS VARCHAR)) AS id, doc_id, CAST(st // 450 AS INTEGER) AS chunk_index,
       CASE WHEN n <= 500 THEN text ELSE substring(text, st + 1, 500) END AS chunk FROM s""")
def q_x01_chunk_documents(spark, sf):
    return retrieval.chunk_documents(table(spark, sf, "documents"), "doc_id", "text", 500, 50)


_CENTROID_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT label, generate_subscripts(v, 1) AS pos, unnest(v) AS val FROM e),
c AS (SELECT label, list(a ORDER BY pos) AS cv FROM (SELECT label, pos, avg(val) AS a FROM x GROUP BY ALL) GROUP BY label),
d AS (SELECT CAST(c.label AS VARCHAR) AS query_id, CAST(e.vec_id AS VARCHAR) AS id,
             1 - list_dot_product(c.cv, e.v) / (sqrt(list_dot_product(c.cv, c.cv)) * sqrt(list_dot_product(e.v, e.v))) AS distance
      FROM c, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rk FROM d)"""


def _centroid_hits(spark, sf, k=3, with_text=False):
    emb = table(spark, sf, "embeddings")
    q = retrieval.centroids(emb, "label", "embedding").withColumnRenamed("key", "query_id")
    coll = emb
    extra = ()
    if with_text:
        docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("document"))
        coll = emb.join(docs, "vec_id")
        extra = ("document",)
    return retrieval.topk_cosine(q, coll, k=k, id_col="vec_id", vec_col="embedding", extra_cols=extra)


@register("j05_topk_cosine", _CENTROID_SQL + """
SELECT query_id, CAST(rk AS INTEGER) AS rank, id, round(distance, 6) AS distance,
       round(greatest(0, 1 - distance), 6) AS similarity FROM r WHERE rk <= 3""")
def q_j05_topk_cosine(spark, sf):
    return round_doubles(_centroid_hits(spark, sf, 3))


@register("x02_query_context", _CENTROID_SQL.replace(
    "FROM embeddings)", "FROM embeddings JOIN (SELECT doc_id, text FROM documents) dd ON dd.doc_id = embeddings.vec_id)")
          + """
SELECT r.query_id, string_agg(dd.text, '\n\n---\n\n' ORDER BY r.rk) AS context
FROM r JOIN documents dd ON CAST(dd.doc_id AS VARCHAR) = r.id WHERE rk <= 3 GROUP BY r.query_id""")
def q_x02_query_context(spark, sf):
    return retrieval.concat_context(_centroid_hits(spark, sf, 3, with_text=True), "document")


@register("s15_collection_stats", """
WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents)
SELECT id, CASE WHEN length(text) > 100 THEN concat(substring(text, 1, 100), '...') ELSE text END AS preview,
       (SELECT count(*) FROM c) AS n_total FROM c ORDER BY id LIMIT 5""")
def q_s15_collection_stats(spark, sf):
    coll = vectors.as_collection(table(spark, sf, "documents"), "doc_id", "text")
    return vectors.collection_stats(coll, 5)


@register("s14_delete_by_ids", """
SELECT CAST(doc_id AS VARCHAR) AS id, lang FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')""")
def q_s14_delete_by_ids(spark, sf):
    docs = table(spark, sf, "documents")
    coll = vectors.as_collection(docs, "doc_id", "text", extra=["lang"])
    ids = docs.where(F.col("lang") == "de").select(F.col("doc_id").cast("string").alias("id"))
    return vectors.delete_ids(coll, ids).select("id", "lang")


@register("s11_upload_preview", f"""WITH {LI_NULLS_SQL}
SELECT {', '.join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in ['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate'])}
FROM li ORDER BY li.l_orderkey, li.l_linenumber LIMIT 10""")
def q_s11_upload_preview(spark, sf):
    from ..sources.readers import upload_preview
    rows, _n, _schema = upload_preview(lineitem_nulls(spark, sf), ["l_orderkey", "l_linenumber"], 10)
    return rows


_DOC_SUMMARY_SQL = ("concat('Dataset: ', (SELECT count(*) FROM documents), ' rows x 5 columns', chr(10), "
                    "'Columns: doc_id (bigint), text (string), lang (string), source (string), n_chars (bigint)')")


@register("x05_prompt_context", _CENTROID_SQL.replace(
    "FROM embeddings)", "FROM embeddings JOIN (SELECT doc_id, text FROM documents) dd ON dd.doc_id = embeddings.vec_id)")
          + f""",
ctx AS (SELECT r.query_id, string_agg(dd.text, '\n\n---\n\n' ORDER BY r.rk) AS context
        FROM r JOIN documents dd ON CAST(dd.doc_id AS VARCHAR) = r.id WHERE rk <= 3 GROUP BY r.query_id)
SELECT query_id, concat_ws('\n\n', {_DOC_SUMMARY_SQL}, concat('Relevant passages:\n', coalesce(context, '')),
       concat('Question: ', 'Which passages describe embedding group ', query_id, '?')) AS prompt FROM ctx""")
def q_x05_prompt_context(spark, sf):
    docs = table(spark, sf, "documents")
    hits = _centroid_hits(spark, sf, 3, with_text=True)
    ctx = retrieval.concat_context(hits, "document")
    questions = ctx.select("query_id", F.concat(F.lit("Which passages describe embedding group "), F.col("query_id"),
                                                F.lit("?")).alias("question"))
    return retrieval.assemble_prompts(questions, ctx, retrieval.data_summary_text(docs))


@register("f09_parse_reply", f"""
WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
q AS (SELECT conv_id, turn + 1 AS turn, text AS question FROM conversations WHERE role = 'user'),
j AS (SELECT a.conv_id, a.turn, {_think_sql('a.text')} AS cleaned, q.question FROM a LEFT JOIN q USING (conv_id, turn)),
o AS (SELECT *, regexp_extract(regexp_replace(regexp_replace(cleaned, '^```(?:json)?\\s*', ''), '\\s*```$', ''), '\\{{[\\s\\S]*\\}}', 0) AS obj FROM j),
v AS (SELECT *, CASE WHEN obj <> '' AND json_valid(obj) THEN obj END AS jobj FROM o)
SELECT conv_id, turn,
  CASE WHEN json_extract_string(jobj, '$.reply') IS NOT NULL THEN json_extract_string(jobj, '$.reply') ELSE cleaned END AS reply,
  CASE WHEN json_extract_string(jobj, '$.reply') IS NOT NULL THEN json_extract_string(jobj, '$.target_module')
       ELSE {_intent_sql('question')} END AS target_module
FROM v""")
def q_f09_parse_reply(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    q = c.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    j = a.join(q, ["conv_id", "turn"], "left").withColumn("p", tx.parse_reply("text", "question"))
    return j.select("conv_id", "turn", F.col("p.reply").alias("reply"), F.col("p.target_module").alias("target_module"))
