"""Text expressions (F4-F9, F12, F13): JVM-side regex / string functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col_of

# ---------------------------------------------------------------------------
# Keyword lists of the intent router, in the reference's order, and the
# module each list routes to. Matching is a lower-cased substring test, first list wins.
# ---------------------------------------------------------------------------
INTENT_RULES = [
    ("ml", ["預測", "機器學習", "模型訓練", "分類", "迴歸", "ml", "xgboost", "random forest", "shap", "訓練", "建模",
            "logistic"]),
    ("visualization", ["圖", "視覺化", "散點", "直方", "箱型", "長條", "圓餅", "配對", "chart", "plot", "畫"]),
    ("statistics", ["統計", "t 檢定", "t檢定", "迴歸分析", "卡方", "anova", "相關", "woe", "iv", "敘述統計"]),
    ("variable_analysis", ["變數", "欄位", "缺失", "遺漏", "型態", "轉換", "離群值", "補值", "替換", "資料字典"]),
    ("data_preview", ["預覽", "看看資料", "資料概覽", "匯出", "下載", "preview", "overview"]),
    ("psi_monitoring", ["psi", "監控", "偏移", "穩定性", "drift"]),
    ("rag_management", ["知識庫", "rag", "文件", "向量", "文檔"]),
    ("ai_assistant", ["狀態", "服務", "ollama", "模型狀態", "ai狀態", "ai 狀態"]),
]

# Assistant messages holding one of these markers are system notices and
# are left out of the chat history.
SYSTEM_MARKERS = ["Step 1 完成", "已進入 **", "已切換至 **", "⚙️ 自動執行"]

# Python's str.strip() whitespace as a regex class (under the (?U) flag)
_WS = r"[\s\x1c\x1d\x1e\x1f\x85]"


def strip_ws(c: str | Column) -> Column:
    """Python ``str.strip()`` (Spark's ``trim`` only drops spaces)."""
    return F.regexp_replace(col_of(c), rf"(?U)^{_WS}+|{_WS}+$", "")


def strip_think(c: str | Column) -> Column:
    """drop ``<think>...</think>`` blocks (dot matches newline, non-greedy), then strip."""
    return strip_ws(F.regexp_replace(col_of(c), r"(?s)<think>.*?</think>", ""))


def strip_code_fence(c: str | Column) -> Column:
    """F8: remove a leading ```` ``` ```` / ```` ```json ```` fence and a trailing fence."""
    x = F.regexp_replace(col_of(c), r"^```(?:json)?\s*", "")
    return F.regexp_replace(x, r"\s*```$", "")


def outer_json(c: str | Column) -> Column:
    """the outermost ``{...}`` span (greedy, across lines); empty string when absent."""
    return F.regexp_extract(col_of(c), r"\{[\s\S]*\}", 0)


def intent_tag(c: str | Column) -> Column:
    """first rule whose keyword occurs in the lower-cased text; null when none."""
    t = F.lower(col_of(c))
    expr = None
    for label, words in INTENT_RULES:
        cond = None
        for w in words:
            hit = t.contains(F.lit(w))
            cond = hit if cond is None else (cond | hit)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(None).cast("string"))


def preview(c: str | Column, n: int = 100) -> Column:
    """first n characters plus '...' when longer."""
    x = col_of(c)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def has_marker(c: str | Column, markers=SYSTEM_MARKERS) -> Column:
    x = col_of(c)
    cond = None
    for m in markers:
        hit = x.contains(F.lit(m))
        cond = hit if cond is None else (cond | hit)
    return cond


def chunk_array(c: str | Column, size: int = 500, overlap: int = 50) -> Column:
    """array<struct<pos int, chunk string>> of fixed-size overlapping chunks.

    Starts are 0, size-overlap, 2(size-overlap), ... while start < length; text of length
    <= size is one chunk. ``overlap >= size`` would never advance and is rejected."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("chunking needs 0 <= overlap < size")
    x = col_of(c)
    step = size - overlap
    n = F.length(x)
    many = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)),
                       lambda s, i: F.struct(i.cast("int").alias("pos"), x.substr(s + 1, F.lit(size)).alias("chunk")))
    one = F.array(F.struct(F.lit(0).alias("pos"), x.alias("chunk")))
    return F.when(x.isNull(), F.lit(None)).when(n <= size, one).otherwise(many)


def clean_feature_name(c: str | Column) -> Column:
    """drop a transformer prefix up to the first '__' (``num__age`` -> ``age``)."""
    return F.regexp_replace(col_of(c), r"^.*?__", "")


def parse_reply(raw: str | Column, question: str | Column) -> Column:
    """structured model reply. Think-blocks and a surrounding code fence are removed,
    the outermost JSON object is parsed; with a ``reply`` key the result keeps it and
    defaults the others (target_module null, suggested_params '{}', actions '[]');
    otherwise (no object, broken JSON, no ``reply``) the cleaned text is the reply and the
    target module comes from the keyword router on the question."""
    cleaned = strip_think(raw)
    obj = outer_json(strip_code_fence(cleaned))
    reply = F.get_json_object(obj, "$.reply")
    ok = (obj != F.lit("")) & reply.isNotNull()
    return F.when(ok, F.struct(reply.alias("reply"), F.get_json_object(obj, "$.target_module").alias("target_module"),
                               F.coalesce(F.get_json_object(obj, "$.suggested_params"), F.lit("{}")).alias("suggested_params"),
                               F.coalesce(F.get_json_object(obj, "$.actions"), F.lit("[]")).alias("actions"))).otherwise(
        F.struct(cleaned.alias("reply"), intent_tag(question).alias("target_module"), F.lit("{}").alias("suggested_params"),
                 F.lit("[]").alias("actions")))
