"""Quality rules: a threshold table compiled into one Spark projection.

``measure`` adds the base counts of a text, ``RULES`` states limits on ratios of those
counts, and ``apply_rules`` compiles the table into columns of the same projection. All
work happens inside the row: no shuffle, no user functions.

Defined results: a null or blank text has no words (all counts 0) and fails the base
rules; repeated rows are judged one by one; an empty table gives an empty table; only
the id and text columns are read, so other columns never clash. Equality of five-word
windows inside one text is decided by 64-bit hashes of the words in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, STOP_WORDS, WORD_CLASS, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Keep while ``low * den <= scale * num <= high * den`` for texts of ``from_words`` words or more."""

    name: str
    num: str
    den: str
    low: int | None = None
    high: int | None = None
    scale: int = 100
    from_words: int = 10

    def passes(self) -> Column:
        ok = F.lit(True)
        x = F.col(self.num) * F.lit(self.scale)
        if self.low is not None:
            ok = ok & (x >= F.col(self.den) * F.lit(self.low))
        if self.high is not None:
            ok = ok & (x <= F.col(self.den) * F.lit(self.high))
        return ok | (F.col("n_words") < self.from_words)


#: threshold table (percent of the denominator)
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=2500),
    Rule("symbols", "n_symbols", "n_words", high=30),
    Rule("stop_words", "n_stop_words", "n_words", low=3, from_words=50),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=30),
    Rule("upper_case", "n_upper", "word_chars", high=60, from_words=20),
)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base counts and the counts that ``RULES`` uses (all long)."""
    t = text_or_empty(F.col(text_col))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS))
    parts = docs.select(
        F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("ws"), lines.alias("ls"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"))
    last = WINDOW - 1
    grams = F.when(F.size("ws") > last, F.transform(
        F.slice("ws", F.lit(1), F.size("ws") - last),
        lambda w, i: F.xxhash64(w, *[F.col("ws")[i + F.lit(k)] for k in range(1, WINDOW)])))
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    counted = parts.select(
        "doc_id", "word_chars", "n_symbols", "n_upper", F.size("ws").cast("long").alias("n_words"),
        F.size("ls").cast("long").alias("n_lines"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("ws", lambda w: F.array_contains(stops, F.lower(w)))).cast("long").alias("n_stop_words"),
        grams.alias("g"))
    # only texts with an equal pair of windows are sorted
    sorted_grams = F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(
        F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ranked = counted.withColumn("s", sorted_grams).drop("g")
    n = F.size("s")
    twice = F.filter("s", lambda x, k: ((k > 0) & (F.get("s", k - 1)["h"] == x["h"]))
                     | ((k < n - 1) & (F.get("s", k + 1)["h"] == x["h"])))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(-WINDOW).alias("prev"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("prev"), (a["n"] + F.least(F.lit(WINDOW), i - a["prev"])).alias("n")),
        lambda a: a["n"])
    return ranked.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("s")


def apply_rules(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, one boolean ``fails_<rule>`` per rule and the verdict kept."""
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    base = (n < 10) | (F.lit(100) * rep > F.lit(20) * n)
    kept = ~base
    for r in rules:
        kept = kept & r.passes()
    return measured.select("*", base.alias("base_failed"), *[(~r.passes()).alias(f"fails_{r.name}") for r in rules],
                           kept.alias("kept"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return apply_rules(measure(docs, id_col, text_col), rules)


def oracle() -> str:
    """DuckDB SQL of the same result."""
    ws = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    ls = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
    stops = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
    fails = []
    for r in RULES:
        lim = [f"{r.num} * {r.scale} < {r.den} * {r.low}"] if r.low is not None else []
        lim += [f"{r.num} * {r.scale} > {r.den} * {r.high}"] if r.high is not None else []
        fails.append(f"(n_words >= {r.from_words} AND ({' OR '.join(lim)})) AS fails_{r.name}")
    return rf"""
WITH p AS (SELECT doc_id, {ws} AS ws, {ls} AS ls, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(len(list_filter(ws, lambda x: list_contains({stops}, lower(x)))) AS BIGINT) AS n_stop_words FROM p),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i,
  unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM p WHERE len(ws) >= 5),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, sum(x) AS n FROM (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS x
  FROM d) GROUP BY doc_id),
f AS (SELECT m.*, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN c USING (doc_id)),
r AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, {", ".join(fails)} FROM f)
SELECT *, NOT (base_failed OR {" OR ".join("fails_" + r.name for r in RULES)}) AS kept FROM r"""
