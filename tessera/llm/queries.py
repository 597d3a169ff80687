"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import functions as F

from . import (
    decontaminate,
    jaccard_join,
    language_id,
    license_scan,
    mixing,
    near_dedup,
    periodic_runs,
    prefix_trie,
    quality_cnn,
    quality_rules,
    repeats,
    token_counts,
    token_ids,
)
from .common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return add


@register("op1_token_counts")
def op1(spark, sf_dir):
    pieces = token_counts.byte_level_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), pieces)


@register("op2_mixing", mixing.oracle())
def op2(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken(mixed).select("doc_id", "size", "source_size", "target", "taken")


@register("op5_token_ids")
def op5(spark, sf_dir):
    return token_ids.token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op7_quality_rules", quality_rules.oracle())
def op7(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


@register("op9_license_scan", license_scan.oracle())
def op9(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("sentence_ids").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"))


@register("op4_language_id")
def op4(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "n_words")


@register("op6_quality_cnn")
def op6(spark, sf_dir):
    return quality_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op10_near_dedup", near_dedup.oracle())
def op10(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).drop("th")


@register("op3_decontaminate", decontaminate.oracle())
def op3(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


@register("op8_repeats")
def op8(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def _planted(doc_id: str | None, words: list) -> list:
    """Every tenth document, by the hash of its id, repeats its words from a place on."""
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


@register("op13_periodic_runs")
def op13(spark, sf_dir):
    out = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=_planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"),
                     F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("b.col2"), F.col("b.length"), -F.col("b.col3")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
                      F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@register("op11_prefix_trie", prefix_trie.oracle())
def op11(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@register("op12_jaccard_join", f"SELECT doc_id, n_shingles, component_id FROM ({near_dedup.oracle(5, 80)})")
def op12(spark, sf_dir):
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).drop("th")
