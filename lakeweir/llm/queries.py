"""One query per operator over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweir.llm import html, lines, mixing, nearest, packing, quality, repair, search, simhash, suffix, tokens, toxicity
from lakeweir.llm.common import read

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.repetition(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs).select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))


def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), width=3, radius=2, min_similarity=None)


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.near_duplicates(read(spark, sf_dir, "embeddings"))


def bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_digest(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(rows := repair.damage(read(spark, sf_dir, "conversations")), gone=rows["_gone"])


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.with_copies(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules,
    "op2_line_dedup": line_dedup,
    "op3_simhash_dedup": simhash_dedup,
    "op4_suffix_dedup": suffix_dedup,
    "op5_embedding_dedup": embedding_dedup,
    "op6_bpe_codec": bpe_codec,
    "op7_token_counts": token_counts,
    "op8_toxicity": toxicity_scores,
    "op9_html_text": html_text,
    "op10_packing": packed,
    "op11_ranked_search": ranked_search,
    "op12_conversation_repair": repaired_conversations,
    "op13_source_mix": mixed_sources,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": lines.LINES_SQL.format(host="source", table="documents", text="text")
    + "SELECT p.doc_id, CASE WHEN p.text IS NULL THEN NULL ELSE t._kept END AS text, coalesce(t._n_lines, 0) AS n_lines, coalesce(t._n_dropped, 0) AS n_dropped FROM pages p LEFT JOIN text_of t ON p._r = t._r",
    "op11_ranked_search": search.SEARCH_SQL,
    "op13_source_mix": mixing.MIX_SQL,
}
