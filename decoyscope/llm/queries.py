"""The dealt operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, conversations, decontaminate, html_content, jaccard_join, line_dedup, mixing, secret_scan, sharding, simhash, spelling, tokenizer_quality, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_dom_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_content.extract(pages, html_content.train(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("perplexity", 4).alias("perplexity"))


def op4_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op5_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_copied"
    )


def op6_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs).select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept")


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(toxicity.remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("segments").alias("n_segments"),
    )


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select("doc_id", "shard", "depth", "bytes", "shard_bytes", "oversized")


def op9_size_banded_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return tokenizer_quality.judged(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "n_fallback", F.round("token_entropy", 6).alias("token_entropy"),
    )


def op11_persistent_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(table(spark, sf_dir, "conversations"))


def op12_bidirectional_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_simhash_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Query] = {
    "op1_fm_index_decontamination": op1_fm_index_decontamination,
    "op2_dom_tree_text": op2_dom_tree_text,
    "op3_stupid_backoff": op3_stupid_backoff,
    "op4_line_bitmaps": op4_line_bitmaps,
    "op5_ownership_secrets": op5_ownership_secrets,
    "op6_raked_mix": op6_raked_mix,
    "op7_toxic_segments": op7_toxic_segments,
    "op8_extendible_shards": op8_extendible_shards,
    "op9_size_banded_jaccard": op9_size_banded_jaccard,
    "op10_tokenizer_fertility": op10_tokenizer_fertility,
    "op11_persistent_audit": op11_persistent_audit,
    "op12_bidirectional_variants": op12_bidirectional_variants,
    "op13_simhash_deletion_variants": op13_simhash_deletion_variants,
}
