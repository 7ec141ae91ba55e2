"""The corpus queries, and the SQL that says the same where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontamination, html_text, line_dedup, lm, near_dedup, negatives, quality, search, substring_dedup, toxicity, url_filter
from .shared import bucket_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", (F.col("n_removed") > 0).alias("changed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    held_out = bucket_of(F.col("doc_id"), 4) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "flagged")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    scanned = decontamination.scan_benchmark(docs.select("doc_id", "text"), items)
    listed = F.sha2(F.array_join("hit_items", ","), 256)
    return scanned.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]
    return quality.score_quality(docs, model).select(*columns)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    events = chat_format.as_events(rows.unionByName(chat_format.probe(spark)))
    return chat_format.digest(chat_format.format_blocks(events))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.load_vocabulary(spark, public_tokenizers.path(VOCABULARY))
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search.search(index, table(spark, sf_dir, "benchmark")).select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_url_filter,
        op3_toxicity,
        op4_minhash_near_dedup,
        op5_line_dedup,
        op6_decontamination,
        op7_quality,
        op8_chat_format,
        op9_lm_score,
        op10_bpe,
        op11_lexical_search,
        op12_html_text,
        op13_hard_negatives,
    )
}

ORACLE_SQL = {
    "op2_url_filter": url_filter.ORACLE,
    "op4_minhash_near_dedup": near_dedup.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
    "op11_lexical_search": search.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
