"""A training corpus from ``documents`` in five stages, each written and read again.

Defined results: a null text passes the filters as an empty one and has no tokens;
rows that share a doc_id are one document to the near-copy stage, which keeps or
drops them together, and rows with a null doc_id go through it; an empty table
gives an empty one; a text of any length is handled whole; columns of documents
beside ``COLUMNS`` are dropped, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontamination, line_dedup, near_dedup, toxicity
from tessella.llm.queries import VOCABULARY
from tessella.llm.shared import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold of their language go on."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), holdout=False)
    return toxicity.score_toxicity(docs, model).where("NOT flagged").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies goes on."""
    return near_dedup.drop_near_copies(docs).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark windows are cut out of the texts; n_chars follows the text."""
    out = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, their number, and whether decoding gives the text back."""
    vocabulary = bpe.load_vocabulary(spark, public_tokenizers.path(VOCABULARY))
    coded = bpe.code_texts(docs.select("doc_id", "lang", "source", "text"), vocabulary, public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
