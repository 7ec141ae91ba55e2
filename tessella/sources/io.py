"""Readers and sinks; malformed input comes out as rows with a reason, never as an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row a non-blank line: line, parsed record, and reject_reason where it is not JSON."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "line")
    parsed = lines.withColumn("record", F.from_json("line", schema)).withColumn("__json", F.get_json_object("line", "$"))
    return parsed.withColumn("reject_reason", F.when(F.col("__json").isNull(), "invalid json")).drop("__json")


def read_json_dir(spark: SparkSession, path: str, schema: T.StructType | str, newest: str = "created_at") -> DataFrame:
    """A folder of JSON documents, the newest first; broken files are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path, multiLine=True).orderBy(F.desc(newest))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text and n_chars (without spaces and newlines) of plain text files, UTF-8 with or without BOM, else Latin-1."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    text = F.regexp_replace(text, "^﻿", "")
    return raw.select("path", text.alias("text"), F.length(F.regexp_replace(text, "[ \\n]", "")).alias("n_chars"))


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value).limit(1)


def split_rejects(df: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def write_by_task(df: DataFrame, path: str, labels: str = "tasks") -> None:
    """One JSON folder a label; a row with several labels goes to each."""
    df.withColumn("task", F.explode(labels)).write.partitionBy("task").mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')
