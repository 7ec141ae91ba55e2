"""Corpus statistics, duplicate and leakage audits, splits and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; null keys are equal."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def duplicate_summary(df: DataFrame, group: str, key: str) -> DataFrame:
    """total, distinct, duplicates and their rate in percent, by group; two aggregations and no expanded rows."""
    once = df.groupBy(group, key).agg(F.count("*").alias("n"))
    out = once.groupBy(group).agg(F.sum("n").alias("total"), F.count("*").alias("distinct_keys"))
    extra = F.col("total") - F.col("distinct_keys")
    return out.withColumn("duplicates", extra).withColumn("dup_rate", F.round(100.0 * extra / F.greatest(F.lit(1), F.col("total")), 2))


def pairwise_overlap(df: DataFrame, group: str, key: str) -> DataFrame:
    """Shared keys of every pair of groups, pairs without any included."""
    sets = df.select(group, key).distinct()
    names = sets.select(group).distinct()
    pairs = names.select(F.col(group).alias("a")).join(names.select(F.col(group).alias("b")), F.col("a") < F.col("b"))
    x, y = sets.select(F.col(group).alias("a"), key), sets.select(F.col(group).alias("b"), key)
    shared = x.join(y, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("shared"))


def hash_bucket(key: Column, buckets: int = 10) -> Column:
    """Bucket by the first 32 bits of SHA-256: the same in any engine, and whole keys stay together."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % buckets


def split_name(key: Column) -> Column:
    b = hash_bucket(key)
    return F.when(b < 8, "train").when(b == 8, "validation").otherwise("test")


def length_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """count, mean, median, min, max, population deviation, and quartiles by floor index.

    Equal values of a group become one row first, so the running count goes over distinct values only.
    """
    once = df.groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    ranked = once.withColumn("upto", F.sum("n").over(w.orderBy("v"))).withColumn("all", F.sum("n").over(w))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("v")))
    quartile = lambda q: at(F.floor(F.lit(q) * F.col("all")) + 1)
    middle = (at(F.floor((F.col("all") + 1) / 2)) + at(F.floor(F.col("all") / 2) + 1)) / 2
    mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
    squares = F.sum(F.col("v").cast("double") * F.col("v") * F.col("n")) / F.sum("n")
    return ranked.where("v IS NOT NULL").groupBy(group).agg(
        F.max("all").alias("n"),
        F.round(mean, 2).alias("mean"),
        F.round(middle, 2).alias("median"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), squares - mean * mean)), 2).alias("std"),
        quartile(0.25).alias("p25"),
        quartile(0.75).alias("p75"),
    )


def null_inventory(df: DataFrame) -> DataFrame:
    """(column_name, nulls, blanks) of every column, in one pass."""
    counts = []
    for c, kind in df.dtypes:
        blank = F.sum(F.when(F.trim(F.col(c)) == "", 1).otherwise(0)) if kind == "string" else F.sum(F.lit(0))
        counts.append(F.struct(F.lit(c).alias("column_name"), F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias("nulls"), blank.alias("blanks")))
    return df.agg(F.array(*counts).alias("all")).select(F.explode("all").alias("one")).select("one.*")


def value_counts(df: DataFrame, column: str, top: int) -> DataFrame:
    """The most frequent values with their share of all rows in percent; ties by value."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    best = counted.orderBy(F.desc("n"), column).limit(top)
    return best.join(F.broadcast(total)).select(column, "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


def reject_reason(body: Column, label: Column, least_body: int = 200, least_label: int = 20) -> Column:
    """The first reason for which a row is rejected, else null."""
    return (
        F.when(F.coalesce(F.trim(body), F.lit("")) == "", "missing body")
        .when(F.coalesce(F.trim(label), F.lit("")) == "", "missing answer")
        .when(F.length(body) < least_body, "body too short")
        .when(F.length(label) < least_label, "answer too short")
    )
