"""Stored records: funnels, lookups, change logs and entity resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def funnel(rows: DataFrame, stage: str, stages: Sequence[str]) -> DataFrame:
    """(stage_no, stage, n) of every stage in order, zeros kept."""
    spark: SparkSession = rows.sparkSession
    fixed = spark.range(1).select(F.posexplode(F.array(*map(F.lit, stages))).alias("stage_no", "stage"))
    counted = rows.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n"))
    return fixed.join(counted, "stage", "left").select("stage_no", "stage", F.coalesce("n", F.lit(0)).alias("n"))


def latest(log: DataFrame, key: str, order: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """The newest version of each record of an append-only log, without those whose newest version is a deletion."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    out = log.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return out if deleted is None else out.where(~deleted)


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """existing and, for each key that it lacks, the first of the new rows by ``order``."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    once = new.withColumn("__n", first).where("__n = 1").drop("__n")
    return existing.unionByName(once.join(existing.select(*keys).distinct(), keys, "left_anti"))


def count_by_parent(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Parents with the number of their children, 0 included."""
    counts = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias("n_children"))
    return parents.join(counts, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def resolve(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(new_id, stored_id): the newest stored record with the same e-mail or the same name.

    Stored records are cut to the newest of each e-mail and of each name before two equi-joins on unique keys.
    """
    age = F.struct("created", (-F.col("stored_id")).alias("order"))  # the smaller id wins ties
    newest = lambda c: stored.groupBy(F.lower(c).alias("k")).agg(F.max(age).alias("age"))
    by_mail = new.join(newest("s_email"), F.lower(new["email"]) == F.col("k")).select("new_id", "age")
    by_name = new.where("name <> 'unnamed candidate'").join(newest("s_name"), F.lower(new["name"]) == F.col("k")).select("new_id", "age")
    return by_mail.unionByName(by_name).groupBy("new_id").agg((-F.max("age")["order"]).alias("stored_id"))


def search(rows: DataFrame, query: str, text: Sequence[str], arrays: Sequence[str] = ()) -> DataFrame:
    """Rows in which any field contains the query, letter case aside; an empty query finds all."""
    q = F.lit(query.lower())
    hit = F.lit(query == "")
    for c in text:
        hit = hit | F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    for c in arrays:
        hit = hit | F.coalesce(F.exists(c, lambda x: F.contains(F.lower(x), q)), F.lit(False))
    return rows.where(hit)
