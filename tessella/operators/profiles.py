"""Checks and merges of profiles: warnings, information loss, two sources, success score, taxonomy tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Share of each pillar, and of regressor, classifier and pillars in the blend.
PILLARS = (0.30, 0.20, 0.15, 0.15, 0.20)
BLEND = (0.40, 0.35, 0.25)


def structural_warnings(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds the names of the rules that hold, 1 - min(0.6, 0.05 n) as score, and valid (at most six)."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    n = F.size("warnings")
    score = F.round(1 - F.least(F.lit(0.6), 0.05 * n), 4)
    return df.withColumn("warnings", found).withColumn("score", score).withColumn("valid", n <= 6)


def information_loss(before: DataFrame, after: DataFrame, key: str, values: Sequence[str] = (), counts: Sequence[str] = ()) -> DataFrame:
    """Fields that were set before and are null after, or count less than before; a missing row loses all."""
    b = before.select(key, *[F.col(c).alias(f"b_{c}") for c in (*values, *counts)])
    a = after.select(key, *[F.col(c).alias(f"a_{c}") for c in (*values, *counts)])
    gone = [F.when(F.col(f"b_{c}").isNotNull() & F.col(f"a_{c}").isNull(), F.lit(c)) for c in values]
    less = [F.when(F.col(f"b_{c}") > F.coalesce(F.col(f"a_{c}"), F.lit(0)), F.lit(c)) for c in counts]
    lost = F.array_compact(F.array(*gone, *less))
    return b.join(a, key, "left").select(key, lost.alias("lost")).withColumn("n_lost", F.size("lost"))


def merge_sources(first: DataFrame, second: DataFrame, key: str, fields: Mapping[str, Column]) -> DataFrame:
    """The value of ``first``, else that of ``second`` where its test holds; with counts of proposed, accepted and rejected values.

    A test may use the column ``s_<field>``.
    """
    s = second.select(key, *[F.col(c).alias(f"s_{c}") for c in fields])
    proposed = {c: F.col(c).isNull() & F.col(f"s_{c}").isNotNull() for c in fields}
    accepted = {c: proposed[c] & F.coalesce(test, F.lit(False)) for c, test in fields.items()}

    def total(flags) -> Column:
        return sum((f.cast("int") for f in flags), F.lit(0))

    merged = [F.when(accepted[c], F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in fields]
    tallies = [total(proposed.values()).alias("proposed"), total(accepted.values()).alias("accepted")]
    return first.join(s, key, "left").select(key, *merged, *tallies).withColumn("rejected", F.col("proposed") - F.col("accepted"))


def record_differences(first: DataFrame, second: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, differing): the fields in which the two records of a key differ; a value and a null differ, two nulls do not."""
    s = second.select(key, *[F.col(c).alias(f"s_{c}") for c in fields])
    differing = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"s_{c}")), F.lit(c)) for c in fields]))
    return first.join(s, key).select(key, differing.alias("differing"))


def experience_rollup(rows: DataFrame, key: str) -> DataFrame:
    """Years of rows (key, kind, months, stated) by key, and a text.

    An internship without months counts one; full-time years are the stated ones, else the sum.
    """
    intern = F.col("kind") == "internship"
    months = F.coalesce(F.nullif("months", F.lit(0)), F.when(intern, 1).otherwise(0))
    years = F.bround(months / 12, 4)
    of = lambda mine, c: F.sum(F.when(mine, c).otherwise(0))
    sums = rows.groupBy(key).agg(
        of(intern, months).alias("im"), of(~intern, months).alias("fm"), of(intern, years).alias("iy"), of(~intern, years).alias("fy"), F.coalesce(F.max("stated"), F.lit(0.0)).alias("stated")
    )
    full = F.round(F.when(F.col("stated") > 0, F.col("stated")).otherwise(F.col("fy")), 4).alias("full_time_years")
    full_months = F.when(F.col("stated") > 0, F.bround(F.col("stated") * 12).cast("long")).otherwise(F.col("fm")).alias("fm")
    sums = sums.select(key, "im", full_months, full, F.round("iy", 4).alias("internship_years"))
    y, plural = F.col("full_time_years"), lambda c: F.concat(F.col(c).cast("string"), F.lit(" month"), F.when(F.col(c) == 1, "").otherwise("s"))
    worked = F.when(y == 1, "1 year").when(y > 1, F.concat(F.bround(y, 1).cast("string"), F.lit(" years"))).when(F.col("fm") > 0, plural("fm")).otherwise("0 years")
    learned = F.concat(plural("im"), F.lit(" internship"))
    both = F.when((y > 0) & (F.col("im") > 0), F.concat(worked, F.lit(" (+ "), learned, F.lit(")"))).when(y > 0, worked).when(F.col("im") > 0, learned).otherwise("Fresher (0 years)")
    return sums.select(key, "full_time_years", "internship_years", F.round(y + F.col("internship_years"), 4).alias("total_years"), both.alias("display"))


def success_score(pillars: Sequence[Column], regressed: Column, chance: Column) -> Column:
    """Blend of a regressed score, a class probability and five weighted pillars, in 0 to 100."""
    mean = sum((w * p for w, p in zip(PILLARS, pillars, strict=True)), F.lit(0.0))
    blended = BLEND[0] * regressed + BLEND[1] * 100 * chance + BLEND[2] * mean
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), blended))


def benchmark_clip(value: Column, benchmark: Column, low: float = 0.7, high: float = 1.3) -> Column:
    """A predicted amount held between shares of its benchmark."""
    return F.greatest(benchmark * low, F.least(benchmark * high, value))


def taxonomy_tables(roles: DataFrame, aliases: DataFrame, default_id: int = 0) -> dict[str, DataFrame]:
    """Flat tables of roles(role_id, role, skills array): roles, role_skills by place, and aliases(alias, skill) with skill ids."""
    placed = roles.select("role_id", F.posexplode("skills").alias("place", "skill"))
    ids = placed.select("skill").distinct().withColumn("skill_id", F.xxhash64("skill"))
    known = aliases.join(ids, "skill", "left").select("alias", "skill", F.coalesce("skill_id", F.lit(default_id)).alias("skill_id"))
    flat = roles.select("role_id", "role", F.array_join("skills", ";").alias("skills"), F.size("skills").alias("n_skills"))
    return {"roles": flat, "role_skills": placed, "aliases": known}
