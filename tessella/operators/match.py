"""Scores of candidates against jobs, and rankings with stable ties."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the parts of a match.
WEIGHTS = {"required": 0.50, "preferred": 0.15, "experience": 0.15, "education": 0.10, "projects": 0.10}
JD_WEIGHTS = {"skills": 0.70, "experience": 0.20, "education": 0.10}
TIERS = {"core": 0.60, "important": 0.25, "recommended": 0.15}


def experience_part(years: Column, wanted: Column) -> Column:
    """1 where enough, the ratio but 0.35 at least where some, 0.30 where none; without a wish, or with 0, one year is wanted."""
    wanted = F.when(F.coalesce(wanted, F.lit(0.0)) == 0, 1.0).otherwise(wanted)
    years = F.coalesce(years, F.lit(0.0))
    return F.when((wanted <= 0) | (years >= wanted), 1.0).when(years > 0, F.greatest(F.lit(0.35), years / wanted)).otherwise(0.30)


def match_score(parts: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted percentage, held between 0 and 100."""
    total = sum((F.lit(w) * parts[k] for k, w in weights.items()), F.lit(0.0))
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * total)), 1)


def preferred_part(hits: Column, wanted: Column, required_hits: Column) -> Column:
    """Share of the preferred skills; where none is wanted, 1 with any required hit, else 0.5."""
    return F.when(wanted > 0, hits / wanted).when(required_hits > 0, 1.0).otherwise(0.5)


def rank_reason(rank: Column, matched: Column, missing: Column, overall: Column, skill: Column, label: Column) -> Column:
    """One sentence on why a candidate stands where it does."""
    gaps = F.concat(missing.cast("string"), F.lit(" open"))
    return (
        F.when(matched == 0, F.concat(F.lit("#"), rank.cast("string"), F.lit(": no matched skill")))
        .when(rank == 1, F.concat(F.lit("#1: best fit, "), overall.cast("string"), F.lit(" % ("), label, F.lit("), skills "), skill.cast("string"), F.lit(" %")))
        .when(rank <= 3, F.concat(F.lit("#"), rank.cast("string"), F.lit(": "), label, F.lit(", skills "), skill.cast("string"), F.lit(" %, "), gaps))
        .otherwise(F.concat(F.lit("#"), rank.cast("string"), F.lit(": "), label, F.lit(", "), gaps))
    )


def present_mean(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted mean over the parts that are not null; null where none is."""
    value = sum((F.coalesce(parts[k] * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(parts[k].isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return value / F.nullif(weight, F.lit(0.0))


def ranked(scored: DataFrame, by: str, key: str, top: int | None = None) -> DataFrame:
    """Numbers 1..n within ``by`` by falling score, ties by ``key``; the first ``top`` where given."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), key)
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if top is None else out.where(F.col("rank") <= top)


def role_score(core: Column, important: Column, recommended: Column) -> Column:
    """Tiered percentage of shares of matched tiers; without a core hit the others count less."""
    full = F.least(F.lit(96.0), 125 * (TIERS["core"] * core + TIERS["important"] * important + TIERS["recommended"] * recommended))
    return F.round(F.when(core > 0, full).otherwise(30 * important + 15 * recommended), 4)
