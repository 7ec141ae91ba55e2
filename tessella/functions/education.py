"""Which records of an education are degrees and which are of a school: one rule, counts and an audit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels and types by class, words of qualifications by class, and words of institutions by class.
CLASSES = ("degree", "school", "other")
SCHOOL_LEVELS = ("school", "school/secondary", "secondary", "higher secondary", "secondary school", "high school", "senior secondary")
SCHOOL_TYPES = ("school", "school/secondary", "secondary", "higher secondary", "secondary school", "high school")
SCHOOL_PLACES = ("school", "school/secondary", "secondary school", "high school", "higher secondary school")
SCHOOL_TERMS = (
    "sslc", "ssc", "secondary", "class 10", "class x", "10th", "matriculation", "matric", "hsc", "hse", "hslc", "higher secondary", "class 12", "class xii", "class x ii", "12th",
    "senior secondary", "higher secondary school", "high school", "plus two", "+2", "cbse", "icse", "state board",
)
DEGREE_TERMS = (
    "bachelor", "bachelors", "b.sc", "bsc", "b.com", "bcom", "bba", "bca", "b.e", "b.tech", "be", "btech", "b.ed", "b.des", "b.arch", "b.pharm", "bams", "bhms", "mbbs",
    "master", "masters", "m.sc", "msc", "m.com", "mcom", "mba", "mca", "m.e", "m.tech", "me", "mtech", "m.ed", "m.des", "m.arch", "m.pharm", "phd", "ph.d", "doctorate", "doctoral",
    "undergraduate", "postgraduate", "post-graduate", "associate degree", "diploma", "pgdm",
)
DEGREE_LEVELS = ("college/university", "university", "college", "higher education")
DEGREE_PLACES = ("college/university", "university", "college")
SCHOOL_NAMES = r"\b(?:higher\s+secondary\s+school|matriculation|high\s+school|vidhyalaya|school)\b"
DEGREE_NAMES = r"\b(?:college|university|institute)\b"
#: Columns of a record; all may be null or absent.
FIELDS = ("stated", "classification", "level", "type", "institution_type", "qualification_type", "category", "degree", "qualification", "institution")


def terms_pattern(terms: tuple[str, ...]) -> str:
    """Any of the terms as a whole word; an underscore ends a word as well."""
    return r"(?:\b|_)(?:" + "|".join(re.escape(t) for t in terms) + r")(?:\b|_)"


def education_class(df: DataFrame) -> Column:
    """degree, school or other: what is stated, then a school's level or type, words of schools, words of degrees, a college's level or type, the institution's name."""
    have = {c.lower() for c in df.columns}
    at = {f: F.lower(F.trim(F.coalesce(F.col(f).cast("string"), F.lit("")))) if f in have else F.lit("") for f in FIELDS}
    said = F.array_join(F.filter(F.array(*[at[f] for f in ("category", "qualification_type", "qualification", "degree")]), lambda x: x != ""), " ")
    return (
        F.when(at["stated"].isin(*CLASSES), at["stated"])
        .when((at["classification"] == "school") | at["level"].isin(*SCHOOL_LEVELS) | at["type"].isin(*SCHOOL_TYPES) | at["institution_type"].isin(*SCHOOL_PLACES), "school")
        .when(said.rlike(terms_pattern(SCHOOL_TERMS)), "school")
        .when(said.rlike(terms_pattern(DEGREE_TERMS)), "degree")
        .when((at["classification"] == "degree") | at["level"].isin(*DEGREE_LEVELS) | at["type"].isin(*DEGREE_PLACES) | at["institution_type"].isin(*DEGREE_PLACES), "degree")
        .when(at["institution"].rlike(SCHOOL_NAMES), "school")
        .when(at["institution"].rlike(DEGREE_NAMES), "degree")
        .otherwise("other")
    )


def education_counts(records: DataFrame, key: str, label: str = "class") -> DataFrame:
    """(key, degree_count, school_count, other_count, total_count) of classified records."""
    each = [F.count_if(F.col(label) == c).alias(f"{c}_count") for c in CLASSES]
    return records.groupBy(key).agg(*each, F.count(F.lit(1)).alias("total_count"))


def education_audit(records: DataFrame, key: str, order: str) -> DataFrame:
    """(key, valid, total_records, issues): records whose stated class is not the one that the rule gives without it, in order."""
    own = records.withColumn("class", education_class(records.drop("stated")) if "stated" in records.columns else education_class(records))
    stated = F.lower(F.trim(F.coalesce(F.col("stated"), F.lit("")))) if "stated" in records.columns else F.lit("")
    wrong = F.when((stated != "") & (stated != F.col("class")), F.struct(F.col(order), F.concat(F.coalesce("degree", F.lit("")), F.lit(": "), stated, F.lit(" is "), F.col("class")).alias("what")))
    listed = F.transform(F.array_sort(F.collect_list(wrong)), lambda x: x["what"])
    return own.groupBy(key).agg(F.count(F.lit(1)).alias("total_records"), listed.alias("issues")).select(key, (F.size("issues") == 0).alias("valid"), "total_records", "issues")
