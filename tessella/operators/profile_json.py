"""Profiles from JSON texts and back: old and new layouts, lists or objects, whatever of it is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import jsons

# Where a field may stand, the first that holds something counts.
PERSON = {
    "name": ("$.personal_info.name", "$.candidate.full_name"), "email": ("$.personal_info.email", "$.candidate.email"), "phone": ("$.personal_info.phone", "$.candidate.phone"),
    "location": ("$.personal_info.location", "$.candidate.location"), "linkedin": ("$.personal_info.linkedin", "$.candidate.linkedin_url"), "github": ("$.personal_info.github", "$.candidate.github_url"),
    "leetcode": ("$.personal_info.leetcode", "$.candidate.leetcode_url"), "kaggle": ("$.personal_info.kaggle", "$.candidate.kaggle_url"), "portfolio": ("$.personal_info.portfolio", "$.candidate.portfolio_url"),
}
JOB = {"title": ("$.role", "$.title", "$.job_title"), "company": ("$.organization", "$.company"), "location": ("$.location",), "start_date": ("$.start_date",), "end_date": ("$.end_date",), "duration": ("$.duration",)}
SUMMARY = ("$.professional_summary", "$.professional_summary.text", "$.summary", "$.summary.text")
EXPERIENCED, INTERN, UNSAID = "Experienced", "Fresher / Internship", "Not specified"


def _job(x: Column) -> Column:
    kind = F.coalesce(jsons.text(x, "$.type"), jsons.text(x, "$.experience_type"), F.lit("full_time"))
    return F.struct(*[jsons.text(x, *paths).alias(k) for k, paths in JOB.items()], jsons.texts(x, "$.responsibilities").alias("responsibilities"), jsons.texts(x, "$.technologies").alias("technologies"), kind.alias("type"))


def read_profiles(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bad, name ... portfolio, summary, skills, jobs, status) of JSON texts; ``bad`` marks texts that are no JSON object, of which the rest is null or empty.

    ``experience`` may be a list of jobs, with internships told by their type, or an object with full_time and internships;
    a list of internships beside it counts where the first has none.
    """
    rows = docs.select(key, jsons.parsed(F.col(text)).alias("v")).withColumn("v", F.when(jsons.kind(F.col("v")) == "object", F.col("v")))
    v = F.col("v")
    split = F.concat(jsons.items(v, "$.experience.full_time"), F.array().cast("array<variant>"))
    listed = F.when(jsons.kind(F.try_variant_get(v, "$.experience", "variant")) == "object", split).otherwise(jsons.items(v, "$.experience"))
    rows = rows.withColumn("own", F.transform(listed, _job))
    beside = F.when(jsons.kind(F.try_variant_get(v, "$.experience", "variant")) == "object", jsons.items(v, "$.experience.internships")).otherwise(jsons.items(v, "$.internships"))
    interns = F.transform(beside, lambda x: _job(x).withField("type", F.lit("internship")))
    rows = rows.withColumn("jobs", F.concat("own", F.when(F.exists("own", lambda j: j["type"] == "internship"), F.slice(interns, 1, 0)).otherwise(interns)))
    worked = F.when(F.exists("jobs", lambda j: j["type"] != "internship"), EXPERIENCED).when(F.size("jobs") > 0, INTERN).otherwise(UNSAID)
    status = F.coalesce(jsons.text(v, "$.employment_status"), F.when(v.isNotNull(), worked))
    fields = [jsons.text(v, *paths).alias(k) for k, paths in PERSON.items()]
    return rows.select(key, v.isNull().alias("bad"), *fields, jsons.text(v, *SUMMARY).alias("summary"), jsons.texts(v, "$.skills", "$.skills_flat").alias("skills"), "jobs", status.alias("status"))


def write_profiles(profiles: DataFrame, key: str) -> DataFrame:
    """(key, text): one JSON text in the new layout for each profile; ``read_profiles`` gives the same profile back."""
    person = F.struct(*PERSON)
    body = F.struct(person.alias("personal_info"), F.col("summary").alias("professional_summary"), "skills", F.col("jobs").alias("experience"), F.col("status").alias("employment_status"))
    return profiles.select(key, F.to_json(body).alias("text"))


def flat_profiles(profiles: DataFrame, key: str) -> DataFrame:
    """One flat row for each profile, as a table or a CSV file holds it: lists joined, jobs counted, the first full-time job beside them."""
    full = F.filter("jobs", lambda j: j["type"] != "internship")
    first = F.get(full, F.lit(0))
    return profiles.select(
        key, *PERSON, "summary", F.array_join("skills", ", ").alias("skills"), F.size("skills").alias("n_skills"), F.size(full).alias("n_jobs"), (F.size("jobs") - F.size(full)).alias("n_internships"),
        first["title"].alias("current_title"), first["company"].alias("current_company"), F.array_join(F.array_distinct(F.flatten(F.transform("jobs", lambda j: j["technologies"]))), ", ").alias("technologies"), "status")
