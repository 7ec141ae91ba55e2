"""The master skill set of a profile: every mention in its six sources, cut into single skills, named, and led back to the best evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import labels, rules
from tessella.operators import skills

# Evidence by rising weight, and categories in the order in which they are shown.
PRIORITY = {
    "SUMMARY_EVIDENCE": 1, "EXPERIENCE_EVIDENCE": 2, "PROJECT_EVIDENCE": 3, "RAW_TEXT_EVIDENCE": 4, "CERTIFICATION_EVIDENCE": 4,
    "EXPERIENCE_TECHNOLOGY": 5, "PROJECT_TECHNOLOGY": 6, "EXPLICIT_SKILL": 7,
}
CATEGORY_ORDER = (
    "Programming Languages", "Frontend Technologies", "Backend Technologies", "APIs & Web Services", "Authentication & Security", "Databases & Storage",
    "Cloud & Hosting", "DevOps & Infrastructure", "Development Tools", "UI / UX Design", "Data Science & AI", "Business Intelligence", "Testing & QA",
    "Core Computer Science", "Office Productivity", "Soft Skills & Attributes", "Other Technical Skills",
)
#: Nested profiles as ``mentions`` reads them; every column but the id may be null, and so may what is inside.
PROFILE = (
    "candidate_id long, skills map<string,array<string>>, projects array<struct<name:string,technologies:array<string>,text:string>>, "
    "experience array<struct<company:string,title:string,technologies:array<string>,text:string>>, summary string, certifications array<string>, raw_text string"
)


def _mention(kind: str, evidence: Column, said: Column) -> Column:
    return F.struct(F.lit(kind).alias("source"), evidence.alias("evidence"), said.alias("said"))


def _all(items: Column, each) -> Column:
    return F.coalesce(F.flatten(F.transform(items, each)), F.array())


def _used(kind: str, before: str, name: Column):
    return lambda p: F.transform(F.coalesce(p["technologies"], F.array().cast("array<string>")), lambda t: _mention(kind, F.concat(F.lit(before), name, F.lit(": "), F.coalesce(t, F.lit(""))), t))


def mentions(profiles: DataFrame) -> DataFrame:
    """(candidate_id, seq, source, evidence, said) of every list entry and every text of a profile, in the order of the sources."""
    explicit = _all(F.map_entries("skills"), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<string>")), lambda s: _mention("EXPLICIT_SKILL", F.concat(F.lit("Listed under "), e["key"]), s)))

    def project(p: Column) -> Column:
        name = F.coalesce(p["name"], F.lit("Project"))
        return F.concat(_used("PROJECT_TECHNOLOGY", "Used in ", name)(p), F.array(_mention("PROJECT_EVIDENCE", F.concat(F.lit("Shown in "), name), p["text"])))

    def job(e: Column) -> Column:
        name = F.coalesce(e["company"], F.lit("Experience"))
        return F.concat(_used("EXPERIENCE_TECHNOLOGY", "Used at ", name)(e), F.array(_mention("EXPERIENCE_EVIDENCE", F.concat(F.lit("Shown at "), name), e["text"])))

    certified = F.coalesce(F.transform("certifications", lambda c: _mention("CERTIFICATION_EVIDENCE", F.concat(F.lit("Certified in "), F.coalesce(c, F.lit(""))), c)), F.array())
    rest = [F.array(_mention("SUMMARY_EVIDENCE", F.lit("Mentioned in the summary"), F.col("summary"))), certified, F.array(_mention("RAW_TEXT_EVIDENCE", F.lit("Found in the text"), F.col("raw_text")))]
    every = F.concat(explicit, _all(F.col("projects"), project), _all(F.col("experience"), job), *rest)
    rows = profiles.select("candidate_id", F.posexplode(every).alias("seq", "m"))
    return rows.select("candidate_id", "seq", "m.*").where(F.coalesce("said", F.lit("")) != "")


LISTED = ("EXPLICIT_SKILL", "PROJECT_TECHNOLOGY", "EXPERIENCE_TECHNOLOGY")


def master_skills(profiles: DataFrame, aliases: DataFrame, categories: DataFrame, longest: int = 3) -> DataFrame:
    """(candidate_id, skill, name, category, source, evidence): one row for each skill of a profile, under its best evidence.

    aliases: (alias, canonical), categories: (skill, category), both of any size.  Entries of lists are cut into
    single skills and named by their alias; texts are searched for aliases of up to ``longest`` words and two
    characters or more.  ``name`` is the first spelling met; of evidence of equal weight the first counts.
    """
    said = mentions(profiles)
    listed = said.where(F.col("source").isin(*LISTED)).select("candidate_id", "seq", "source", "evidence", F.posexplode(rules.atoms(F.col("said"))).alias("n", "token"))
    named = skills.resolve_skills(listed, "token", aliases)
    words = F.filter(F.split(F.lower("said"), "[^a-z0-9+#]+"), lambda w: w != "")
    texts = said.where(~F.col("source").isin(*LISTED)).select("candidate_id", "seq", "source", "evidence", words.alias("w"))

    def grams(k: int) -> Column:
        last = F.size("w") - k + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice("w", i, k), " "))).otherwise(F.array().cast("array<string>"))

    terms = texts.select("candidate_id", "seq", "source", "evidence", F.explode(F.array_distinct(F.concat(*[grams(k) for k in range(1, longest + 1)]))).alias("term"))
    spelled = F.array_join(F.filter(F.split(F.lower("alias"), "[^a-z0-9+#]+"), lambda w: w != ""), " ")
    known = aliases.where(F.length("alias") >= 2).select(spelled.alias("term"), "canonical").where("term <> ''").distinct()
    found = terms.join(known, "term").select("candidate_id", "seq", F.lit(0).alias("n"), "source", "evidence", F.col("canonical").alias("token"), "canonical")
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair]), F.col("source"))
    rows = named.select("candidate_id", "seq", "n", "source", "evidence", "token", "canonical").unionByName(found).withColumn("skill", F.lower("canonical")).where("skill <> ''")
    best = rows.groupBy("candidate_id", "skill").agg(
        F.min(F.struct("seq", "n", "token"))["token"].alias("name"),
        F.max(F.struct(weight.alias("weight"), (-F.col("seq")).alias("seq"), (-F.col("n")).alias("n"), "source", "evidence")).alias("best"))
    exact = categories.select(F.lower("skill").alias("skill"), "category").groupBy("skill").agg(F.min("category").alias("exact"))
    category = F.coalesce("exact", labels.first_match(F.col("skill"), skills.CATEGORIES, skills.OTHER_CATEGORY))
    return best.join(exact, "skill", "left").select("candidate_id", "skill", "name", category.alias("category"), "best.source", "best.evidence")


def skill_matrix(master: DataFrame, order: Sequence[str] = CATEGORY_ORDER, keep_empty: bool = True) -> DataFrame:
    """(candidate_id, place, category, skills): sorted skills of each category in its fixed place; further categories come after, by name.

    With ``keep_empty`` a candidate has a row for every category of the order, also for those without a skill.
    """
    held = master.groupBy("candidate_id", "category").agg(F.array_sort(F.collect_set("skill")).alias("skills"))
    listed = held.groupBy("candidate_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "skills")))).alias("by"))
    fixed = F.array(*[F.lit(c) for c in order])
    every = F.concat(fixed, F.array_sort(F.array_except(F.map_keys("by"), fixed)))
    rows = listed.select("candidate_id", "by", F.posexplode(every).alias("place", "category"))
    rows = rows.select("candidate_id", "place", "category", F.coalesce(F.try_element_at("by", F.col("category")), F.array().cast("array<string>")).alias("skills"))
    return rows if keep_empty else rows.where(F.size("skills") > 0)
