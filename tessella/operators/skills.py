"""Skill tables, normalisers and overlap scores; vocabularies are DataFrames or small maps given as parameters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_of(c: Column) -> Column:
    """Trimmed lower case without brackets, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[()\\[\\]{}]", " "), " +", " "))


def key_cascade(c: Column) -> Column:
    """Ordered spellings under which a skill may be listed: exact, without possessive, without separators, singular."""
    k = F.trim(F.lower(c))
    bare = F.regexp_replace(k, "'s$", "")
    spaced = F.trim(F.regexp_replace(k, "[-_./ ]+", " "))
    packed = F.regexp_replace(k, "[^a-z0-9+#]", "")
    return F.array_distinct(F.array(k, bare, F.regexp_replace(k, "'", ""), spaced, packed, F.regexp_replace(packed, "s$", "")))


def normalize(c: Column, aliases: Mapping[str, str]) -> Column:
    """The alias of the first listed spelling, else the trimmed lower case."""
    if not aliases:
        return F.trim(F.lower(c))
    table = F.create_map(*[F.lit(x) for pair in sorted(aliases.items()) for x in pair])
    hits = F.filter(F.transform(key_cascade(c), lambda k: F.try_element_at(table, k)), lambda x: x.isNotNull())
    return F.coalesce(F.get(hits, 0), F.trim(F.lower(c)))


def normalize_rows(rows: DataFrame, skill: str, aliases: DataFrame) -> DataFrame:
    """The same for a vocabulary of any size: join with (alias, canonical), unknown skills keep their key."""
    keyed = rows.withColumn("__key", key_of(F.col(skill)))
    return keyed.join(aliases.select(F.col("alias").alias("__key"), "canonical"), "__key", "left").withColumn("skill_key", F.coalesce("canonical", "__key")).drop("__key", "canonical")


# Trailing words that do not change a skill, words in capitals, and words of categories and kinds (the first that occurs).
NOISE = r"\s+(?:development|integration|framework|library|basics|fundamentals|programming|language|tools?|skills?)$"
ACRONYMS = ("sql", "html", "css", "api", "apis", "rest", "dsa", "oop", "sdlc", "aws", "gcp", "eda", "etl")
CATEGORIES = (
    ("language|script|c[+][+]|java|python|ruby|golang|rust|kotlin|swift|dart", "Programming Languages"),
    ("css|html|react|vue|angular|frontend|ui|web|tailwind|bootstrap|framer|three", "Frontend Technologies"),
    ("backend|django|flask|fastapi|spring|express|node|server|rails|laravel", "Backend Technologies"),
    ("sql|mongo|database|postgres|redis|db|storage|dynamo|cassandra", "Databases & Storage"),
    ("api|graphql|rest|soap|endpoint|grpc", "APIs & Web Services"),
    ("aws|azure|gcp|cloud|vercel|render|netlify|heroku|digitalocean", "Cloud & Hosting"),
    ("docker|kubernetes|ci/cd|devops|jenkins|linux|container|ansible|terraform", "DevOps & Infrastructure"),
    ("auth|security|jwt|oauth|crypto", "Authentication & Security"),
    ("figma|design|ux|wireframe|prototype|adobe|canva", "UI / UX Design"),
    ("test|jest|playwright|selenium|cypress|qa|pytest", "Testing & QA"),
    ("learning|nlp|vision|ai|pandas|numpy|data science|torch|tensor", "Data Science & AI"),
    ("excel|power bi|tableau|bi|analytics|looker", "Business Intelligence"),
    ("git|github|gitlab|bitbucket|jira|tool|postman|swagger|vscode|npm|yarn", "Development Tools"),
    ("algorithm|structure|system design|oop|architecture|debugging", "Core Computer Science"),
    ("communication|problem solving|collaboration|leadership|teamwork|agile|scrum|time management", "Soft Skills & Attributes"),
    ("office|word|powerpoint|workspace", "Office Productivity"),
)
OTHER_CATEGORY = "Other Technical Skills"
KINDS = (
    ("database|sql|mongo|postgres|redis|storage", "database"),
    ("tool|studio|git|postman|figma|excel|jupyter|airflow|dbt|docker|vscode|devtool", "tool"),
    ("framework|react|vue|angular|django|flask|spring|express|flutter|spark", "framework"),
    ("library|redux|pandas|numpy|torch|tensor|scikit|jest|cypress|motion|router", "library"),
    ("cloud|aws|azure|gcp|vercel|netlify|render|hosting|platform", "platform"),
    ("language|script|python|java|c[+][+]|c#|golang|ruby|rust|scala|kotlin|swift", "language"),
)
OTHER_KIND = "concept"


def cleaned_skill(c: Column) -> Column:
    """Lower case with plain quotes, without bullets, numbers, brackets and marks around it, spaces collapsed."""
    low = F.translate(F.lower(F.coalesce(c, F.lit(""))), "’‘`´“”", "''''\"\"")
    bare = F.regexp_replace(F.regexp_replace(low, r"^[\s*•\-–—+\d.)]+", ""), r"[()\[\]{}]", " ")
    bare = F.regexp_replace(F.trim(bare), "^['\".,;:]+|['\".,;:]+$", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def spellings(s: Column) -> Column:
    """Array of (form, key), in the order in which a cleaned skill is looked up; form is exact or packed (letters and digits only)."""
    owner = lambda x, put: F.trim(F.regexp_replace(x, r"'s\b", put))
    spaced = F.trim(F.regexp_replace(F.regexp_replace(s, "[-_/]", " "), r"\s+", " "))
    many = s.endswith("s") & (F.length(s) > 3) & ~s.endswith("ss")
    number = F.when(many, F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(F.concat(s, F.lit("s")))
    short = F.trim(F.regexp_replace(s, NOISE, ""))
    exact = lambda x: F.struct(F.lit("exact").alias("form"), x.alias("key"))
    packed = lambda x: F.struct(F.lit("packed").alias("form"), F.regexp_replace(x, "[^a-z0-9]", "").alias("key"))
    tried = [exact(s), exact(owner(s, "")), exact(owner(s, "s")), exact(F.replace(s, F.lit("'"), F.lit(""))), exact(spaced), exact(owner(spaced, ""))]
    tried += [packed(s), packed(owner(s, "")), exact(number), packed(number), exact(short), exact(owner(short, ""))]
    return F.filter(F.array(*tried), lambda x: x["key"] != "")


def resolve_skills(rows: DataFrame, skill: str, aliases: DataFrame) -> DataFrame:
    """Adds ``canonical`` by a vocabulary (alias, canonical) of any size: the first known spelling, else the cleaned skill.

    Spellings of distinct skills are joined once, whatever their number; of aliases that look alike the smallest canonical counts.
    """
    exact = aliases.select(F.lit("exact").alias("form"), F.lower("alias").alias("key"), F.col("canonical").alias("found"))
    known = exact.unionAll(exact.select(F.lit("packed"), F.regexp_replace("key", "[^a-z0-9]", ""), "found")).groupBy("form", "key").agg(F.min("found").alias("found"))
    clean = rows.select(cleaned_skill(F.col(skill)).alias("clean")).distinct()
    tried = clean.select("clean", F.posexplode(spellings(F.col("clean"))).alias("place", "s")).select("clean", "place", "s.form", "s.key")
    best = tried.join(known, ["form", "key"]).groupBy("clean").agg(F.min_by("found", "place").alias("found"))
    joined = rows.withColumn("clean", cleaned_skill(F.col(skill))).join(best, "clean", "left")
    return joined.withColumn("canonical", F.coalesce("found", "clean")).drop("clean", "found")


def display_name(canonical: Column) -> Column:
    """A canonical skill as it is shown: acronyms in capitals, other words with a capital."""
    words = F.filter(F.split(F.translate(canonical, "_", " "), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).otherwise(F.initcap(w))), " ")


def gap(held: Column, required: Column) -> Column:
    """matched, missing and additional skills, sorted, and the match in percent."""
    matched = F.array_sort(F.array_intersect(required, held))
    share = F.round(100.0 * F.size(matched) / F.greatest(F.lit(1), F.size(F.array_distinct(required))), 1)
    return F.struct(
        matched.alias("matched"),
        F.array_sort(F.array_except(required, held)).alias("missing"),
        F.array_sort(F.array_except(held, required)).alias("additional"),
        share.alias("match_pct"),
    )


def best_evidence(evidence: DataFrame) -> DataFrame:
    """The row of highest priority for each (candidate_id, skill); the first seen wins ties."""
    w = Window.partitionBy("candidate_id", "skill").orderBy(F.desc("priority"), "seq")
    return evidence.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def category_matrix(rows: DataFrame) -> DataFrame:
    """(candidate_id, category, skills): sorted distinct skills of each category."""
    return rows.groupBy("candidate_id", "category").agg(F.array_sort(F.collect_set("skill")).alias("skills"))


def one_hop(held: DataFrame, edges: DataFrame) -> DataFrame:
    """(candidate_id, skill) reached over an edge (src, dst) from a held skill and not held."""
    near = held.join(edges, held["skill"] == edges["src"]).select("candidate_id", F.col("dst").alias("skill")).distinct()
    return near.join(held, ["candidate_id", "skill"], "left_anti")
