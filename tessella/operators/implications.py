"""What skills imply, stand for and partly cover: rules by relational division, equivalences, role scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import pairs

# Skills any of which implies others; names that stand for each other; a skill that either
# of its parts covers; skills that half cover others; weights of the tiers of a role.
IMPLIED = (
    (("django",), ("python", "rest apis", "database design", "orm")),
    (("flask", "fastapi"), ("python", "rest apis")),
    (("express.js",), ("node.js", "rest apis")),
    (("figma",), ("ui design", "ux design", "visual design", "wireframing", "prototyping")),
    (("ux research", "user research"), ("ux design", "user research")),
    (("wireframing", "prototyping"), ("ui design", "ux design")),
    (("power bi", "tableau"), ("data visualization", "business intelligence", "reporting")),
    (("pandas",), ("python", "data analysis", "data cleaning", "eda")),
    (("numpy",), ("python", "data analysis")),
    (("excel",), ("data analysis", "reporting")),
    (("spark", "apache spark"), ("data pipelines", "etl/elt", "distributed systems")),
    (("airflow",), ("data pipelines", "etl/elt")),
    (("selenium", "playwright"), ("test automation", "testing")),
    (("dsa",), ("problem solving",)),
    (("oop",), ("software design",)),
)
EQUIVALENT = (
    ("rest api", "rest apis", "restapis", "restapi", "restapi's", "rest api's"),
    ("html", "html5"),
    ("css", "css3"),
    ("microsoft excel", "excel"),
)
COVERED = {"jwt": ("jwt authentication",), "jwt authentication": ("jwt",), "simple jwt": ("jwt authentication", "jwt"), "data structures & algorithms": ("data structures", "algorithms")}
RELATED = {
    "react": ("next.js", "ui development"), "javascript": ("typescript",), "html": ("responsive design",), "css": ("responsive design",), "python": ("data analysis",),
    "sql": ("database design",), "figma": ("wireframing", "prototyping", "visual design"), "machine learning": ("deep learning", "feature engineering"),
    "selenium": ("playwright", "test automation"), "playwright": ("test automation",), "jest": ("testing",), "docker": ("ci/cd",),
}
ROLE_WEIGHTS = {"core": 1.00, "important": 0.75, "recommended": 0.50, "optional": 0.25}
RULE = "rule string, premise string, needs int, conclusion string"


def known_rules(spark: SparkSession) -> DataFrame:
    """The fixed implications as (rule, premise, needs, conclusion); one premise is enough for each."""
    return spark.createDataFrame([("/".join(any_of), p, 1, c) for any_of, then in IMPLIED for p in any_of for c in then], RULE)


def known_alternatives(spark: SparkSession) -> DataFrame:
    """The fixed equivalences as (target, alternative)."""
    pairs = [(a, b) for names in EQUIVALENT for a in names for b in names if a != b] + [(a, b) for a, parts in COVERED.items() for b in parts]
    return spark.createDataFrame(pairs, "target string, alternative string")


def implied(held: DataFrame, rules: DataFrame) -> DataFrame:
    """(candidate_id, skill) concluded by rules of which a candidate holds ``needs`` premises or more.

    A rule with ``needs`` at the number of its premises asks for all of them, one with 1 for any: rules are
    divided into the held skills by counting the premises that each candidate satisfies.
    """
    premises = rules.select("rule", F.col("premise").alias("skill"), "needs").distinct()
    met = held.select("candidate_id", "skill").distinct().join(premises, "skill").groupBy("candidate_id", "rule").agg(F.count("*").alias("met"), F.max("needs").alias("needs"))
    fired = met.where("met >= needs").select("candidate_id", "rule")
    return fired.join(rules.select("rule", "conclusion").distinct(), "rule").select("candidate_id", F.col("conclusion").alias("skill")).distinct()


def effective(held: DataFrame, rules: DataFrame) -> DataFrame:
    """Held and implied skills as (candidate_id, skill, origin); what is both is held."""
    both = held.select("candidate_id", "skill", F.lit("held").alias("origin")).unionByName(implied(held, rules).withColumn("origin", F.lit("implied")))
    return both.groupBy("candidate_id", "skill").agg(F.min("origin").alias("origin"))


def half_covered(skills: DataFrame, edges: DataFrame) -> DataFrame:
    """(candidate_id, skill) that a skill of the candidate is related to by edges (src, dst) and that the candidate lacks."""
    near = skills.select("candidate_id", F.col("skill").alias("src")).join(edges.select("src", "dst").distinct(), "src").select("candidate_id", F.col("dst").alias("skill")).distinct()
    return near.join(skills.select("candidate_id", "skill"), ["candidate_id", "skill"], "left_anti")


def equivalent_matches(held: DataFrame, wanted: DataFrame, alternatives: DataFrame) -> DataFrame:
    """(candidate_id, job_id, matched, missing), sorted lists, of pairs with a wanted skill held by its own or an alternative name.

    held: (candidate_id, skill), wanted: (job_id, skill), alternatives: (target, alternative).
    """
    wanted = wanted.select("job_id", "skill").distinct()
    accepted = wanted.join(alternatives.select(F.col("target").alias("skill"), "alternative").distinct(), "skill").unionByName(wanted.withColumn("alternative", F.col("skill")))
    hits = held.select("candidate_id", F.col("skill").alias("alternative")).distinct().join(accepted, "alternative")
    matched = hits.groupBy("candidate_id", "job_id").agg(F.array_sort(F.collect_set("skill")).alias("matched"))
    listed = wanted.groupBy("job_id").agg(F.collect_set("skill").alias("all"))
    return matched.join(listed, "job_id").select("candidate_id", "job_id", "matched", F.array_sort(F.array_except("all", "matched")).alias("missing"))


def covered(held: DataFrame, alternatives: DataFrame) -> DataFrame:
    """(candidate_id, skill), with repeats: what candidates hold, and what a held skill is an alternative of."""
    targets = alternatives.groupBy(F.col("alternative").alias("skill")).agg(F.collect_set("target").alias("targets"))
    rows = held.select("candidate_id", "skill").join(targets, "skill", "left")
    return rows.select("candidate_id", F.explode(F.array_append(F.coalesce("targets", F.array().cast("array<string>")), F.col("skill"))).alias("skill"))


def best_equivalent(held: DataFrame, wanted: DataFrame, alternatives: DataFrame, k: int) -> DataFrame:
    """(candidate_id, job_id, n_matched, n_missing, matched): of ``equivalent_matches`` the k jobs of each candidate with most matches, then fewest missing, then by id.

    The jobs are found on bits of what candidates cover; names are put to the found pairs only.
    """
    whole = pairs.Pairs(None, covered(held, alternatives), None, wanted.select("job_id", "skill", F.lit("required").alias("tier")))
    found = whole.best(pairs.covered_first, "candidate", k)
    return whole.named(found).select("candidate_id", "job_id", F.col("r").cast("long").alias("n_matched"), (F.col("nr") - F.col("r")).cast("long").alias("n_missing"), "matched")


def role_scores(held: DataFrame, roles: DataFrame, rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(candidate_id, role, score, n_matched, n_half) of roles (role, skill, tier) with a matched skill; all others score 0.

    A skill that is held or implied counts fully, a related one half.  With a core skill the score is the larger of the
    balanced shares of tiers, at most 96, and the plain ratio of all points; without one the other tiers count little.
    """
    skills = effective(held, rules)
    credit = skills.select("candidate_id", "skill", F.lit(1.0).alias("credit")).unionByName(half_covered(skills, edges).withColumn("credit", F.lit(0.5)))
    roles = roles.select("role", "skill", "tier").distinct()

    def of(tier: str, c: Column) -> Column:
        return F.sum(F.when(F.col("tier") == tier, c).otherwise(0.0))

    sizes = roles.groupBy("role").agg(*[of(t, F.lit(w)).alias(f"max_{t}") for t, w in ROLE_WEIGHTS.items()])
    points = credit.join(roles, "skill").groupBy("candidate_id", "role").agg(
        *[of(t, F.col("credit") * w).alias(t) for t, w in ROLE_WEIGHTS.items()], F.count_if(F.col("credit") == 1.0).alias("n_matched"), F.count_if(F.col("credit") < 1.0).alias("n_half"))
    rows = points.where("n_matched > 0").join(sizes, "role")
    share = {t: F.col(t) / F.greatest(F.col(f"max_{t}"), F.lit(1.0)) for t in ROLE_WEIGHTS}
    balanced = F.round(F.least(F.lit(96.0), 125.0 * (0.60 * share["core"] + 0.25 * share["important"] + 0.15 * share["recommended"])), 1)
    total, most = (sum((F.col(f"{p}{t}") for t in ROLE_WEIGHTS), F.lit(0.0)) for p in ("", "max_"))
    plain = F.round(100.0 * total / F.greatest(most, F.lit(1.0)), 1)
    early = F.round(30.0 * share["important"] + 15.0 * share["recommended"], 1)
    score = F.when(F.col("core") > 0, F.greatest(balanced, plain)).otherwise(early)
    return rows.select("candidate_id", "role", score.alias("score"), "n_matched", "n_half")


def best_roles(scores: DataFrame, k: int) -> DataFrame:
    """The k best roles of every candidate; equal scores by role."""
    order = Window.partitionBy("candidate_id").orderBy(F.desc("score"), "role")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
