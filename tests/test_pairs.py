"""Pairs in blocks: numpy tables say what the columns say, and blocks of any size give the first rows of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import match, pairs
from tessella.plans import registry

SMALL = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def sides(spark, seed=3, names=150):
    draw = random.Random(seed)
    skill = [f"s{i}" for i in range(names)]
    candidates = spark.createDataFrame([(i, float(draw.randrange(10)), draw.choice([None, 0, 1, 6]), draw.randrange(3)) for i in range(90)], "candidate_id long, years double, nation int, projects int")
    jobs = spark.createDataFrame([(i, draw.choice([None, 0.0, 1.0, 3.0]), draw.choice([0, 1, 2])) for i in range(40)], "job_id long, wanted double, job_nation int")
    held = spark.createDataFrame([(i, s) for i in range(80) for s in draw.choices(skill, k=60)], "candidate_id long, skill string")
    wanted = spark.createDataFrame([(i, s, "required" if n < i % 6 else "preferred") for i in range(38) for n, s in enumerate(draw.sample(skill, i % 6 + i % 4))], "job_id long, skill string, tier string")
    return candidates, held, jobs, wanted


def every_pair(candidates, held, jobs, wanted):
    """Scores of all pairs by columns and joins, as rows."""
    tiers = {k: F.count_if(F.col("tier") == k) for k in ("required", "preferred")}
    hits = held.distinct().join(wanted, "skill").groupBy("candidate_id", "job_id").agg(tiers["required"].alias("r"), tiers["preferred"].alias("p"))
    wants = wanted.groupBy("job_id").agg(tiers["required"].alias("nr"), tiers["preferred"].alias("np"))
    rows = candidates.crossJoin(jobs).join(hits, ["candidate_id", "job_id"], "left").join(wants, "job_id", "left").fillna(0, ["r", "p", "nr", "np"])
    nation, there, r = F.col("nation"), F.col("job_nation"), F.col("r")
    parts = {
        "required": r / F.greatest(F.lit(1), F.col("nr")),
        "preferred": match.preferred_part(F.col("p"), F.col("np"), r),
        "experience": match.experience_part(F.col("years"), F.col("wanted")),
        "education": F.when(nation == there, 1.0).when(nation % 5 == there % 5, 0.85).otherwise(0.5),
        "projects": F.when(F.col("projects") >= 2, 1.0).when(F.col("projects") == 1, 0.75).otherwise(0.4),
    }
    return rows.withColumn("score", match.match_score(parts))


@pytest.mark.parametrize("sizes", [(32_768, 50_000, 1 << 22), (7, 9, 50)])
def test_best_and_counts_are_those_of_all_pairs(spark, monkeypatch, sizes):
    for name, value in zip(("MANY", "FEW", "PAIRS"), sizes, strict=True):
        monkeypatch.setattr(pairs, name, value)
    given = sides(spark)
    scored = every_pair(*given).cache()
    whole = pairs.Pairs(*given)
    for by, other, k in (("job", "candidate", 4), ("candidate", "job", 3)):
        want = match.ranked(scored, f"{by}_id", f"{other}_id", k).select("job_id", "candidate_id", "rank", "score", "r", "p", "nr", "np")
        got = whole.best(pairs.match_tenths, by, k).select("job_id", "candidate_id", "rank", (F.col("score") / 10).alias("score"), "r", "p", "nr", "np")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    counted = {r.score / 10: r.n for r in whole.counts(pairs.match_tenths).collect()}
    assert counted == {r.score: r["count"] for r in scored.groupBy("score").count().collect()} and sum(counted.values()) == 90 * 40


def test_rows_alike_are_scored_once(spark):
    candidates, held, jobs, wanted = sides(spark)
    more = lambda df, c, n: df.unionByName(df.withColumn(c, F.col(c) + 100)).unionByName(df.withColumn(c, F.col(c) + 200)) if n else df
    given = [more(x, c, 1) for x, c in ((candidates, "candidate_id"), (held, "candidate_id"), (jobs, "job_id"), (wanted, "job_id"))]
    whole = pairs.Pairs(*given)
    assert whole.candidates.where("candidate_id = class").count() <= 90 and whole.jobs.where("job_id = class").count() <= 40
    got = whole.best(pairs.match_tenths, "job", 5).select("job_id", "candidate_id", "rank", (F.col("score") / 10).alias("score"))
    want = match.ranked(every_pair(*given), "job_id", "candidate_id", 5).select("job_id", "candidate_id", "rank", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    counted = {r.score: r.n for r in whole.counts(pairs.match_tenths).collect()}
    assert sum(counted.values()) == 270 * 120


def test_tenths_of_descriptions(spark):
    rows = [(r, p, nr, np_, y, w, s, x) for nr, np_ in ((3, 2), (0, 0), (2, 0)) for r in range(nr + 1) for p in range(np_ + 1) for y in (0.0, 1.0, 7.0, None) for w in (0.0, 3.0) for s in (0.0, 1.0) for x in (0.0, 1.0)]
    df = spark.createDataFrame(rows, "r int, p int, nr int, np int, years double, wanted double, schooled double, placed double")
    wanted = F.col("nr") + F.col("np")
    parts = {
        "skills": F.when(wanted == 0, 100.0).otherwise(100.0 * (F.col("r") + 0.5 * F.col("p")) / (F.col("nr") + 0.5 * F.col("np"))),
        "experience": F.when(F.col("wanted") > 0, F.least(F.lit(100.0), 100.0 * F.col("years") / F.col("wanted"))),
        "education": F.when(F.col("schooled") == 1, F.when(F.col("placed") == 1, 100.0).otherwise(0.0)),
    }
    score = F.when(F.col("r") + F.col("p") == 0, 0.0).otherwise(F.round(match.present_mean(parts, match.JD_WEIGHTS), 1))
    for x in df.withColumn("score", score).collect():
        many = {"years": np.array([np.nan if x.years is None else x.years]), "placed": np.array([x.placed])}
        assert pairs.jd_tenths(np.array([x.r]), np.array([x.p]), x.nr, x.np, many, {"wanted": x.wanted, "schooled": x.schooled})[0, 0] / 10 == x.score


@pytest.mark.parametrize("name", ["candidate_job_rank", "jobs_for_candidate_topk", "fit_labels", "jd_leaderboard"])
def test_queries_make_no_row_for_a_pair(spark, name):
    plan = planned(registry.QUERIES[name](spark, SMALL))
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_screening_scores_read_vectors_and_not_the_joins(spark):
    plan = registry.QUERIES["screening_model"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "parquet" not in plan
