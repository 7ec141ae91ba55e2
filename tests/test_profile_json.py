"""Profiles out of JSON of several shapes, and back."""

import json

from pyspark.sql import functions as F

from tessella.functions import jsons
from tessella.operators import profile_json

TEXTS = [
    '```json\n{"personal_info": {"name": " Ana ", "email": null}, "candidate": {"full_name": "X", "email": "a@b.c"}, "skills": ["Py", " SQL ", null, 3], "experience": [{"role": "Dev", "organization": "Acme", "technologies": "Go, Rust"}, {"title": "Trainee", "type": "internship"}], "internships": [{"title": "unused"}]}\n```',
    '{"candidate": {"full_name": "Bo"}, "skills": "a, b,,c", "experience": {"full_time": [], "internships": [{"job_title": "Intern", "company": "C", "responsibilities": ["x", "y"]}]}}',
    '{"skills": {"tools": ["git", "vim"], "other": "make"}, "summary": {"text": "short"}, "internships": {"role": "One"}, "employment_status": "Busy", "experience": null}',
    '{"personal_info": ', "[1, 2]", "", None, "```\n{}\n```", '{"personal_info": "text", "skills": 7, "experience": "none"}',
]


def rows_of(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def test_profiles_of_several_shapes(spark):
    got = {r["id"]: r for r in profile_json.read_profiles(rows_of(spark), "id", "text").collect()}
    assert [got[i].bad for i in range(9)] == [False, False, False, True, True, True, True, False, False]
    assert (got[0].name, got[0].email, got[0].skills, got[0].status) == ("Ana", "a@b.c", ["Py", "SQL", "3"], profile_json.EXPERIENCED)
    assert [(j.title, j.company, j.technologies, j.type) for j in got[0].jobs] == [("Dev", "Acme", ["Go", "Rust"], "full_time"), ("Trainee", None, [], "internship")]
    assert (got[1].name, got[1].skills, got[1].status) == ("Bo", ["a", "b", "c"], profile_json.INTERN) and got[1].jobs[0].responsibilities == ["x", "y"]
    assert (got[2].skills, got[2].summary, got[2].status, [j.title for j in got[2].jobs]) == (["make", "git", "vim"], "short", "Busy", ["One"])
    assert got[7].jobs == got[7].skills == [] and got[7].status == profile_json.UNSAID and got[3].status is None and got[8].jobs == got[8].skills == []


def test_profiles_survive_the_round_trip(spark):
    profiles = profile_json.read_profiles(rows_of(spark), "id", "text").where("NOT bad")
    written = profile_json.write_profiles(profiles, "id")
    assert all(isinstance(json.loads(r.text), dict) for r in written.collect())
    again = profile_json.read_profiles(written, "id", "text")
    assert sorted(map(str, again.collect())) == sorted(map(str, profiles.collect()))
    flat = {r["id"]: r for r in profile_json.flat_profiles(profiles, "id").collect()}
    assert (flat[0].skills, flat[0].n_jobs, flat[0].n_internships, flat[0].current_company, flat[0].technologies) == ("Py, SQL, 3", 1, 1, "Acme", "Go, Rust") and flat[1].current_title is None


def test_fences_and_kinds(spark):
    rows = spark.createDataFrame([("```json {\"a\": 1}``` tail",), (" x ",), ("``` y",), (None,)], "t string")
    assert [r[0] for r in rows.select(jsons.unfenced(F.col("t"))).collect()] == ['{"a": 1}', "x", "y", ""]
    kinds = rows.limit(1).select(*[jsons.kind(F.try_parse_json(F.lit(x))) for x in ("[]", "{}", '"s"', "1", "null", "bad")]).first()
    assert list(kinds) == ["array", "object", "text", "other", None, None]
