"""Rules on text columns, bands and rankings on small rows, one case a rule."""

from pyspark.sql import functions as F

from tessella.functions import careers, dates, labels, postings, rules
from tessella.operators import audit, match, metrics, records, skills


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fit_and_jd_bands(spark):
    fit = lambda v: one(spark, labels.banded(F.lit(v), labels.FIT_BANDS, labels.FIT_BELOW))
    assert [fit(v) for v in (80.0, 79.9, 65.0, 50.0, 35.0, 34.9)] == ["Strong Match", "Potential Candidate", "Potential Candidate", "Moderate Match", "Needs Skill Development", "Not Currently Suitable"]
    jd = lambda v, n: one(spark, labels.jd_label(F.lit(v), F.lit(n)))
    assert [jd(80.0, 1), jd(60.0, 1), jd(30.0, 1), jd(1.0, 1), jd(0.0, 1), jd(90.0, 0)] == ["Strong Match", "Good Match", "Partial Match", "Low Match", "No Match", "No Match"]


def test_preferred_part_defaults(spark):
    part = lambda p, n, r: one(spark, match.preferred_part(F.lit(p), F.lit(n), F.lit(r)))
    assert [part(1, 4, 0), part(0, 0, 2), part(0, 0, 0)] == [0.25, 1.0, 0.5]


def test_sentence_classes(spark):
    said = lambda s: one(spark, rules.sentence_class(F.lit(s)))
    assert [said("I want to learn X"), said("Never used X"), said("Studying X"), said("Uses X"), said(None)] == ["aspiration", "negated", "learning", "plain", "plain"]


def test_atoms(spark):
    cut = lambda x: one(spark, rules.atoms(F.lit(x).cast("string")))
    assert cut("Languages: Alpha, Beta/Gamma, built a thing, " + "x" * 81) == ["Alpha", "Beta", "Gamma"]
    assert cut("Languages: Python, SQL Frontend: HTML / CSS, Databases:") == ["Python", "SQL", "HTML", "CSS"]  # labels inside
    assert cut("tools Git") == ["Git"] and cut("a;b") == ["a;b"] and cut("worked with SQL") == cut("Note: x y") == cut(None) == cut("") == []
    assert not one(spark, rules.atomic_skill(F.lit("a b c d e f g h")))


def test_instruction_and_body(spark):
    split = lambda s: tuple(one(spark, rules.instruction_body(F.lit(s).cast("string"), ["summarize this[:]?"], "Default")))
    assert split("Summarize this: the body") == ("Summarize this", "the body")
    assert split("What is it?\nthe body") == ("What is it?", "the body")
    assert split("Time: 10 o clock is not a command\nx") == ("Default", "Time: 10 o clock is not a command\nx")
    assert split(" Rewrite the summary - \n\n x\ny ") == ("Rewrite the summary", "x\ny")
    assert split("Read: \nx") == ("Read", "x") and split("only a body?") == ("Default", "only a body?") and split(None) == ("Default", "")


def test_levels_categories_and_lists(spark):
    level = lambda s: one(spark, labels.first_match(F.lower(F.lit(s)), labels.SENIORITY, "Unknown"))
    assert [level("Senior Intern"), level("Engineer II"), level("Jr. Dev"), level("VP Sales"), level("Dev")] == ["Intern", "Senior", "Junior", "Director", "Unknown"]
    label = lambda s: one(spark, labels.category_label(F.lit(s)))
    assert [label("It best fits the food / drink category."), label("Job Category: sales"), label("best fits the following category"), label("none")] == ["FOOD-DRINK", "SALES", None, None]
    assert one(spark, rules.merge_lists(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("a"), F.lit("C")))) == ["A", "b", "C"]
    assert one(spark, rules.capped_gaps(F.array(*map(F.lit, "abcdef")), F.array(F.lit("x"), F.lit("y")))) == ["a", "b", "c", "d", "x"]
    assert [tuple(x) for x in one(spark, rules.proficiency(F.lit("Alpha (Basic), Beta: Expert; Gamma")))] == [("Alpha", "Basic"), ("Beta", "Expert")]


def test_durations(spark):
    months = lambda s: one(spark, dates.months_of_text(F.lit(s)))
    assert [months("2 years 3 months"), months("1.5 yrs"), months("7 mos"), months("soon")] == [27, 18, 7, None]
    years = lambda s: one(spark, dates.required_years(F.lit(s)))
    assert [years("3-5 years"), years("4+ years"), years("2 to 6 yrs"), years("any")] == [3.0, 4.0, 2.0, None]


def test_length_summary_and_auc(spark):
    rows = spark.createDataFrame([("a", v) for v in (1, 1, 2, 9)] + [("b", 5)], "g string, v int")
    got = {r["g"]: (r["n"], r["median"], r["p25"], r["p75"], r["lo"], r["hi"]) for r in audit.length_summary(rows, "g", "v").collect()}
    assert got == {"a": (4, 1.5, 1, 9, 1, 9), "b": (1, 5.0, 5, 5, 5, 5)}
    scores = spark.createDataFrame([(int(i % 3 == 0), float(i * 7 % 101)) for i in range(300)], "y int, s double")
    data = [(r["y"], r["s"]) for r in scores.collect()]
    pairs = [(p > n) + (p == n) / 2 for a, p in data if a for b, n in data if not b]
    assert metrics.roc_auc(scores, "y", "s", 7).first()["auc"] == round(sum(pairs) / len(pairs), 6)


def test_resolve_takes_the_newest(spark):
    stored = spark.createDataFrame([(1, "a@x", "N", 1), (2, "A@x", "M", 3), (3, "b@x", "N", 3), (4, "a@x", "O", 3)], "stored_id int, s_email string, s_name string, created int")
    new = spark.createDataFrame([(9, "a@X", "n"), (8, "z", "unnamed candidate"), (7, "z", "n")], "new_id int, email string, name string")
    assert sorted(tuple(r) for r in records.resolve(new, stored).collect()) == [(7, 3), (9, 2)]


def test_titles_evidence_and_status(spark):
    title = lambda s: tuple(one(spark, careers.title_role(F.lit(s))))
    assert title("Sr. Back-End dev")[0::3] == ("Backend Developer", 0.9) and title("Sales engineer")[0::3] == ("Software Engineer", 0.7)
    assert title(" Baker ")[0::3] == ("Baker", 0.5) and title(None)[0] == ""
    seen = lambda skill, said, where: tuple(one(spark, careers.skill_evidence(F.lit(skill), F.lit(said), F.lit(where))))
    assert seen("C++", "never used c++ at work", "Skills") == ("NEGATED_MENTION", False)
    assert seen("Java", "never used JavaScript", "Skills") == ("EXPLICIT_SKILL", True)
    assert seen("Java", "x" * 80, None) == ("CONTEXTUAL_MENTION", False) and seen(None, None, None) == ("EXPLICIT_SKILL", True)
    status = lambda a, b, s: one(spark, careers.employment_status(F.lit(a), F.lit(b), F.lit(s)))
    assert [status(1, 1, ""), status(0, 2, ""), status(0, 0, "Final year"), status(0, 0, None)] == ["Experienced", "Fresher with Internship Experience", "Student / Fresher", "Not specified"]


def test_calendar_durations(spark):
    def took(a, b, said=None):
        return one(spark, careers.calendar_duration(F.lit(a).cast("date"), F.lit(b).cast("date"), F.lit(said).cast("string")))

    assert [took("2024-01-01", x) for x in ("2024-01-01", "2024-01-02", "2024-01-31", "2024-02-01")] == ["0 days", "1 day", "1 month", "1 month"]
    assert [took("2024-01-31", "2024-03-01"), took("2024-01-01", "2024-03-28"), took("2024-01-01", "2024-03-11"), took("2022-05-10", "2024-05-12")] == ["1 month", "3 months", "2 months 10 days", "2 years"]
    assert [took("2024-02-01", "2024-01-01"), took("2024-02-01", "2024-01-01", "a week"), took(None, None, "null")] == ["Duration not specified", "a week", "Duration not specified"]


def test_unwrapped_items_and_links(spark):
    items = lambda *x: one(spark, careers.unwrapped(F.array(*[F.lit(v) for v in x])))
    assert items("Alpha", "goes on", "Beta and", "Gamma", " ", "Delta,", "Eps") == ["Alpha goes on", "Beta and Gamma", "Delta, Eps"]
    assert one(spark, careers.unwrapped(F.lit(None).cast("array<string>"))) == []
    fits = lambda p, u: one(spark, careers.valid_profile_url(F.lit(p), F.lit(u)))
    assert fits("GitHub", "https://github.com/a") and not fits("github", "https://gitlab.com/a") and not fits("portfolio", None) and fits("portfolio", "http://a.org/b")


def test_postings(spark):
    asked = lambda s: tuple(one(spark, postings.experience_asked(F.lit(s))))
    assert [asked("1 year and 6 months"), asked("2-4 years"), asked("6 to 12 months"), asked("six months"), asked("3+ yrs"), asked("any"), asked(None)] == [
        (1.5, "1.5 years"), (2.0, "2-4 years"), (0.5, "6-12 months"), (0.5, "6 months"), (3.0, "3+ years"), (0.0, "Not specified"), (0.0, "Not specified")]
    assert [asked("3 years of C++ experience"), asked("two months C# experience"), asked("Experience: 2+ months\n4 years")] == [(3.0, "3+ years"), (0.1667, "2 months"), (0.1667, "2+ months")]
    title = lambda s: one(spark, postings.title_asked(F.lit(s).cast("string")))
    assert [title("Job Title: Data Analyst required now\nx"), title("We are looking for a Go developer, fast"), title("Hello!\nwe want a senior designer needed"), title("Cloud Architect\nmore"), title("nothing here"), title(None)] == [
        "Data Analyst", "Go developer", "we want a senior designer", "Cloud Architect", "Software Engineer", "Software Engineer"]
    degree = lambda s: one(spark, postings.education_asked(F.lit(s)))
    assert [degree("M.Tech or B.Tech"), degree("BCA"), degree(None)] == ["Master's Degree", "Bachelor's Degree", "Not specified in JD"]


def test_skill_spellings(spark):
    names = spark.createDataFrame([("rest api", "rest apis"), ("react", "react"), ("c++", "c++")], "alias string, canonical string")
    raw = spark.createDataFrame([("• REST-API’s",), ("RestApi",), ("React framework",), ("(C++)",), ("reacts",), ("vim",), ("",), (None,)], "s string")
    got = {r["s"]: r["canonical"] for r in skills.resolve_skills(raw, "s", names).collect()}
    assert got == {"• REST-API’s": "rest apis", "RestApi": "rest apis", "React framework": "react", "(C++)": "c++", "reacts": "react", "vim": "vim", "": "", None: ""}
    assert one(spark, skills.display_name(F.lit("rest apis and_more"))) == "REST APIS And More"


def test_lines_go_on_as_in_sql(spark, tmp_path):
    import duckdb

    from tessella.plans import careers as _  # noqa: F401  registers its queries
    from tessella.plans.registry import ORACLE_SQL, QUERIES

    rows = [
        "que chllaí\nOsado", "a b, \nC\n\n  \n d", "Über und a\nX", "x A\nY", "x_a\nY", "known\nuſing it\nBacKed by", "bacKed by\nAſ well aſ", "a, \nB", "a,\u0085\nB", "a,\x0b\nB",
        "a\x1eb\nC", " \t a \t b \r\n\fC ", "backed\nby\nX", "Etc\netcetera", "Z\netc", "Z\nEtC.", "Z\nETCé", "\n\n", "", None, "–\nX", "(\n[\n{", " a \nB", "Z\n, x", "of\nThe\nA", "x of  \n  THE", " of\nB", "éa\nB",
    ]
    spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["unwrapped_lines"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in db.execute(ORACLE_SQL["unwrapped_lines"]).fetchall()}
    got = {r.doc_id: (r.n_items, r.items_sha256) for r in df.collect()}
    assert got == want, [rows[k] for k in got.keys() | want.keys() if got.get(k) != want.get(k)]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()  # a list looked at once for each of its items grows with its square
