"""Sections, jobs and degrees out of lines, on small documents that show one rule each."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessella.functions import dates
from tessella.operators import degrees, folds, headers, jobs, sections

RESUME = """Ana Lopez
x@y.z

--- CAREER OBJEC TIVE ---
To work

Technical
Skills
Python
SKILLS
more
Work Experience:
job a
1. EDUCATION
B.Tech
Skills
SQL
Hobbies
chess
I hereby declare that all is true
and more
Declaration
second"""


def found(spark, text):
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    return {r.section: (r.header, r.first_line, r.body) for r in headers.detect_sections(docs, "id", "text").collect()}


def test_sections(spark):
    assert found(spark, RESUME) == {
        "personal_info_header": (None, 0, "Ana Lopez\nx@y.z"),
        "summary": ("--- CAREER OBJEC TIVE ---", 2, "To work"),  # the blank line before heads it together with it
        "skills": ("Technical Skills", 6, "Python\nSKILLS\nmore\nSQL"),  # two lines; an equal header is text; a later section is added
        "experience": ("Work Experience:", 11, "job a"),
        "education": ("1. EDUCATION", 13, "B.Tech"),
        "interests": ("Hobbies", 17, "chess"),
        "declaration": ("Declaration", 17, "I hereby declare that all is true\nand more\nsecond"),
    }
    assert found(spark, "no headers\n here ") == {"full_text": (None, 0, "no headers\n here ")}
    assert found(spark, None) == found(spark, "") == {}
    assert found(spark, "Skills") == {"skills": ("Skills", 0, "")}
    assert found(spark, "Skills\n\nEducation\nx\nSkills\na\nEducation\nProjects\nb\nSkills\nc")["skills"] == ("Skills", 0, "a\nc")
    assert found(spark, "Hobbies\nhereby declare a\nDeclaration\nb\nLanguages\nx I hereby declare c")["declaration"][2] == "hereby declare a\nb"
    assert "skills" not in found(spark, "my skills are many and they do not fit into a header of sixty letters")


@pytest.mark.parametrize("run", [1, 2, 3, 256])
def test_scan_carries_state(spark, run):
    rows = spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7],), ([],), (None,), ([9],)], "x array<int>")
    got = [r[0] for r in rows.select(folds.scan(F.col("x"), F.struct(F.lit(0).alias("n")), lambda s, x: F.struct((s["n"] + x).alias("n")), run)).collect()]
    assert [g and [s.n for s in g] for g in got] == [[1, 3, 6, 10, 15, 21, 28], [], None, [9]]


TITLES = ["Software Engineer", "Senior Software Engineer", "Data Analyst", "Developer"]


def jobs_of(spark, text, internship=False):
    lines = sections.lines_of(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    rows = jobs.jobs(jobs.job_signals(lines, TITLES, F.lit(internship)), "id", F.lit(datetime.date(2024, 1, 1)))
    return [(r.title, r.employer, r.place, r.start, r.end, r.duration, r.months, r.internship, r.duties) for r in rows.orderBy("job").collect()]


def test_jobs_carry_state(spark):
    text = """Senior Software Engineer | Acme Pivate Limited.
Jan 2019 - Mar 2021
- Built pipelines for
the whole company.
and in between
led two teams
Data Analyst at Beta Works
2 months
Chennai
Developed a report
Developer
Gamma Labs
June 2021 to Present
* wrote tests"""
    assert jobs_of(spark, text) == [
        ("Senior Software Engineer", "Acme Private Limited", None, "Jan 2019", "Mar 2021", None, 26, False, ["Built pipelines for the whole company.", "and in between led two teams"]),
        ("Data Analyst", "Beta Works", "Chennai", None, None, "2 months", None, False, ["Developed a report"]),
        ("Developer", "Gamma Labs", None, "June 2021", "Present", None, 31, False, ["wrote tests"]),
    ]


def test_several_jobs_at_one_employer_and_stops(spark):
    text = """Acme Corp, Lisbon
Software Engineer
2015 - 2017
Data Analyst
2017 - 2018
Projects
a parser
Beta Inc | Data Analyst Intern
while studying
ok"""
    assert jobs_of(spark, text) == [
        ("Software Engineer", "Acme Corp", "Lisbon", "2015", "2017", None, 24, False, []),
        ("Data Analyst", None, None, "2017", "2018", None, 12, False, []),
        ("Data Analyst Intern", "Beta Inc", None, None, None, None, None, True, ["while studying ok"]),
    ]


def test_internships(spark):
    text = """Web Development Intern | Infogro Technology, Maduravoyal
17 Apr 2026 – 18 May 2026
Completed three months of training"""
    assert jobs_of(spark, text, True) == [("Web Development Intern", "Infogro Technology", "Maduravoyal", "17 Apr 2026", "18 May 2026", None, 1, True, []), (None, None, None, None, None, "3 months", None, True, [])]  # a duration opens one where the last has its dates
    assert jobs_of(spark, "one month\nSummer Intern", True) == [("Summer Intern", None, None, None, None, "1 month", None, True, [])]
    assert jobs_of(spark, "one month\n- x", False) == []
    assert jobs_of(spark, "") == []


def test_dates(spark):
    texts = ["2019-03-04", "2019/3/4", "04/03/2019", "3/2019", "March 2019", "17 Apr 2019", "April 17 2019", "in 2019", "now", "Feb 31 2019", "13/2019", "x", None, "Sept. 2019"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] and r[0].isoformat() for r in rows.orderBy("i").select(dates.parse_date(F.col("t"), F.lit(datetime.date(2024, 1, 1)))).collect()]
    assert got == ["2019-03-04", "2019-03-04", "2019-03-04", "2019-03-01", "2019-03-01", "2019-04-17", "2019-04-17", "2019-01-01", "2024-01-01", None, "2019-01-01", None, None, "2019-09-01"]
    ranges = rows.limit(1).select(dates.date_ranges(F.lit("17 Apr 2019 – 18 May 2020, 06/2018 - 12/2021; 2019 to Present"))).first()[0]
    assert [tuple(r) for r in ranges] == [("17 Apr 2019", "18 May 2020"), ("06/2018", "12/2021"), ("2019", "Present")]


def degrees_of(spark, text):
    lines = sections.lines_of(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    found = degrees.merge_degrees(degrees.fold_degrees(degrees.degree_signals(lines, 2024, ("Computer Science", "Physics")), "id"), "id")
    return [(r.degree, r.tier, r.major, r.institution, r.place, r.started, r.ended, r.score, r.score_kind, r.status) for r in found.orderBy("entry").collect()]


def test_degrees_carry_state(spark):
    text = """Hill College of Arts, Lisbon
B.Sc. Computer Science
2019 - 2022
CGPA: 8.8
HSC
Green Matric School
Percentage: 81
SSLC 2017 completed
79.5%
B.S. 2020 - 2023
M.Tech expected 2026
State University"""
    assert degrees_of(spark, text) == [
        ("B.Sc.", degrees.DEGREE, "Computer Science", "Hill College of Arts", "Lisbon", 2019, 2022, "8.8", "CGPA", degrees.COMPLETED),  # B.S. is the same degree
        ("Higher Secondary", degrees.HIGHER, None, "Green Matric School", None, None, None, "81%", "Percentage", None),
        ("SSLC", degrees.SECONDARY, None, "Green Matric School", None, None, 2017, "79.5%", "Percentage", degrees.COMPLETED),  # the last school
        ("M.Tech", degrees.DEGREE, None, "State University", None, None, 2026, None, None, degrees.PURSUING),
    ]


def test_degrees_institutions_wait_for_their_kind(spark):
    assert [d[:4] for d in degrees_of(spark, "Green School\nB.Tech\nHill College\nSSLC\nClass X")] == [
        ("B.Tech", degrees.DEGREE, None, "Hill College"), ("SSLC", degrees.SECONDARY, None, "Green School")]
    assert degrees_of(spark, "no degree\nHill College") == degrees_of(spark, "") == []
    assert [d[8:] for d in degrees_of(spark, "MBA 2015\nGPA 3.5\n70%\nPh.D. present")] == [("Percentage", None), (None, degrees.PURSUING)]
