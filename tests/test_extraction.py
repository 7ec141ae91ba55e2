"""Line, profile and model operators on small rows."""

from pyspark.sql import functions as F

from tessella.operators import models, profiles, sections

RESUME = """Ana Maria Lopez
Lisbon, Portugal
EXPERIENCE
Data Engineer at Acme Ltd
Jan 2019 - Mar 2021
- built pipelines
Intern at Beta | 2018 - 2019
* wrote tests
E D U C A T I O N
B.Tech, Hill University, 2018
CGPA: 8.5
Languages
English, german; English
Projects
Parser: reads files
Tech: Python, C++
- fast"""
HEADERS = {"experience": "experience", "education": "education", "languages": "languages", "projects": "projects"}


def placed(spark, section):
    docs = spark.createDataFrame([(1, RESUME), (2, None), (3, "")], "id long, text string")
    lines = sections.lines_of(docs, "id", "text")
    parts = sections.split_sections(lines, "id", sections.header_of(F.col("line"), HEADERS))
    return sections.lines_of(parts.where(F.col("section") == section), "id", "body")


def test_sections_and_records(spark):
    jobs = sections.experience(placed(spark, "experience"), "id", ["Data Engineer", "Intern"]).orderBy("record").collect()
    assert [(j.title, j.company, j.internship, j.responsibilities) for j in jobs] == [
        ("Data Engineer", "Acme Ltd", False, ["built pipelines"]), ("Intern", "Beta", True, ["wrote tests"])]
    assert jobs[0].period == "Jan 2019 - Mar 2021"
    degree = sections.education(placed(spark, "education"), "id", 2024).first()
    assert (degree.institution, degree.year, degree.gpa, degree.status) == ("Hill University", 2018, "8.5", "completed")
    assert {r.item for r in sections.list_items(placed(spark, "languages"), "id").collect()} == {"English", "german"}
    project = sections.projects(placed(spark, "projects"), "id").first()
    assert (project.title, project.technologies, project.n_details) == ("Parser", "Python, C++", 2)
    top = sections.name_and_place(placed(spark, "personal_info_header"), "id").first()
    assert (top.name, top.location) == ("Ana Maria Lopez", "Lisbon, Portugal")


def test_terms(spark):
    lines = spark.createDataFrame([(1, 0, "C++ and machine learning"), (1, 3, "more c++"), (2, 0, "x")], "id long, line_no int, line string")
    taxonomy = spark.createDataFrame([("c++", "C++"), ("machine learning", "ML")], "term string, skill string")
    found = {(r.id, r.skill): (r.first_line, r.n) for r in sections.find_terms(lines, "id", taxonomy).collect()}
    assert found == {(1, "C++"): (0, 2), (1, "ML"): (0, 1)}


def test_profiles(spark):
    rows = spark.createDataFrame([(1, None, 3), (2, "x", None)], "id long, name string, n int")
    checked = profiles.structural_warnings(rows, {"no name": F.col("name").isNull(), "few": F.col("n") < 5}).orderBy("id").collect()
    assert [(r.warnings, r.score, r.valid) for r in checked] == [(["no name", "few"], 0.9, True), ([], 1.0, True)]
    other = spark.createDataFrame([(1, "y", 2)], "id long, name string, n int")
    lost = {r.id: r.lost for r in profiles.information_loss(rows, other, "id", ["name"], ["n"]).collect()}
    assert lost == {1: ["n"], 2: ["name"]}
    merged = profiles.merge_sources(rows, other, "id", {"name": F.col("s_name") == "z", "n": F.lit(True)}).orderBy("id").collect()
    assert [(r.name, r.n, r.proposed, r.accepted, r.rejected) for r in merged] == [(None, 3, 1, 0, 1), ("x", None, 0, 0, 0)]
    aliases = spark.createDataFrame([("js", "a"), ("zz", "none")], "alias string, skill string")
    tables = profiles.taxonomy_tables(spark.createDataFrame([(7, "r", ["a", "b"])], "role_id long, role string, skills array<string>"), aliases)
    assert tables["roles"].first().skills == "a;b" and tables["aliases"].where("skill_id = 0").first().alias == "zz"


def test_models(spark):
    rows = spark.createDataFrame([(i, "spark sql data" if i % 3 else "paint brush art", "eng" if i % 3 else "art", float(i % 3)) for i in range(60)], "id long, body string, role string, score double")
    split = models.stratified_split(rows, "id", "role")
    assert split.where("held_out").groupBy("role").count().count() == 2
    train, test = split.where("NOT held_out"), split.where("held_out")
    model = models.text_classifier("body", "role", features=50).fit(models.class_weights(train, "role"))
    assert models.top_classes(model, test, 2).where(F.col("classes")[0]["name"] != F.col("role")).count() == 0
    svc = models.text_classifier("body", "role", features=50, margin=True).fit(models.class_weights(train, "role"))
    assert svc.transform(test).where("prediction <> label").count() == 0
    stages = models.mixed_features("body", ["role"], ["score"], 50)
    scored = models.score_model(stages, "score", 3).fit(train).transform(test)
    assert models.residual_band(scored, "score", "role").count() == 2
