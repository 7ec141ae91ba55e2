"""Implications, equivalences, master skill sets and grounding on small rows that show one rule each."""

from tessella.operators import grounding, implications, master_skills, posting_skills


def skills_of(spark, rows):
    return spark.createDataFrame(rows, "candidate_id int, skill string")


def test_implications_by_division(spark):
    held = skills_of(spark, [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "d")])
    rules = spark.createDataFrame([("all", "a", 2, "x"), ("all", "b", 2, "x"), ("all", "a", 2, "y"), ("all", "b", 2, "y"), ("any", "b", 1, "z"), ("any", "c", 1, "z"), ("any", "c", 1, "c"), ("any", "b", 1, "c")], implications.RULE)
    assert {tuple(r) for r in implications.implied(held, rules).collect()} == {(1, "x"), (1, "y"), (1, "z"), (1, "c"), (3, "z"), (3, "c")}
    assert {tuple(r) for r in implications.effective(held, rules).where("candidate_id = 3").collect()} == {(3, "c", "held"), (3, "z", "implied")}
    known = implications.implied(skills_of(spark, [(1, "fastapi"), (2, "tableau"), (3, "rust")]), implications.known_rules(spark))
    assert {tuple(r) for r in known.collect()} == {(1, "python"), (1, "rest apis"), (2, "data visualization"), (2, "business intelligence"), (2, "reporting")}


def test_equivalent_matches(spark):
    held = skills_of(spark, [(1, "html5"), (1, "algorithms"), (1, "java"), (2, "jwt"), (3, "javascript"), (4, "simple jwt")])
    wanted = spark.createDataFrame([(7, "html"), (7, "data structures & algorithms"), (7, "sql"), (8, "simple jwt"), (8, "java"), (9, "jwt")], "job_id int, skill string")
    got = {(r.candidate_id, r.job_id): (r.matched, r.missing) for r in implications.equivalent_matches(held, wanted, implications.known_alternatives(spark)).collect()}
    assert got == {
        (1, 7): (["data structures & algorithms", "html"], ["sql"]), (1, 8): (["java"], ["simple jwt"]),
        (2, 8): (["simple jwt"], ["java"]), (2, 9): (["jwt"], []), (4, 8): (["simple jwt"], ["java"]),  # javascript is not java, simple jwt does not stand for jwt
    }


def test_role_scores(spark):
    roles = spark.createDataFrame([("r", "a", "core"), ("r", "b", "core"), ("r", "c", "important"), ("r", "d", "recommended"), ("r", "e", "optional"), ("q", "c", "important"), ("q", "z", "core")], "role string, skill string, tier string")
    rules = spark.createDataFrame([("x", "k", 1, "d")], implications.RULE)
    edges = spark.createDataFrame([("a", "b"), ("a", "a")], "src string, dst string")
    held = skills_of(spark, [(1, "a"), (1, "c"), (1, "k"), (2, "c"), (3, "k"), (4, "zz"), (5, "a"), (5, "b"), (5, "c"), (5, "d"), (5, "e")])
    got = {(r.candidate_id, r.role): (r.score, r.n_matched, r.n_half) for r in implications.role_scores(held, roles, rules, edges).collect()}
    # candidate 1: core (1 + 0.5) / 2, important 0.75 / 1 (not under one point), recommended 0.5 / 1
    assert got[1, "r"] == (round(125 * (0.6 * 0.75 + 0.25 * 0.75 + 0.15 * 0.5), 1), 3, 1)
    assert got[5, "r"] == (100.0, 5, 0)  # the plain ratio exceeds the ceiling of 96
    assert got[2, "q"] == got[2, "r"] == (22.5, 1, 0) and got[3, "r"] == (7.5, 1, 0) and (4, "r") not in got


def test_master_skills_of_nested_profiles(spark):
    rows = [
        (1, {"tools": ["Languages: Py, SQL Frontend: HTML / CSS", None], "none": None}, [("P", ["py", None], "made with java and  spring boot"), (None, None, None)],
         [("Acme", "Dev", ["Go"], "Used SQL daily")], "knows Java", ["Java Expert", None], "java, R, go"),
        (2, None, None, None, None, None, None),
        (3, None, [("Q", ["developed a thing with X", "Rust"], "")], None, "rust", None, ""),
    ]
    aliases = spark.createDataFrame([("py", "Python"), ("python", "Python"), ("java", "Java"), ("spring boot", "Spring Boot"), ("r", "R"), ("go", "Go"), ("rust", "Rust")], "alias string, canonical string")
    categories = spark.createDataFrame([("go", "Cloud & Hosting"), ("GO", "Testing & QA"), ("spring boot", "Own")], "skill string, category string")
    master = master_skills.master_skills(spark.createDataFrame(rows, master_skills.PROFILE), aliases, categories)
    got = {(r.candidate_id, r.skill): (r.name, r.category, r.source) for r in master.collect()}
    assert got == {
        (1, "python"): ("Py", "Programming Languages", "EXPLICIT_SKILL"), (1, "sql"): ("SQL", "Databases & Storage", "EXPLICIT_SKILL"),
        (1, "html"): ("HTML", "Frontend Technologies", "EXPLICIT_SKILL"), (1, "css"): ("CSS", "Frontend Technologies", "EXPLICIT_SKILL"),
        (1, "java"): ("Java", "Programming Languages", "CERTIFICATION_EVIDENCE"),  # outweighs the project before it
        (1, "spring boot"): ("Spring Boot", "Own", "PROJECT_EVIDENCE"), (1, "go"): ("Go", "Cloud & Hosting", "EXPERIENCE_TECHNOLOGY"), (3, "rust"): ("Rust", "Programming Languages", "PROJECT_TECHNOLOGY"),
    }  # aliases of one character are not searched for
    matrix = {(r.candidate_id, r.place): (r.category, r.skills) for r in master_skills.skill_matrix(master).collect()}
    assert len(matrix) == 18 + 17 and matrix[1, 0] == ("Programming Languages", ["java", "python"]) and matrix[1, 12] == ("Testing & QA", []) and matrix[1, 17] == ("Own", ["spring boot"])
    assert {r.category for r in master_skills.skill_matrix(master, keep_empty=False).where("candidate_id = 3").collect()} == {"Programming Languages"}


def test_fields_are_taken_only_where_they_stand_in_the_text(spark):
    docs = spark.createDataFrame([(1, "Ana Lopez\nLisbon, Portugal\nBuilt many things for Acme Limited over the years."), (2, None)], "id int, text string")
    held = spark.createDataFrame([(1, "name", "Ana"), (1, "mail", " "), (1, "summary", "Built")], "id int, field string, value string")
    long = "Built many things for Acme Limited over the years."
    asked = [(1, "name", "Bob"), (1, "mail", "a@b.c"), (1, "place", "LISBON, portugal"), (1, "town", "Porto"), (1, "job", "built many things nobody wrote"), (1, "code", "http://x"),
             (1, "blog", "x.org"), (1, "blank", "  "), (1, "none", None), (1, "summary", long), (2, "place", "Lisbon"), (2, "name", "Eve"), (3, "name", "Joe"), (2, "summary", long + " Skills"), (3, "summary", "Acme")]
    policy = {"place": grounding.GROUNDED, "town": grounding.GROUNDED, "job": grounding.GROUNDED, "code": grounding.LINKED, "blog": grounding.LINKED, "summary": grounding.LONGER}
    rows = grounding.resolve_fields(docs, held, spark.createDataFrame(asked, "id int, field string, value string"), "id", "text", policy).collect()
    assert {(r.id, r.field): r.decision for r in rows} == {
        (1, "name"): "held", (1, "mail"): "accepted", (1, "place"): "accepted", (1, "town"): "not grounded", (1, "job"): "accepted", (1, "code"): "accepted", (1, "blog"): "no link",
        (1, "summary"): "accepted", (2, "place"): "not grounded", (2, "name"): "accepted", (3, "name"): "accepted", (2, "summary"): "stray end", (3, "summary"): "not grounded"}


def test_skills_that_are_only_wished_for(spark):
    docs = spark.createDataFrame([(1, "I want to learn Rust\nnever used Go\nGo and SQL daily\nnever used C++\nJavaScript"), (2, "")], "id int, text string")
    asked = spark.createDataFrame([(1, s) for s in ("Rust", "go", "c++", "Java", "SQL")] + [(2, "x"), (3, "y"), (1, None)], "id int, skill string")
    got = {(r.id, r.skill): (r.n_mentions, r.n_plain, r.supported) for r in grounding.supported_skills(docs, asked, "id", "text").collect()}
    assert got == {(1, "Rust"): (1, 0, False), (1, "go"): (2, 1, True), (1, "c++"): (1, 0, False), (1, "Java"): (0, 0, True), (1, "SQL"): (1, 1, True), (2, "x"): (0, 0, True), (3, "y"): (0, 0, True)}


def test_skills_of_postings(spark):
    rows = [(1, "We need Python’s and (C++), node.js. Nice to have: Go, python or React Native"), (2, "Preferred: SQL"), (3, "SQL only. SQL!"), (4, None), (5, "javascript, pythonic"), (6, "ML here; bonus machine learning")]
    names = [("python", "Python"), ("c++", "C++"), ("node.js", "Node"), ("go", "Go"), ("react native", "React Native"), ("sql", "SQL"), ("java", "Java"), ("or", "Or"), ("r", "R"), ("ml", "Machine Learning"), ("machine learning", "Machine Learning")]
    found = posting_skills.posting_skills(spark.createDataFrame(rows, "id int, body string"), "id", "body", spark.createDataFrame(names, "alias string, canonical string"))
    assert {(r.id, r.skill): r.tier for r in found.collect()} == {
        (1, "Python"): "preferred", (1, "C++"): "required", (1, "Node"): "required", (1, "Go"): "preferred", (1, "React Native"): "preferred",
        (2, "SQL"): "preferred", (3, "SQL"): "required", (6, "Machine Learning"): "required"}


def test_best_equivalent(spark):
    from tests.test_pairs import planned

    alternatives = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "z")], "target string, alternative string")
    held = skills_of(spark, [(1, "b"), (1, "b"), (1, "z"), (2, "a"), (2, "d"), (3, "zz"), (4, "c")])
    wanted = spark.createDataFrame([(7, "a"), (7, "c"), (8, "a"), (9, "d"), (9, "b"), (9, "e"), (10, "a")], "job_id int, skill string")
    got = implications.best_equivalent(held, wanted, alternatives, 2)
    assert sorted((r.candidate_id, r.job_id, r.n_matched, r.n_missing, r.matched) for r in got.collect()) == [
        (1, 7, 2, 0, ["a", "c"]), (1, 8, 1, 0, ["a"]), (2, 8, 1, 0, ["a"]), (2, 9, 2, 1, ["b", "d"]), (4, 7, 1, 1, ["c"])]  # 8 and 10 are equal for 2: the smaller id
    whole = implications.equivalent_matches(held, wanted, alternatives)
    assert {(r.candidate_id, r.job_id) for r in got.collect()} <= {(r.candidate_id, r.job_id) for r in whole.collect()}
    assert "FlatMapCoGroupsInArrow" in planned(got) and planned(whole) != planned(got)  # pairs stay inside blocks
