"""Classes of education records, one rule a row."""

from tessella.functions import education

ROWS = [
    ("school", {"stated": " School ", "degree": "B.Tech"}), ("other", {"stated": "other", "degree": "B.Tech"}), ("school", {"level": "Higher Secondary", "degree": "B.Tech"}),
    ("school", {"type": "high school"}), ("school", {"institution_type": "School/Secondary"}), ("school", {"classification": "school", "degree": "MBA"}), ("school", {"degree": "HSC (Class 12)"}),
    ("school", {"qualification": "SSLC"}), ("school", {"qualification_type": "Higher_Secondary"}), ("degree", {"degree": "B.Sc. Physics"}), ("degree", {"qualification": "Diploma in Design"}),
    ("degree", {"category": "Ph.D"}), ("other", {"degree": "Member of a club"}), ("degree", {"classification": "degree"}), ("degree", {"level": "College/University"}), ("degree", {"type": "college"}),
    ("school", {"institution": "Green Matriculation School"}), ("degree", {"institution": "Hill Institute of Arts"}), ("other", {"institution": "Hill"}), ("other", {}), ("degree", {"degree": "Mastery", "institution": "College"}),
]


def frame(spark, rows):
    schema = "id int, who int, " + ", ".join(f"{f} string" for f in education.FIELDS)
    return spark.createDataFrame([(i, i % 2, *[r.get(f) for f in education.FIELDS]) for i, (_, r) in enumerate(rows)], schema)


def test_classes(spark):
    df = frame(spark, ROWS)
    got = [r[0] for r in df.withColumn("class", education.education_class(df)).orderBy("id").select("class").collect()]
    assert got == [c for c, _ in ROWS]
    few = df.select("id", "degree")  # absent columns say nothing
    assert few.select(education.education_class(few).alias("c")).where("c = 'school'").count() == 1


def test_counts_and_audit(spark):
    rows = [("degree", {"stated": "degree", "degree": "BCA"}), ("school", {"stated": "degree", "degree": "SSLC"}), ("other", {})]
    df = frame(spark, rows)
    counts = {r.who: (r.degree_count, r.school_count, r.other_count, r.total_count) for r in education.education_counts(df.withColumn("class", education.education_class(df)), "who").collect()}
    assert counts == {0: (1, 0, 1, 2), 1: (1, 0, 0, 1)}
    audit = {r.who: (r.valid, r.total_records, r.issues) for r in education.education_audit(df, "who", "id").collect()}
    assert audit == {0: (True, 2, []), 1: (False, 1, ["SSLC: degree is school"])}
