"""Column helpers and operators on small rows, and every query against its SQL."""

import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.functions import dates, labels, text
from tessella.operators import audit, match, metrics, records, skills
from tessella.plans import careers, registry, talent  # noqa: F401  careers and talent register their queries
from tessella.sources import io
from tessella.streaming import funnel

SMALL = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_text_helpers(spark):
    assert one(spark, text.strip_html(F.lit("<p>a<br>b </p>\n c"))) == "a b c"
    assert one(spark, text.strip_html(F.lit(None).cast("string"))) == ""
    assert one(spark, text.hash_form(F.lit("  Ab-C d! "))) == "ab c d"
    assert one(spark, text.clean_resume_text(F.lit("a\r\n\r\n\r\n\r\nb-\nc •"))).startswith("a\n\nb")
    assert one(spark, text.split_list(F.lit(" a, ,b "))) == ["a", "b"]
    assert one(spark, text.ordered_unique(F.array(*map(F.lit, ("React", "x", "react"))))) == ["React", "x"]
    assert one(spark, text.emails(F.lit("to a.b@c.org or x@"))) == ["a.b@c.org"]
    assert one(spark, text.phones(F.lit("call +49 (30) 123-4567 in 2019"))) == ["+49 (30) 123-4567"]
    assert one(spark, text.is_email(F.lit("a@b.co"))) and not one(spark, text.is_email(F.lit("a@b")))
    assert one(spark, text.is_url(F.lit("https://x.org/a"))) and not one(spark, text.is_url(F.lit(None).cast("string")))


def test_labels_and_dates(spark):
    assert one(spark, labels.banded(F.lit(65.0), labels.FIT_BANDS, labels.FIT_BELOW)) == "Potential Candidate"
    assert one(spark, labels.first_match(F.lit("lead dev"), (("lead", "Lead"), ("dev", "Dev")), "?")) == "Lead"
    assert one(spark, labels.all_matches(F.lit("zzz"), (("a", "A"),), "none")) == ["none"]
    start, end = F.lit("2020-01-01").cast("date"), F.lit("2021-03-01").cast("date")
    months = dates.months_between_days(start, end)
    assert one(spark, months) == 14 and one(spark, dates.display(months)) == "1 year 2 months"
    assert one(spark, dates.months_between_days(end, start)) is None
    as_of = F.lit("2024-05-01").cast("date")
    assert one(spark, dates.parse_date(F.lit("Present"), as_of)) == datetime.date(2024, 5, 1)
    assert one(spark, dates.parse_date(F.lit("2021"), as_of)) == datetime.date(2021, 1, 1)
    assert one(spark, dates.parse_date(F.lit("soon"), as_of)) is None


def test_skills(spark):
    aliases = {"react": "react", "nodejs": "node.js"}
    assert one(spark, skills.normalize(F.lit(" Node.JS "), aliases)) == "node.js"
    assert one(spark, skills.normalize(F.lit("C++"), aliases)) == "c++"
    gap = one(spark, skills.gap(F.array(F.lit("a"), F.lit("c")), F.array(F.lit("a"), F.lit("b"))))
    assert (gap["matched"], gap["missing"], gap["additional"], gap["match_pct"]) == (["a"], ["b"], ["c"], 50.0)
    rows = spark.createDataFrame([(1, "x", 1, 2), (1, "x", 2, 9), (1, "x", 2, 5)], "candidate_id int, skill string, priority int, seq int")
    assert [r["seq"] for r in skills.best_evidence(rows).collect()] == [5]
    held = spark.createDataFrame([(1, "a"), (1, "b")], "candidate_id int, skill string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    assert [r["skill"] for r in skills.one_hop(held, edges).collect()] == ["c"]
    vocabulary = spark.createDataFrame([("reactjs", "react")], "alias string, canonical string")
    got = skills.normalize_rows(spark.createDataFrame([("(ReactJS)",), ("vim",)], "s string"), "s", vocabulary)
    assert {r["skill_key"] for r in got.collect()} == {"react", "vim"}


def test_scores_and_ranks(spark):
    assert one(spark, match.experience_part(F.lit(1.0), F.lit(4.0))) == 0.35
    assert [one(spark, match.experience_part(F.lit(y), F.lit(w).cast("double"))) for y, w in ((0.0, 0.0), (0.5, None), (1.0, 0.0), (0.2, 0.0), (0.0, -1.0))] == [0.30, 0.5, 1.0, 0.35, 1.0]
    assert one(spark, match.present_mean({"skills": F.lit(None).cast("double"), "experience": F.lit(50.0), "education": F.lit(50.0)}, match.JD_WEIGHTS)) == pytest.approx(50.0)
    rows = spark.createDataFrame([(1, 3, 5.0), (1, 1, 5.0), (1, 2, 9.0)], "job int, cand int, score double")
    assert [r["cand"] for r in match.ranked(rows, "job", "cand").orderBy("rank").collect()] == [2, 1, 3]
    assert one(spark, match.role_score(F.lit(0.0), F.lit(1.0), F.lit(0.0))) == 30.0


def test_audits_and_metrics(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", None)], "g string, h string")
    assert {(r["g"], r["duplicates"]) for r in audit.duplicate_summary(rows, "g", "h").collect()} == {("a", 1), ("b", 0)}
    assert [r["shared"] for r in audit.pairwise_overlap(rows, "g", "h").collect()] == [0]
    assert {r["column_name"]: r["nulls"] for r in audit.null_inventory(rows).collect()} == {"g": 0, "h": 1}
    pred = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.8), (0, 0, 0.1), (1, 0, 0.8)], "y int, p int, s double")
    assert {(r["cls"], r["f1"]) for r in metrics.class_report(pred, "y", "p").collect()} == {(0, 0.5), (1, 0.5)}
    assert metrics.roc_auc(pred, "y", "s").first()["auc"] == 0.875
    assert metrics.regression_report(pred, "y", "s").first()["mae"] == 0.3
    empty = rows.where("false")
    assert audit.duplicate_summary(empty, "g", "h").count() == 0


def test_records(spark):
    log = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "id int, v int, gone boolean")
    assert [r["id"] for r in records.latest(log, "id", ["v"], F.col("gone")).collect()] == [2]
    assert [(r.id, r.v) for r in records.insert_if_absent(log.where("id = 1"), log.unionByName(log.where("id = 2").withColumn("v", F.lit(0))), ["id"], ["v"]).orderBy("id", "v").collect()] == [(1, 1), (1, 2), (2, 0)]
    assert [r["n"] for r in records.funnel(log, "id", ("1", "9")).orderBy("stage_no").collect()] == [2, 0]
    assert records.search(log.withColumn("t", F.lit("AbC")), "bc", ["t"]).count() == 3
    assert records.search(log, "", []).count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n')
    good, bad = io.split_rejects(io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int"))
    assert good.count() == 1 and bad.select("line").first()[0] == "not json"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "l.txt").write_bytes("caf\xe9 x".encode("latin-1"))
    row = io.read_text_files(spark, str(tmp_path / "t")).first()
    assert row["text"] == "caf\xe9 x" and row["n_chars"] == 5
    io.write_by_task(spark.createDataFrame([(1, ["a", "b"])], "id int, tasks array<string>"), str(tmp_path / "out"))
    assert sorted(x for x in os.listdir(tmp_path / "out") if x.startswith("task=")) == ["task=a", "task=b"]


def test_stream_agrees_with_batch(spark, tmp_path):
    events = io.read_table(spark, SMALL, "events")
    (tmp_path / "in").mkdir()
    os.symlink(f"{SMALL}/events.parquet", tmp_path / "in" / "e.parquet")
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = funnel.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("live").agg(F.sum("n")).first()[0] == events.count()
    assert funnel.distinct_events(events).count() == events.select("event_id").distinct().count()
    assert funnel.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def _plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{t}'")
    df = registry.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(str(_plain(r[c])) for c in cols) for r in df.collect()))
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(str(_plain(r[names.index(c)])) for c in cols) for r in found.fetchall())
    assert got == want


def test_model_queries_score_every_row(spark):
    parts = registry.QUERIES["brand_classifier"](spark, SMALL)
    assert parts.count() == parts.where("confidence BETWEEN 0 AND 1").count() == io.read_table(spark, SMALL, "part").count()
    orders = registry.QUERIES["screening_model"](spark, SMALL)
    assert orders.count() == orders.where("prediction IN (0, 1)").count() == io.read_table(spark, SMALL, "orders").count()
