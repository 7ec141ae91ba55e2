"""Class profiles, quantile boosting and calibration on small rows; models are judged on rows they have not seen."""

import math
import random

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessella.operators import boosting, calibration, centroids, models


def test_class_profiles_and_nearest_classes(spark):
    rows = [(1, "a", "red green red"), (2, "a", "red blue"), (3, "b", "green green x"), (4, None, "blue blue"), (5, "b", None), (6, "a", "zz")]
    docs = spark.createDataFrame(rows, "id int, label string, text string")
    profiles = centroids.class_profiles(docs, "label", "text", features=3, longest=1)
    got = {r.term: (round(r.idf, 6), {x.label: x.w for x in r.weights}) for r in profiles.collect()}
    assert set(got) == {"red", "green", "blue"}  # words of one character are none; zz comes after blue by name
    both, one = math.log(3 / 3) + 1, math.log(3 / 2) + 1
    w = {"red": (1 + math.log(3)) * one, "green": both, "blue": one}
    norm = math.sqrt(sum(x * x for x in w.values()))
    assert got["green"][0] == round(both, 6) and abs(got["red"][1]["a"] - w["red"] / norm) < 1e-12 and got["green"][1]["b"] == 1.0
    near = {(r.id, r.rank): (r.label, r.cosine) for r in centroids.nearest_classes(docs, "id", "text", profiles, 1, longest=1).collect()}
    assert {k[0]: v[0] for k, v in near.items()} == {1: "a", 2: "a", 3: "b", 4: "a"} and near[3, 1][1] == 1.0
    assert near[4, 1][1] == round(w["blue"] / norm, 9)
    bigrams = docs.limit(1).select(centroids.terms(F.lit("The Red, and blue"), 2, ("the",)), centroids.terms(F.lit(None).cast("string"), 3)).first()
    assert bigrams[0] == ["red", "and", "blue", "red and", "and blue"] and bigrams[1] == []


def test_quantile_bands_cover_held_out_rows(spark):
    draw = random.Random(5)
    rows = []
    for i in range(3000):
        x, z = draw.uniform(0, 10), draw.choice([0.0, 1.0])
        rows.append((i, x, z, 3 * x + 10 * z + draw.expovariate(1) * (1 + x)))
    df = VectorAssembler(inputCols=["x", "z"], outputCol="v").transform(spark.createDataFrame(rows, "id int, x double, z double, y double"))
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    lower, upper = (boosting.quantile_boost(train, "v", "y", a, rounds=22, rate=0.2, least=20) for a in (0.15, 0.85))
    band = boosting.band_of(test, lower, upper)
    below, above, width, start = band.agg(F.avg((F.col("y") < F.col("lo")).cast("int")), F.avg((F.col("y") > F.col("hi")).cast("int")), F.avg((F.col("hi") - F.col("lo")) * (F.col("x") > 5).cast("int")), F.avg((F.col("hi") - F.col("lo")) * (F.col("x") <= 5).cast("int"))).first()
    assert abs(below - 0.15) < 0.03 and abs(above - 0.15) < 0.03 and width > 1.5 * start  # the spread grows with x
    flat = boosting.QuantileModel(0.85, upper.start, 0.2, "v")
    loss = lambda m: m.transform(test, "q").agg(F.avg(boosting.pinball(F.col("y"), F.col("q"), 0.85))).first()[0]
    assert loss(upper) < 0.6 * loss(flat)
    empty = boosting.quantile_boost(train.where("false"), "v", "y", 0.5, rounds=2)
    assert empty.trees == [] and empty.transform(test).where("quantile = 0").count() == test.count()


def test_sigmoids_of_all_groups_at_once(spark):
    draw = random.Random(8)
    rows = [(g, m, draw.random() < 1 / (1 + math.exp(-(a * m + b)))) for g, (a, b) in enumerate([(2.0, -1.0), (0.5, 1.0)]) for m in (draw.gauss(0, 2) for _ in range(6000))]
    rows += [(2, float(i), i > 10) for i in range(20)]  # split cleanly: stays finite
    found = calibration.fit_sigmoids(spark.createDataFrame(rows, "grp int, margin double, hit boolean"))
    assert abs(found[0][0] - 2) < 0.2 and abs(found[0][1] + 1) < 0.2 and abs(found[1][0] - 0.5) < 0.1 and abs(found[1][1] - 1) < 0.1 and 0.1 < found[2][0] < 50
    assert calibration.fit_sigmoids(spark.createDataFrame([], "grp int, margin double, hit boolean")) == {}


def test_calibration_lowers_the_loss_on_held_out_rows(spark):
    draw = random.Random(13)
    words = {0: "red green", 1: "blue green", 2: "black white"}
    rows = []
    for i in range(1500):
        y = draw.choice([0, 0, 1, 2])
        said = [draw.choice(words[y if draw.random() < 0.5 else draw.randrange(3)].split()) for _ in range(6)]
        rows.append((i, y, " ".join(said)))
    df = models.class_weights(spark.createDataFrame(rows, "id int, y int, body string"), "y")
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    svc = lambda part: models.text_classifier("body", "y", features=100, margin=True).fit(part)
    index = svc(train).stages[0].labels  # classes by frequency
    named = F.array_position(F.array(*[F.lit(x) for x in index]), F.col("y").cast("string")) - 1
    made = calibration.calibrate(train.withColumn("k", named), "id", "k", svc)
    out = made.transform(test.withColumn("k", named))
    plain = calibration.Calibrated(made.models, {}, 3, "rawPrediction").transform(test.withColumn("k", named))  # the same margins as they are
    loss = out.agg(F.avg(calibration.log_loss(F.col("chances"), F.col("k")))).first()[0]
    assert loss < plain.agg(F.avg(calibration.log_loss(F.col("chances"), F.col("k")))).first()[0]
    assert loss < 0.9 * math.log(3) and out.where("abs(aggregate(chances, 0D, (s, x) -> s + x) - 1) > 1e-9").count() == 0
    forest = calibration.calibrate(train.withColumn("k", named), "id", "k", lambda p: models.decision_model(models.mixed_features("body", [], ["id"], 50), "k", 10, weight="weight").fit(p), "probability")
    assert forest.transform(test.withColumn("k", named)).agg(F.avg(calibration.log_loss(F.col("chances"), F.col("k")))).first()[0] < 0.95 * math.log(3)


def test_profiles_keep_the_most_frequent_terms_in_chunks_of_any_size(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(i, draw.choice("ab") if i % 9 else None, " ".join(f"w{min(int(draw.expovariate(0.12)), 40)}" for _ in range(draw.randrange(30)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "id int, label string, text string").repartition(5)
    held = docs.where("label IS NOT NULL").select("label", F.explode(centroids.terms(F.col("text"), 3, ("w3",))).alias("term"))
    want = {(r.term, r.label): r.n for r in held.groupBy("term", "label").agg(F.count("*").alias("n")).collect()}
    total = {t: sum(n for (s, _), n in want.items() if s == t) for t, _ in want}
    best = sorted(total, key=lambda t: (-total[t], t))[:60]
    for chunk in (40, 1_000_000):
        monkeypatch.setattr(centroids, "CHUNK", chunk)
        profiles = centroids.class_profiles(docs, "label", "text", 60, 3, ("w3",))
        got = {r.term: {x.label: x.w for x in r.weights} for r in profiles.collect()}
        assert set(got) == set(best) and all({x for x in "ab" if (t, x) in want} == set(got[t]) for t in best)
        idf = {t: math.log(3 / (1 + len(got[t]))) + 1 for t in best}
        raw = {(t, x): (1 + math.log(want[t, x])) * idf[t] for t in best for x in got[t]}
        norm = {x: math.sqrt(sum(w * w for (_, y), w in raw.items() if y == x)) for x in "ab"}
        assert all(abs(got[t][x] - w / norm[x]) < 1e-12 for (t, x), w in raw.items())
    near = centroids.nearest_classes(docs, "id", "text", profiles, 2, 3, ("w3",))
    own = docs.select("id", F.explode(centroids.terms(F.col("text"), 3, ("w3",))).alias("term")).groupBy("id", "term").count().collect()
    dots, length = {}, {}
    for r in own:
        if r.term in got:
            v = (1 + math.log(r["count"])) * idf[r.term]
            length[r.id] = length.get(r.id, 0) + v * v
            for x, w in got[r.term].items():
                dots[r.id, x] = dots.get((r.id, x), 0) + v * w
    found = {(r.id, r.label): (r.cosine, r["rank"]) for r in near.collect()}
    assert found.keys() == dots.keys() and all(abs(c - dots[k] / math.sqrt(length[k[0]])) < 1e-8 for k, (c, _) in found.items())
    assert "Exchange" not in near._jdf.queryExecution().optimizedPlan().toString() and "Aggregate" not in near._jdf.queryExecution().optimizedPlan().toString()  # a text stays in its row
    assert len(centroids.frequent_terms(docs.select(F.col("text").alias("said")), 20, 3, ())) < len(total)  # rare terms stay where they are


def test_word_vectors_are_those_of_the_stages(spark):
    rows = [(i, t) for i, t in enumerate(["Red green, red", "blue C++ green", "", None, "x blue  blue #1", "ÄRed"])]
    df = spark.createDataFrame(rows, "id int, body string")
    stages = models.Pipeline(stages=models._text_stages("body", 1, 50)).fit(df.fillna(""))
    values = lambda rows: {r.id: sorted(r.features.values.tolist()) for r in rows.collect()}
    got = models.word_vectors(df, "body", 50)
    assert values(got) == values(stages.transform(df.fillna(""))) and got.columns == ["id", "features"]
    assert "UDF" not in got.select("features")._jdf.queryExecution().analyzed().toString().split("LogicalRDD")[-1]  # tokens are behind the checkpoint
    assert models.word_vectors(df, "body", 2).first().features.size == 2


def test_class_weights_leave_rows_where_they_are(spark):
    df = spark.range(90).repartition(9).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    out = models.class_weights(df, "y")
    assert out.rdd.getNumPartitions() == 9  # not a partition for a class
    assert {(r.y, r.weight) for r in out.select("y", "weight").distinct().collect()} == {(0, 0.75), (1, 1.5)}
