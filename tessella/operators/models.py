"""MLlib pipelines for text classes and screening rows; stages are saved with ``PipelineModel.save``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, IDF, NGram, OneHotEncoder, RegexTokenizer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.cuts import checkpointed


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows / (classes * rows of the class).  Classes are few, so rows stay where they are."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_class"))
    totals = counts.agg(F.sum("n_class").alias("n_all"), F.count("*").alias("n_classes"))
    weights = counts.join(F.broadcast(totals)).select(label, (F.col("n_all") / (F.col("n_classes") * F.col("n_class"))).alias("weight"))
    return df.join(F.broadcast(weights), label)


def _text_stages(text: str, longest: int, features: int) -> list:
    """Words, their n-grams side by side, counts weighted by IDF; features is the bound of the vocabulary."""
    stages = [RegexTokenizer(inputCol=text, outputCol="w1", pattern="[^a-z0-9+#]+")]
    stages += [NGram(n=n, inputCol="w1", outputCol=f"w{n}") for n in range(2, longest + 1)]
    joined = ", ".join(f"w{n}" for n in range(1, longest + 1))
    stages.append(SQLTransformer(statement=f"SELECT *, concat({joined}) AS grams FROM __THIS__"))
    stages.append(CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=features))
    return [*stages, IDF(inputCol="tf", outputCol="features")]


def text_classifier(text: str, label: str, longest: int = 2, features: int = 25_000, margin: bool = False) -> Pipeline:
    """TF-IDF with multinomial logistic regression on class weights, or one-against-rest linear SVC."""
    index = StringIndexer(inputCol=label, outputCol="label", handleInvalid="skip")
    last = one_against_rest("label") if margin else LogisticRegression(weightCol="weight", maxIter=30, regParam=0.01)
    return Pipeline(stages=[index, *_text_stages(text, longest, features), last])


def word_vectors(df: DataFrame, text: str, words: int) -> DataFrame:
    """``text_features`` of single words, ``text`` dropped.  Texts are read twice: what comes after reads the counts of each text from a checkpoint."""
    df = df.fillna("", [text])
    stages = _text_stages(text, 1, words)
    counts = checkpointed(Pipeline(stages=stages[:-1]).fit(df).transform(df).drop(text, "w1", "grams"))
    return stages[-1].fit(counts).transform(counts).drop("tf")


def one_against_rest(label: str, rounds: int = 20) -> OneVsRest:
    """Linear margins of each class against the others, on ``features`` and class weights."""
    return OneVsRest(classifier=LinearSVC(maxIter=rounds), labelCol=label, weightCol="weight")


def top_classes(model: PipelineModel, df: DataFrame, k: int = 5) -> DataFrame:
    """Adds ``classes``: the k likeliest classes with their probabilities, likeliest first, ties by name."""
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    pairs = F.zip_with(vector_to_array("probability"), names, lambda p, c: F.struct((-p).alias("less"), c.alias("name")))
    best = F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: F.struct(x["name"].alias("name"), (-x["less"]).alias("probability")))
    unlabelled = model.stages[1:]
    return PipelineModel(unlabelled).transform(df).withColumn("classes", best)


def mixed_features(text: str | None, categories: Sequence[str], numbers: Sequence[str], features: int = 500) -> list:
    """Stages from a text, categories and numbers to one vector ``x``."""
    stages, parts = [], []
    if text is not None:
        stages, parts = _text_stages(text, 1, features), ["features"]
    for c in categories:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}_i", outputCol=f"{c}_v", handleInvalid="keep")]
        parts.append(f"{c}_v")
    stages += [VectorAssembler(inputCols=list(numbers), outputCol="numbers", handleInvalid="keep"), StandardScaler(inputCol="numbers", outputCol="scaled")]
    return [*stages, VectorAssembler(inputCols=[*parts, "scaled"], outputCol="x", handleInvalid="keep")]


def decision_model(stages: list, label: str, trees: int = 100, depth: int = 10, weight: str | None = None) -> Pipeline:
    """Random forest for a decision over ``x``; ``weight`` names the column that balances the classes."""
    forest = RandomForestClassifier(featuresCol="x", labelCol=label, numTrees=trees, maxDepth=depth, seed=42)
    return Pipeline(stages=[*stages, forest if weight is None else forest.setWeightCol(weight)])


def score_model(stages: list, label: str, rounds: int = 30) -> Pipeline:
    """Boosted trees for a numeric target over ``x``."""
    return Pipeline(stages=[*stages, GBTRegressor(featuresCol="x", labelCol=label, maxIter=rounds, seed=42)])


def residual_band(scored: DataFrame, label: str, by: str, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """(by, lo, hi): quantiles of the residuals of each band, to be added to a prediction (MLlib has no quantile loss)."""
    rest = F.col(label) - F.col("prediction")
    return scored.groupBy(by).agg(F.percentile_approx(rest, low).alias("lo"), F.percentile_approx(rest, high).alias("hi"))


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.2) -> DataFrame:
    """Adds ``held_out``: the first share of each class in the order of the key's hash."""
    order = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    return df.withColumn("held_out", F.row_number().over(order) <= F.floor(share * F.count("*").over(Window.partitionBy(label))))
