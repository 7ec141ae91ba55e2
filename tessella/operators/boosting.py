"""Boosted trees for a quantile: MLlib fits each tree to the sign of the loss, its leaves then take the quantile of what is left."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.cuts import checkpointed

#: Rounds after which the prediction so far is written, so plans and trees to re-evaluate stay few.
CUT_EVERY = 10


@dataclass
class QuantileModel:
    """Predicts the ``alpha`` quantile: a constant and for each tree the values of its leaves, held back by ``rate``."""

    alpha: float
    start: float
    rate: float
    features: str
    trees: list = field(default_factory=list)

    def _step(self, df: DataFrame, i: int, output: str) -> DataFrame:
        tree, leaves = self.trees[i]
        value = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in leaves.items() for x in pair]), F.col("__leaf")), F.lit(0.0))
        out = tree.transform(df).withColumn(output, F.col(output) + self.rate * value)
        return out.drop("__leaf", tree.getPredictionCol())

    def transform(self, df: DataFrame, output: str = "quantile") -> DataFrame:
        df = df.withColumn(output, F.lit(self.start))
        for i in range(len(self.trees)):
            df = self._step(df, i, output)
        return df


def quantile_boost(df: DataFrame, features: str, label: str, alpha: float, rounds: int = 60, depth: int = 3, rate: float = 0.1, least: int = 5, seed: int = 42) -> QuantileModel:
    """Fits the quantile ``alpha`` of ``label`` on the vector ``features`` under the pinball loss.

    Every round fits a tree of ``depth`` to the loss's gradient (alpha where the label lies above the prediction so far,
    alpha - 1 else) and gives each leaf the quantile of its residuals; leaves are at most 2 ** depth, so that table is small.
    """
    rows = checkpointed(df.select(features, F.col(label).cast("double").alias("__y")).where("__y IS NOT NULL"))
    start = rows.agg(F.percentile_approx("__y", alpha, 10_000)).first()[0]
    model = QuantileModel(alpha, 0.0 if start is None else start, rate, features)
    rows = rows.withColumn("__f", F.lit(model.start))
    for i in range(rounds if start is not None else 0):
        sided = rows.withColumn("__g", F.when(F.col("__y") > F.col("__f"), alpha).otherwise(alpha - 1.0))
        tree = DecisionTreeRegressor(featuresCol=features, labelCol="__g", maxDepth=depth, minInstancesPerNode=least, leafCol="__leaf", predictionCol="__p", seed=seed + i).fit(sided)
        placed = tree.transform(rows)
        found = placed.groupBy("__leaf").agg(F.percentile_approx(F.col("__y") - F.col("__f"), alpha, 10_000).alias("v")).collect()
        model.trees.append((tree, {r["__leaf"]: r["v"] for r in found}))
        rows = model._step(rows, i, "__f")
        if i % CUT_EVERY == CUT_EVERY - 1:
            rows = checkpointed(rows)
    return model


def pinball(actual: Column, predicted: Column, alpha: float) -> Column:
    """The loss that a quantile minimises."""
    return F.when(actual >= predicted, alpha * (actual - predicted)).otherwise((1 - alpha) * (predicted - actual))


def band_of(df: DataFrame, lower: QuantileModel, upper: QuantileModel) -> DataFrame:
    """Adds ``lo`` and ``hi``; where the models cross they change places."""
    both = upper.transform(lower.transform(df, "__lo"), "__hi")
    return both.withColumns({"lo": F.least("__lo", "__hi"), "hi": F.greatest("__lo", "__hi")}).drop("__lo", "__hi")
