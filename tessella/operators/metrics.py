"""Model quality from (label, prediction) rows, as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """precision, recall, f1 and support of each class; a division by zero gives 0."""
    cells = df.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    both = F.explode(F.array(F.struct(F.col("l").alias("cls"), F.lit(1).alias("is_label")), F.struct(F.col("p").alias("cls"), F.lit(0).alias("is_label"))))
    sides = cells.select("l", "p", "n", both.alias("side")).select("n", "side.*", (F.col("l") == F.col("p")).alias("hit"))
    sums = sides.groupBy("cls").agg(
        F.sum(F.when(F.col("is_label") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("is_label") == 0, F.col("n")).otherwise(0)).alias("said"),
        F.sum(F.when((F.col("is_label") == 1) & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
    )
    precision = F.coalesce(F.col("tp") / F.nullif(F.col("said"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("tp") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    return sums.select("cls", "support", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def regression_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """MAE, RMSE and R squared in one pass over sums."""
    e, y = F.col(predicted) - F.col(label), F.col(label)
    total = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count("*")
    return df.agg(F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(1 - F.sum(e * e) / F.nullif(total, F.lit(0.0)), 4).alias("r2"))


def roc_auc(df: DataFrame, label: str, score: str, parts: int = 200) -> DataFrame:
    """Area under the curve by average ranks: ranks within ``parts`` ranges of scores, plus what lies below each range."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    cuts = by.agg(F.percentile_approx("s", [i / parts for i in range(1, parts)]).alias("cuts"))
    part = F.size(F.filter("cuts", lambda c: c <= F.col("s"))).alias("part")
    placed = by.crossJoin(F.broadcast(cuts)).select("s", "n", "pos", part)  # cuts is one row
    w = Window.partitionBy("part").orderBy("s")
    ranked = placed.withColumn("upto", F.sum("n").over(w))
    own = F.col("pos") * (F.col("upto") - (F.col("n") - 1) / 2.0)
    sums = ranked.groupBy("part").agg(F.sum(own).alias("own"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most ``parts`` rows
    total = sums.withColumn("below", below).agg(F.sum(F.col("own") + F.col("p") * F.col("below")).alias("rank_sum"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(F.round((F.col("rank_sum") - F.col("p") * (F.col("p") + 1) / 2.0) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0)), 6).alias("auc"))


def class_summary(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy, and precision, recall and F1 as plain and as weighted means over classes."""
    report = class_report(df, label, predicted).where("support > 0 OR precision > 0")
    total = F.sum("support")
    means = [F.round(F.avg(m), 6).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    weighted = F.round(F.sum(F.col("f1") * F.col("support")) / total, 6).alias("weighted_f1")
    return report.agg(F.round(F.sum(F.col("recall") * F.col("support")) / total, 6).alias("accuracy"), *means, weighted)


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Cells of the confusion matrix that hold rows."""
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def top_k_accuracy(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of rows whose true label is among the first k; ``rank`` is the true label's rank."""
    return ranked.agg(*[F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"top{k}") for k in ks])
