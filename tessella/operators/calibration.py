"""Probabilities from any classifier's margins: out-of-fold scores, one sigmoid for each fold and class, averages over folds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.cuts import checkpointed

STEPS, RIDGE = 20, 1e-6


def fold_of(key: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")


def fit_sigmoids(scores: DataFrame) -> dict[int, tuple[float, float]]:
    """(slope, intercept) of each group of scores (grp int, margin double, hit boolean): all groups at once by Newton steps.

    Every step is one aggregation over all rows; only sums of each group reach the driver, and groups are folds
    times classes.  Targets are smoothed towards the middle, as for few rows of a class they must be.
    """
    counts = {r["grp"]: (r["n"], r["hits"]) for r in scores.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).collect()}
    params = {g: (1.0, 0.0) for g in counts}

    def of(values: dict) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for g, v in values.items() for x in (g, float(v))]), F.col("grp"))

    high = of({g: (h + 1) / (h + 2) for g, (_, h) in counts.items()}) if counts else None
    low = of({g: 1 / (n - h + 2) for g, (n, h) in counts.items()}) if counts else None
    for _ in range(STEPS if counts else 0):
        p = 1 / (1 + F.exp(-(of({g: a for g, (a, _) in params.items()}) * F.col("margin") + of({g: b for g, (_, b) in params.items()}))))
        rows = scores.select("grp", "margin", p.alias("p"), F.when(F.col("hit"), high).otherwise(low).alias("t"))
        off, curve = F.col("p") - F.col("t"), F.col("p") * (1 - F.col("p"))
        sums = rows.groupBy("grp").agg(
            F.sum(off * F.col("margin")).alias("ga"), F.sum(off).alias("gb"), F.sum(curve * F.col("margin") ** 2).alias("haa"), F.sum(curve * F.col("margin")).alias("hab"), F.sum(curve).alias("hbb")).collect()
        moved = 0.0
        for r in sums:
            haa, hbb = r["haa"] + RIDGE, r["hbb"] + RIDGE
            det = haa * hbb - r["hab"] ** 2
            da, db = (hbb * r["ga"] - r["hab"] * r["gb"]) / det, (haa * r["gb"] - r["hab"] * r["ga"]) / det
            size = max(abs(da), abs(db))
            scale = min(1.0, 4.0 / size) if size else 1.0  # far steps overshoot where a class is split cleanly
            a, b = params[r["grp"]]
            params[r["grp"]] = (a - scale * da, b - scale * db)
            moved = max(moved, scale * size)
        if moved < 1e-6:
            break
    return params


@dataclass
class Calibrated:
    """Models of the folds and a sigmoid for each fold and class."""

    models: list[PipelineModel]
    sigmoids: dict[int, tuple[float, float]]
    classes: int
    margin: str

    def _chances(self, margins: Column, fold: int) -> Column:
        pairs = [self.sigmoids.get(fold * self.classes + c, (1.0, 0.0)) for c in range(self.classes)]
        each = F.array(*[1 / (1 + F.exp(-(a * F.get(margins, F.lit(c)) + b))) for c, (a, b) in enumerate(pairs)])
        total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
        return F.get(F.transform(F.array(F.struct(each.alias("e"), total.alias("s"))), lambda x: F.transform(x["e"], lambda y: F.when(x["s"] > 0, y / x["s"]).otherwise(1.0 / self.classes))), F.lit(0))

    def transform(self, df: DataFrame, output: str = "chances") -> DataFrame:
        """Adds the probabilities of the classes, in the order of the label's index, averaged over the folds."""
        names = []
        for fold, model in enumerate(self.models):
            names.append(f"__c{fold}")
            kept = [F.col(f"`{c}`") for c in df.columns]
            df = model.transform(df).select(*kept, self._chances(vector_to_array(self.margin), fold).alias(names[-1]))
        mean = F.transform(F.arrays_zip(*names), lambda z: sum((z[n] for n in names), F.lit(0.0)) / len(names))
        return df.withColumn(output, mean).drop(*names)


def calibrate(df: DataFrame, key: str, label: str, fit: Callable[[DataFrame], PipelineModel], margin: str = "rawPrediction", folds: int = 3) -> Calibrated:
    """Fits ``folds`` models, each without its fold, and sigmoids on the margins of the rows that a model has not seen.

    ``label`` is an index from 0 on; ``fit`` trains a model whose transform adds the vector ``margin`` with an entry for each class.
    """
    df = df.withColumn("__fold", fold_of(key, folds))
    models, seen = [], None
    for fold in range(folds):
        model = fit(df.where(F.col("__fold") != fold).drop("__fold"))
        models.append(model)
        part = model.transform(df.where(F.col("__fold") == fold).drop("__fold")).select(F.lit(fold).alias("fold"), F.col(label).cast("int").alias("y"), vector_to_array(margin).alias("m"))
        seen = part if seen is None else seen.unionByName(part)
    seen = checkpointed(seen)
    classes = seen.agg(F.greatest(F.max(F.size("m")), F.max("y") + 1)).first()[0] or 0
    scores = seen.select("fold", "y", F.posexplode("m").alias("c", "margin")).select((F.col("fold") * classes + F.col("c")).alias("grp"), "margin", (F.col("y") == F.col("c")).alias("hit"))
    return Calibrated(models, fit_sigmoids(scores), classes, margin)


def log_loss(chances: Column, label: Column) -> Column:
    """Minus the logarithm of the chance given to the true class."""
    return -F.log(F.greatest(F.get(chances, label.cast("int")), F.lit(1e-12)))
