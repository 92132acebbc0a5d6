"""Metrics of binary scores, in SQL aggregates; thresholds, models and their registry.

Scores are grouped by value before anything is ranked, so tied scores count together.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import work_dir


#: Scores are cut into this many steps of their range for running sums.
STEPS = 1024


def curve(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: its positives ``p`` and rows ``n``, the cumulative true and false positives from the top, and the totals.

    Running sums have two levels: inside a step of the score, and over at most STEPS + 1
    steps, so that no task orders all scores.  Scores lie in 0..1; null scores take no part.
    """
    step = F.least(F.greatest(F.floor(F.col("s") * STEPS), F.lit(0)), F.lit(STEPS)).cast("int")
    per = scored.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).withColumn("step", step)
    inside = Window.partitionBy(*by, "step").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({"in_p": F.sum("p").over(inside), "in_n": F.sum("n").over(inside)})
    keys = list(by) or [F.lit(0)]
    above = Window.partitionBy(*keys).orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = per.groupBy(*by, "step").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    whole = Window.partitionBy(*keys)
    steps = steps.select(*by, "step", F.coalesce(F.sum("sp").over(above), F.lit(0)).alias("up_p"), F.coalesce(F.sum("sn").over(above), F.lit(0)).alias("up_n"), F.sum("sp").over(whole).alias("pos"), F.sum("sn").over(whole).alias("rows"))
    out = per.join(steps, [*by, "step"])
    tp = F.col("in_p") + F.col("up_p")
    return out.select(*by, "s", "p", "n", tp.alias("tp"), (F.col("in_n") + F.col("up_n") - tp).alias("fp"), "pos", (F.col("rows") - F.col("pos")).alias("neg"))


def areas(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC and PR AUC by trapezoids, average precision by steps; null where a class is missing.

    A point knows its predecessor: the cumulative counts without its own rows.
    """
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - (F.col("n") - F.col("p"))
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    prec0 = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0))
    d_recall = F.col("p") / F.nullif("pos", F.lit(0))
    d_fpr = (F.col("n") - F.col("p")) / F.nullif("neg", F.lit(0))
    height = (F.col("tp") + tp0) / (2 * F.nullif("pos", F.lit(0)))
    return points.groupBy(*by).agg(F.sum(d_fpr * height).alias("roc_auc"), F.sum(d_recall * (prec + prec0) / 2).alias("pr_auc"), F.sum(d_recall * prec).alias("average_precision"))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b = beta * beta
    down = (1 + b) * tp + b * fn + fp
    return F.when(down > 0, (1 + b) * tp / down).otherwise(F.lit(0.0))


def at_thresholds(scored: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts and metrics at every threshold, from one aggregation over the rows."""
    y = F.col(label).cast("int") == 1
    counts = []
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= t
        counts += [F.count_if(hit & y).alias(f"tp{i}"), F.count_if(hit & ~y).alias(f"fp{i}"), F.count_if(~hit & y).alias(f"fn{i}"), F.count_if(~hit & ~y).alias(f"tn{i}")]
    one = scored.agg(*counts)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "tn")]) for i, t in enumerate(thresholds)])).alias("r")
    out = one.select(rows).select("r.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return out.withColumns({"precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": f_beta(tp, fp, fn, 1), "f2": f_beta(tp, fp, fn, 2)})


THRESHOLDS = tuple(round(0.05 + 0.01 * i, 2) for i in range(91))


def best_threshold(metrics: DataFrame, start: float = 0.50) -> DataFrame:
    """The threshold with the greatest (F2, precision); ties stay at ``start``, then at the lowest."""
    rank = [F.col("f2").desc(), F.col("precision").desc(), (F.col("threshold") != start).asc(), F.col("threshold").asc()]
    return metrics.orderBy(*rank).limit(1)


def fit_candidates(train: DataFrame, features: Sequence[str], label: str, names: Sequence[str] = ("logistic_regression", "gradient_boosting")):
    """Scaled logistic regression and gradient boosting, both weighted for class balance; or those of ``names``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    pos, n = train.agg(F.sum(label), F.count(F.lit(1))).first()
    if not pos or pos == n:
        raise ValueError("both classes are required")
    weighted = train.withColumn("__w", F.when(F.col(label) == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos))))
    assemble = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep")
    scale = StandardScaler(inputCol="__x", outputCol="__z", withMean=True, withStd=True)
    made = {
        "logistic_regression": [assemble, scale, LogisticRegression(featuresCol="__z", labelCol=label, weightCol="__w", maxIter=50)],
        "gradient_boosting": [assemble, GBTClassifier(featuresCol="__x", labelCol=label, weightCol="__w", maxIter=10, maxDepth=4, seed=7)],
    }
    return {name: _stored(Pipeline(stages=stages).fit(weighted), work_dir(train.sparkSession, name)) for name, stages in made.items() if name in names}


def _stored(model, path: str):
    """Save and load: what is loaded is the model alone, without its training summary and session."""
    from pyspark.ml import PipelineModel

    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def predict(model, rows: DataFrame, threshold: float, **columns: str) -> DataFrame:
    """Distributed scoring: probability of the positive class, the decision, and constant version columns."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows).withColumn("fraud_probability", vector_to_array("probability")[1])
    return out.withColumn("predicted_fraud", (F.col("fraud_probability") >= threshold).cast("int")).withColumns({k: F.lit(v) for k, v in columns.items()}).drop("__x", "__z", "rawPrediction", "probability", "prediction")


@dataclass(frozen=True)
class ModelVersion:
    name: str
    version: int
    path: str
    metrics: str
    alias: str | None = None
    event: str = "REGISTERED"


class Registry:
    """Model versions and their aliases as an append-only table; the last row of a version stands."""

    SCHEMA = "name string, version int, path string, metrics string, alias string, event string, step long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._step = spark, path, 0

    def _append(self, *rows: ModelVersion) -> None:
        self._step = (self.rows().agg(F.max("step")).first()[0] or 0) + 1 if self.exists() else 1
        data = [(*asdict(r).values(), self._step) for r in rows]
        self.spark.createDataFrame(data, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def exists(self) -> bool:
        try:
            self.spark.read.schema(self.SCHEMA).parquet(self.path).schema
            return True
        except Exception:  # the table is not there yet
            return False

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def current(self) -> DataFrame:
        return self.rows().groupBy("name", "version").agg(F.max_by(F.struct("path", "metrics", "alias"), "step").alias("r")).select("name", "version", "r.*")

    def audit(self) -> DataFrame:
        """What happened to each version, in order; nothing is ever rewritten."""
        return self.rows().select("step", "name", "version", "event", "alias")

    def register(self, name: str, path: str, metrics: Mapping[str, float]) -> int:
        last = self.current().filter(F.col("name") == name).agg(F.max("version")).first()[0] if self.exists() else None
        version = (last or 0) + 1
        self._append(ModelVersion(name, version, path, json.dumps(dict(metrics), sort_keys=True), "Candidate"))
        return version

    def promote(self, name: str, version: int) -> None:
        """Candidate becomes Champion, the old Champion PreviousChampion, in one append."""
        held = {r["version"]: r for r in self.current().filter(F.col("name") == name).collect()}
        rows = [ModelVersion(name, version, held[version]["path"], held[version]["metrics"], "Champion", "PROMOTED")]
        rows += [ModelVersion(name, v, r["path"], r["metrics"], "PreviousChampion", "REPLACED") for v, r in held.items() if r["alias"] == "Champion" and v != version]
        rows += [ModelVersion(name, v, r["path"], r["metrics"], None, "RETIRED") for v, r in held.items() if r["alias"] == "PreviousChampion" and v != version]
        self._append(*rows)


def promotion_checks(least_recall: float = 0.50) -> dict[str, Column]:
    """What a model must show before it is promoted, over a row of its path, its metrics on unseen rows and the base rate."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return {
        "model_stored": F.length("path") > 0, "average_precision_finite": number("average_precision"), "average_precision_beats_base_rate": F.col("average_precision") >= F.col("base_rate"),
        "recall_finite": number("recall"), "minimum_recall": F.col("recall") >= least_recall, "f2_positive": number("f2") & (F.col("f2") > 0),
    }


def champion(registry: Registry, name: str) -> tuple:
    """The stored champion of a name: its model, its threshold, and its version columns for ``predict``."""
    from pyspark.ml import PipelineModel

    held = registry.current().filter((F.col("name") == name) & (F.col("alias") == "Champion")).first()
    if held is None:
        raise ValueError(f"{name} has no champion")
    columns = {"model_name": name, "model_version": str(held["version"]), "model_alias": "Champion"}
    return PipelineModel.load(held["path"]), json.loads(held["metrics"])["threshold"], columns


def gates(metrics: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Named checks over a row of metrics: failures in order, and whether all passed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in checks.items()]))
    return metrics.withColumn("failed_gates", failed).withColumn("passed", F.size("failed_gates") == 0)
