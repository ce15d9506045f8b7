"""Classifiers of candidate pairs, from Spark ML."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyspark
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.config import Model


class ModelConfigurationError(ValueError):
    """An unknown or unavailable kind of model."""


KINDS = ("logistic_regression", "hist_gradient_boosting", "random_forest", "extra_trees")
LICENCE = "Apache-2.0"


@dataclass(frozen=True)
class TrainedModel:
    pipeline: PipelineModel
    kind: str
    feature_names: tuple[str, ...]
    metadata: dict = field(default_factory=dict)

    def summary(self) -> dict:
        return {"kind": self.kind, "features": list(self.feature_names), "licence": LICENCE, "pyspark": pyspark.__version__, **self.metadata}


def create_model(config: Model = Model(), kind: str | None = None, n_rows: int = 1, seed: int = 42):
    """An estimator over the columns features, target and weight.

    Extra trees have no counterpart in Spark ML; that kind is a random forest that looks at all rows.
    """
    kind = (kind or config.kind).strip().lower().replace("-", "_").replace(" ", "_")
    common = {"featuresCol": "features", "labelCol": "target", "weightCol": "weight"}
    if kind == "logistic_regression":
        # the weights sum to the number of rows, so this is the penalty that has the inverse strength 1
        return kind, LogisticRegression(maxIter=config.max_iter, regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=False, tol=1e-8, **common)
    if kind == "hist_gradient_boosting":
        return kind, GBTClassifier(maxIter=50, maxDepth=5, stepSize=0.1, seed=seed, **common)
    if kind == "random_forest":
        return kind, RandomForestClassifier(numTrees=100, maxDepth=12, seed=seed, **common)
    if kind == "extra_trees":
        return kind, RandomForestClassifier(numTrees=100, maxDepth=12, bootstrap=False, featureSubsetStrategy="sqrt", seed=seed, **common)
    if kind in ("lightgbm", "xgboost"):
        raise ModelConfigurationError(f"{kind} is not installed")
    raise ModelConfigurationError(f"unknown model {kind}; known: {', '.join(KINDS)}")


def train(labelled: DataFrame, names: Sequence[str], config: Model = Model(), kind: str | None = None, seed: int = 42) -> TrainedModel:
    """Fit on the columns ``names`` and a 0/1 target; both classes must occur."""
    n, n_pos, low, high = labelled.agg(F.count("target"), F.sum("target"), F.min("target"), F.max("target")).first()
    if not n:
        raise ValueError("no labelled pairs")
    if (low, high) != (0, 1):
        raise ValueError("the target must have both 0 and 1, and nothing else")
    kind, estimator = create_model(config, kind, n, seed)
    share = {1: n / (2 * n_pos), 0: n / (2 * (n - n_pos))} if config.balanced else {1: 1.0, 0: 1.0}
    rows = labelled.withColumn("weight", F.when(F.col("target") == 1, F.lit(float(share[1]))).otherwise(F.lit(float(share[0]))))
    fitted = Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="features"), estimator]).fit(rows)
    return TrainedModel(fitted, kind, tuple(names), {"rows": int(n), "positives": int(n_pos)})


def predict_probability(model: TrainedModel, df: DataFrame) -> DataFrame:
    """Add score, the probability of a match."""
    made = {"features", "rawPrediction", "probability", "prediction"}
    out = model.pipeline.transform(df)
    return out.withColumn("score", vector_to_array("probability")[1]).drop(*(made - set(df.columns)))


def predict(model: TrainedModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    return predict_probability(model, df).withColumn("prediction", (F.col("score") >= threshold).cast("byte"))


def pairwise_f05(df: DataFrame) -> tuple[float, float, float]:
    """(F0.5, precision, recall) of the columns target and prediction."""
    tp, fp, fn = (x or 0 for x in df.agg(*[F.count_if((F.col("target") == t) & (F.col("prediction") == p)) for t, p in ((1, 1), (0, 1), (1, 0))]).first())
    p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return (1.25 * p * r / (0.25 * p + r) if p + r else 0.0), p, r


def compare_models(kinds: Sequence[str], training: DataFrame, validation: DataFrame, names: Sequence[str], config: Model = Model()) -> list[dict]:
    """One row per kind, best F0.5 at 0.5 first, then precision; kinds that can't be built or fitted come last, as unavailable."""
    rows = []
    for kind in kinds:
        try:
            model = train(training, names, config, kind)
            score, p, r = pairwise_f05(predict(model, validation))
            rows.append({"kind": kind, "status": "ok", "f05": score, "precision": p, "recall": r, "model": model})
        except (ImportError, ValueError) as e:
            rows.append({"kind": kind, "status": "unavailable", "reason": str(e), "f05": float("nan"), "precision": float("nan"), "recall": float("nan"), "model": None})
    return sorted(rows, key=lambda r: (r["status"] != "ok", *((-r["f05"], -r["precision"]) if r["status"] == "ok" else ())))


def save(model: TrainedModel, path: str) -> None:
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    spark = pyspark.sql.SparkSession.active()
    about = json.dumps({"kind": model.kind, "feature_names": model.feature_names, "metadata": model.metadata})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(path: str) -> TrainedModel:
    about = json.loads(pyspark.sql.SparkSession.active().read.text(f"{path}/about").first()[0])
    if set(about) != {"kind", "feature_names", "metadata"}:
        raise TypeError("not a saved model")
    return TrainedModel(PipelineModel.load(f"{path}/pipeline"), about["kind"], tuple(about["feature_names"]), about["metadata"])
