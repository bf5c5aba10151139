"""Base classifiers and meta-learners as ``pyspark.ml`` pipelines.

Every fit takes a table ``label, features`` (and ``weight``) and returns a ``Fitted`` that adds ``prob`` to a table with
``features``. Kernels are approximated; the fixed parameters are those of the workload.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JError
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.functions.kernels import MAPS, random_features  # noqa: F401 (used by callers)
from stackmill.plans.boosting import Boosted, fit_boosted
from stackmill.plans.nets import Net, fit_net
from stackmill.plans.shared import LinearFit
from stackmill.plans.votes import NeighbourFit
from stackmill.session import scratch_path

# Classifier parameters per descriptor family.
PROFILES: dict[str, dict[str, dict[str, Any]]] = {
    "numeric": {
        "knn": {"k": 7},
        "lr": {"C": 0.1, "max_iter": 300, "balanced": False},
        "svm": {"C": 1.0, "kernel": "rbf", "gamma": "scale", "balanced": True},
        "rf": {"trees": 700, "depth": 11, "leaf": 5, "balanced": True, "subset": "log2"},
        "xgboost": {"step": 0.01, "trees": 700, "depth": 11, "subsample": 0.7, "positive_weight": 0.66},
    },
    "keys": {
        "knn": {"k": 11},
        "lr": {"C": 0.01, "max_iter": 300, "balanced": True},
        "svm": {"C": 1.0, "kernel": "rbf", "gamma": 0.1, "balanced": True},
        "rf": {"trees": 700, "depth": 7, "leaf": 9, "balanced": True, "subset": "log2"},
        "xgboost": {"step": 0.01, "trees": 300, "depth": 11, "subsample": 0.7, "positive_weight": 0.66},
    },
    "embedded": {
        "knn": {"k": 3},
        "lr": {"C": 1.0, "max_iter": 300, "balanced": True},
        "svm": {"C": 0.1, "kernel": "poly", "offset": 0.0, "balanced": True},
        "rf": {"trees": 500, "depth": 5, "leaf": 5, "balanced": True, "subset": "log2"},
        "xgboost": {"step": 0.001, "trees": 700, "depth": 7, "subsample": 0.7, "positive_weight": 0.66},
    },
    "ranked": {
        "knn": {"k": 7},
        "lr": {"C": 0.1, "max_iter": 500, "balanced": True},
        "svm": {"C": 1.0, "kernel": "rbf", "gamma": "scale", "balanced": True},
        "rf": {"trees": 500, "depth": 10, "leaf": 5, "balanced": True, "subset": "sqrt"},
        "xgboost": {"step": 0.01, "trees": 500, "depth": 8, "subsample": 0.8, "positive_weight": 1.5},
        "gb": {"step": 0.05, "trees": 300, "depth": 6},
        "mlp": {"hidden": (128, 64), "max_iter": 500},
    },
}
# The nets.
DNN = {
    "hidden": (128, 128, 128, 128), "activation": "tanh", "norm": (True,) * 4, "dropout": (0.2,) * 4, "l2": 0.001, "rate": 1e-4,
    "epochs": 100, "batch": 8, "patience": 5,
}
META = {
    "base": {"hidden": (64, 32, 16), "norm": (True, True, False), "dropout": (0.3, 0.2, 0.0), "epochs": 200, "patience": 20},
    "v2": {"hidden": (32, 16), "dropout": (0.3, 0.2), "epochs": 300, "patience": 15},
    "v3": {"hidden": (48, 24, 12), "dropout": (0.3, 0.2, 0.0), "epochs": 300, "patience": 15},
}

# A few rounds of everything, for small tables and tests.
SMALL: dict[str, dict[str, Any]] = {
    "knn": {"k": 7},
    "lr": {"C": 0.1, "max_iter": 50, "balanced": True},
    "svm": {"C": 1.0, "kernel": "rbf", "gamma": "scale", "balanced": True, "n_features": 64, "max_iter": 20},
    "rf": {"trees": 10, "depth": 5, "leaf": 5, "balanced": True, "subset": "log2"},
    "xgboost": {"step": 0.1, "trees": 8, "depth": 4, "subsample": 0.7, "positive_weight": 0.66},
    "gb": {"step": 0.1, "trees": 8, "depth": 4},
    "mlp": {"hidden": (16, 8), "max_iter": 50},
}
MAX_DEPTH = 30


@dataclass
class Fitted:
    """A fitted pipeline, and what turns ``features`` into its input."""

    kind: str
    model: PipelineModel
    width: int
    inputs: dict[str, Any] = field(default_factory=dict)

    def vector(self, df: DataFrame) -> DataFrame:
        values = F.col("features")
        if self.inputs:
            given = dict(self.inputs)
            values = MAPS[given.pop("kernel", "rbf")](values, self.width, **given)
        return df.withColumn("__x", array_to_vector(values))

    def score(self, df: DataFrame, prob: str = "prob") -> DataFrame:
        """Add the probability of the positive class; one narrow projection, no shuffle."""
        out = self.model.transform(self.vector(df))
        kept = [c for c in df.columns if c != prob]
        return out.select(*kept, F.get(vector_to_array("probability"), F.lit(1)).alias(prob))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        row = [(self.kind, self.width, json.dumps(self.inputs))]
        spark.createDataFrame(row, "kind string, width int, inputs string").write.mode("overwrite").json(f"{path}/inputs")

    @classmethod
    def load(cls, spark, path: str) -> Fitted | Boosted | Net | LinearFit | NeighbourFit:
        """A saved model of any kind."""
        found = spark.read.schema("kind string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
        kinds = {r["kind"] for r in found.where("kind IS NOT NULL").collect()}
        if kinds & {"xgboost", "gb"}:
            return Boosted.load(spark, path)
        if kinds & {"dnn", "meta"}:
            return Net.load(spark, path)
        if "knn" in kinds:
            return NeighbourFit.load(spark, path)
        if "linear" in kinds:
            return LinearFit.load(spark, path)
        row = spark.read.schema("kind string, width int, inputs string").json(f"{path}/inputs").first()
        return cls(row["kind"], PipelineModel.load(f"{path}/pipeline"), row["width"], json.loads(row["inputs"]))


def _regularisation(C: float, rows: float) -> float:
    """C * sum(loss) + |w|^2 / 2 in the form mean(loss) + r/2 * |w|^2."""
    return 1.0 / (C * max(rows, 1.0))


def _platt(stage: Estimator) -> list[Estimator]:
    """A margin classifier followed by a logistic calibration of its margin."""
    stage = stage.setRawPredictionCol("__margin").setPredictionCol("__side")
    pick = VectorSlicer(inputCol="__margin", outputCol="__m", indices=[1])
    return [stage, pick, LogisticRegression(featuresCol="__m", labelCol="label", weightCol="weight", maxIter=50)]


def stages(kind: str, params: Mapping[str, Any], width: int, rows: float, seed: int = 1) -> list[Estimator]:
    """The pipeline stages of a classifier kind for ``width`` features and a total weight of ``rows``."""
    io = {"featuresCol": "__x", "labelCol": "label"}
    p = dict(params)
    if kind == "lr":
        return [
            LogisticRegression(
                regParam=_regularisation(p["C"], rows), elasticNetParam=0.0, standardization=False,
                maxIter=p["max_iter"], weightCol="weight", **io,
            )
        ]
    if kind == "rf":
        return [
            RandomForestClassifier(
                numTrees=p["trees"], maxDepth=min(p["depth"] or MAX_DEPTH, MAX_DEPTH), minInstancesPerNode=p.get("leaf", 1),
                featureSubsetStrategy=p.get("subset", "sqrt"), weightCol="weight", seed=seed, **io,
            )
        ]
    if kind == "svm":
        svc = LinearSVC(
            regParam=_regularisation(p["C"], rows), maxIter=p.get("max_iter", 100), standardization=False, weightCol="weight"
        )
        return _platt(svc.setFeaturesCol("__x").setLabelCol("label"))
    if kind == "mlp":
        return [
            MultilayerPerceptronClassifier(
                layers=[width, *p["hidden"], 2], maxIter=p["max_iter"], seed=seed, blockSize=128, **io
            )
        ]
    raise ValueError(f"unknown classifier kind {kind!r}")


def _without_summary(model: Any, spark: SparkSession) -> Any:
    """The model without its training summary. The summary of a binary label carries the session, and a session that has observed a
    query cannot be sent with a task. Where the summary cannot be taken off, the model is stored and read back."""
    if not (isinstance(model, MLWritable) and getattr(model, "hasSummary", False)):
        return model
    try:
        model._java_obj.setSummary(spark._jvm.scala.Option.empty())
        return model
    except (AttributeError, Py4JError):
        pass
    path = scratch_path(spark, "fitted")
    model.write().overwrite().save(path)
    return type(model).load(path)


def _fit_stages(parts: list[Any], df: DataFrame) -> PipelineModel:
    """What ``Pipeline(stages=parts).fit(df)`` gives, every model without its summary."""
    done: list[Any] = []
    for part in parts:
        if done:
            df = done[-1].transform(df)
        done.append(_without_summary(part.fit(df), df.sparkSession) if isinstance(part, Estimator) else part)
    return PipelineModel(done)


@dataclass(frozen=True)
class TrainSize:
    """What a fit must know about its rows beforehand: a bounded summary, one row per class."""

    width: int
    negatives: int
    positives: int
    variance: float = 1.0

    @property
    def rows(self) -> int:
        return self.negatives + self.positives

    def class_weights(self, params: Mapping[str, Any]) -> tuple[float, float]:
        if params.get("balanced"):
            return self.rows / (2.0 * max(self.negatives, 1)), self.rows / (2.0 * max(self.positives, 1))
        return 1.0, float(params.get("positive_weight", 1.0))


def train_size(df: DataFrame) -> TrainSize:
    x = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    xx = F.aggregate("features", F.lit(0.0), lambda a, v: a + v * v)
    row = df.agg(
        F.max(F.size("features")).alias("d"),
        F.count_if(F.col("label") == 0).alias("n0"),
        F.count_if(F.col("label") == 1).alias("n1"),
        F.sum(x).alias("s"),
        F.sum(xx).alias("ss"),
    ).first()
    cells = max(1, (row["n0"] + row["n1"]) * (row["d"] or 1))
    mean = (row["s"] or 0.0) / cells
    return TrainSize(row["d"] or 0, row["n0"], row["n1"], max((row["ss"] or 0.0) / cells - mean * mean, 1e-12))


def fit(kind: str, train: DataFrame, params: Mapping[str, Any], seed: int = 1, size: TrainSize | None = None) -> Fitted | Boosted | Net | NeighbourFit:
    """Fit one classifier on a table ``label, features``. Boosted trees are our own (``boosting``): second-order for
    ``xgboost``; for ``gb`` splits by squared residuals, Newton leaves and the log-odds of the labels as start."""
    if kind == "knn":
        return NeighbourFit.of(train, params)
    size = size or train_size(train)
    w0, w1 = size.class_weights(params)
    rows = train.select(
        F.col("label").cast("double").alias("label"),
        F.when(F.col("label") == 1, F.lit(w1)).otherwise(F.lit(w0)).alias("weight"),
        "features",
    )
    if kind in ("xgboost", "gb"):
        extra = {"ridge": 0.0, "newton": False, "prior": True} if kind == "gb" else {}
        return fit_boosted(kind, rows, {**extra, **params}, size.width, seed)
    if kind in ("dnn", "meta"):
        return fit_net(kind, rows, params, size.width, seed)
    inputs: dict[str, Any] = {}
    width = size.width
    if kind == "svm" and params["kernel"] in MAPS:
        gamma = params.get("gamma", "scale")
        value = 1.0 / (size.width * size.variance) if gamma == "scale" else float(gamma)
        poly = params["kernel"] == "poly"
        inputs = {"kernel": params["kernel"], "n": int(params.get("n_features", 1024 if poly else 512)), "gamma": value, "seed": seed}
        if poly:
            inputs["offset"] = float(params.get("offset", 1.0))
        width = inputs["n"]
    fitted = Fitted(kind, PipelineModel([]), size.width, inputs)
    total = size.negatives * w0 + size.positives * w1
    fitted.model = _fit_stages(stages(kind, params, width, total, seed), fitted.vector(rows))
    return fitted

