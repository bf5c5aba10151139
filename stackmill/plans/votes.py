"""Nearest neighbours as a fitted model: the training rows, and how they vote."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.operators import neighbors
from stackmill.session import stored


@dataclass
class NeighbourFit:
    """``rows`` (id, label, features) and the parameters ``k``, ``weights`` and ``metric``."""

    rows: DataFrame
    params: dict[str, Any]
    kind: str = "knn"

    @classmethod
    def of(cls, train: DataFrame, params: Mapping[str, Any]) -> NeighbourFit:
        """Keep the training rows with a vector and a label in the shared folder; rows without an id get one."""
        usable = train.where(F.col("features").isNotNull() & F.col("label").isNotNull())
        ids = F.col("id").cast("bigint") if "id" in train.columns else F.monotonically_increasing_id()
        kept = usable.select(ids.alias("id"), F.col("label").cast("double").alias("label"), "features")
        return cls(stored(kept, "neighbours"), dict(params))

    def score(self, df: DataFrame, prob: str = "prob") -> DataFrame:
        """Add the probability of the positive class by one join on the unique column ``id``. Null where the vector is null or
        no training row has a vector of its width."""
        rows, p = self.rows, self.params
        queries = df.select("id", "features").where(F.col("features").isNotNull())
        found = neighbors.knn_join(
            queries.withColumn("width", F.size("features")), rows.withColumn("width", F.size("features")), p["k"], ["width"], p.get("metric", "euclidean")
        )
        votes = neighbors.vote(found, ["width"], p.get("weights", "uniform")).select("id", F.col("prob").alias(prob))
        return df.drop(prob).join(votes, "id", "left").select(*[c for c in df.columns if c != prob], prob)

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        row = [(self.kind, json.dumps(self.params))]
        SparkSession.active().createDataFrame(row, "kind string, params string").write.mode("overwrite").json(f"{path}/votes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighbourFit:
        row = spark.read.schema("kind string, params string").json(f"{path}/votes").first()
        return cls(spark.read.parquet(f"{path}/rows"), json.loads(row["params"]))
