"""Prediction tables in long form, and the inputs of the meta-learner."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selected(pred: DataFrame, runs: DataFrame, on: Sequence[str]) -> DataFrame:
    """The predictions of the selected runs (a table with one row per run)."""
    return pred.join(F.broadcast(runs.select(*on)), list(on), "left_semi")


def run_name(model: str = "model", seed: str = "seed") -> Column:
    return F.concat_ws("_", F.col(model), F.col(seed).cast("string"))


def wide(
    pred: DataFrame, id_cols: Sequence[str], run: Column, runs: Sequence[str], prob: str = "prob",
    how: Callable[[Column], Column] = F.max,
) -> DataFrame:
    """One row per id, one probability column per named run: one shuffle instead of a join per run.

    Several rows of a run are folded by ``how``. The pivot folds map-side, and its generated code does not grow with the
    number of runs.
    """
    named = pred.select(*id_cols, run.alias("__run"), prob)
    return named.groupBy(*id_cols).pivot("__run", list(runs)).agg(how(F.col(prob)))


def ensemble_mean(pred: DataFrame, keys: Sequence[str] = ("id", "model"), prob: str = "prob") -> DataFrame:
    return pred.groupBy(*keys).agg(F.avg(prob).alias("prob"))


def oof_mean(pred: DataFrame, models: Sequence[str], shared_count: bool = False) -> DataFrame:
    """Out-of-fold meta features: per row and model the mean of its validation probabilities.

    ``shared_count`` divides every model's sum by the row's predictions of all models together, as an older variant did.
    A model without a selected run for a row gives 0.
    """
    sums = [F.sum(F.when(F.col("model") == m, F.col("prob"))) for m in models]
    counts = [F.count_if(F.col("model") == m) for m in models]
    every = sum(counts[1:], counts[0])
    return pred.groupBy("id").agg(
        *[
            F.coalesce(F.try_divide(s, every if shared_count else c), F.lit(0.0)).alias(m)
            for m, s, c in zip(models, sums, counts, strict=True)
        ]
    )


def compare_pair(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    """The predictions of two models side by side; a missing side is null."""
    left = a.select("id", F.col("prob").alias(f"prob_{names[0]}"), F.col("cls").alias(f"class_{names[0]}"))
    right = b.select("id", F.col("prob").alias(f"prob_{names[1]}"), F.col("cls").alias(f"class_{names[1]}"))
    return left.join(right, "id", "full")


def cyp_interaction(cyto: Column, cyp: Column) -> Column:
    """Scaled cytotoxicity times the sum of the scaled enzyme bindings."""
    return cyto * F.aggregate(cyp, F.lit(0.0), lambda acc, x: acc + x)


def meta_vector_v2(probs: Column, mech: Column) -> Column:
    """Base probabilities, then the scaled mechanistic columns (values and their flags)."""
    return F.concat(probs, mech)


def meta_vector_v3(probs: Column, mech: Column, cyp: Column, flags: Column, cyto_position: int = 1) -> Column:
    """Base probabilities, mechanistic, enzyme and flag columns, then the interaction."""
    return F.concat(probs, mech, cyp, flags, F.array(cyp_interaction(F.get(mech, F.lit(cyto_position)), cyp)))
