"""Scalers fitted per split. Constant features are shifted only; the deviation is the population's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackmill.functions import arrays
from stackmill.operators.ranks import with_row


def feature_stats(df: DataFrame, features: str = "features", keys: Sequence[str] = ()) -> DataFrame:
    """Per group: ``n`` and the arrays ``low, high, mean, std`` (one map-side combined pass, one row per group)."""
    summary = Summarizer.metrics("count", "min", "max", "mean", "variance").summary(array_to_vector(F.col(features)))
    raw = df.groupBy(*keys).agg(summary.alias("s")).select(
        *keys,
        F.col("s.count").alias("n"),
        vector_to_array("s.min").alias("low"),
        vector_to_array("s.max").alias("high"),
        vector_to_array("s.mean").alias("mean"),
        vector_to_array("s.variance").alias("variance"),
    )
    shrink = (F.col("n") - 1) / F.col("n")
    population = F.zip_with("variance", F.zip_with("low", "high", lambda lo, hi: lo == hi), lambda v, const: F.when(
        const, F.lit(0.0)
    ).otherwise(F.sqrt(v * shrink)))
    return raw.withColumn("std", population).drop("variance")


def _fold_list(parts: Column, start: str, step) -> Column:
    return F.aggregate(parts, F.get(parts, F.lit(0))[start], step)


def train_stats(df: DataFrame, features: str = "features", keys: Sequence[str] = ("seed",), fold: str = "fold") -> DataFrame:
    """Statistics of the training side of every split, from one pass over the rows.

    ``df`` holds one row per (row, seed) with the fold that validates it. The statistics of a fold's own rows are
    taken once; those of the other folds together are then merged, instead of reading every row once per split.
    """
    own = feature_stats(df, features, [*keys, fold]).withColumnRenamed(fold, "__part")
    part = F.struct("__part", "n", "low", "high", "mean", "std")
    together = own.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("__parts"))
    split = together.withColumn("__out", F.explode(F.transform("__parts", lambda p: p["__part"]))).withColumn(
        "__in", F.filter("__parts", lambda p: p["__part"] != F.col("__out"))
    )
    parts = F.col("__in")
    n = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc + p["n"])
    low = _fold_list(parts, "low", lambda acc, p: F.zip_with(acc, p["low"], lambda a, b: F.least(a, b)))
    high = _fold_list(parts, "high", lambda acc, p: F.zip_with(acc, p["high"], lambda a, b: F.greatest(a, b)))
    zeros = F.transform(F.get(parts, F.lit(0))["mean"], lambda _: F.lit(0.0))
    mean = F.aggregate(
        parts, zeros, lambda acc, p: F.zip_with(acc, p["mean"], lambda a, m: a + m * (p["n"] / F.col("n")))
    )
    merged = split.withColumn("n", n).withColumn("low", low).withColumn("high", high).withColumn("mean", mean)
    spread = F.aggregate(
        parts,
        zeros,
        lambda acc, p: F.zip_with(
            acc,
            F.zip_with(
                p["std"],
                F.zip_with(p["mean"], F.col("mean"), lambda m, mu: (m - mu) * (m - mu)),
                lambda s, shift: (s * s + shift) * (p["n"] / F.col("n")),
            ),
            lambda a, v: a + v,
        ),
    )
    constant = F.zip_with("low", "high", lambda lo, hi: lo == hi)
    std = F.zip_with(spread, constant, lambda v, const: F.when(const, F.lit(0.0)).otherwise(F.sqrt(v)))
    return merged.withColumn("std", std).select(
        *keys, F.col("__out").alias(fold), "n", "low", "high", "mean", "std"
    )


def scale(
    df: DataFrame, stats: DataFrame, keys: Sequence[str] = (), kind: str = "minmax", features: str = "features"
) -> DataFrame:
    """Apply fitted statistics. ``stats`` has one row per split (splits x features values), so it is broadcast."""
    names = ["low", "high"] if kind == "minmax" else ["mean", "std"]
    if keys:
        fitted = F.broadcast(stats.select(*keys, F.struct(*names).alias("__fit")))
        joined = df.join(fitted, list(keys))
    else:
        joined = with_row(df, stats.select(*names), "__fit")
    apply = arrays.minmax if kind == "minmax" else arrays.standardize
    scaled = apply(F.col(features), *[F.col("__fit")[n] for n in names])
    return joined.withColumn(features, scaled).drop("__fit")


def scale_blocks(
    df: DataFrame, blocks: dict[str, Sequence[str]], fit_on: Column, keep: Sequence[str]
) -> DataFrame:
    """Standardise every block of columns with its own scaler, fitted on the rows where ``fit_on`` holds.

    Returns ``keep`` and one array column per block.
    """
    columns = [c for block in blocks.values() for c in block]
    fit = df.filter(fit_on).agg(
        *[F.avg(F.col(c).cast("double")).alias(f"__m_{c}") for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"__s_{c}") for c in columns],
    )
    joined = with_row(df, fit, "__fit")

    def z(c: str) -> Column:
        sd = F.col("__fit")[f"__s_{c}"]
        return (F.col(c).cast("double") - F.col("__fit")[f"__m_{c}"]) / F.when(sd == 0.0, F.lit(1.0)).otherwise(sd)

    return joined.select(*keep, *[F.array(*[z(c) for c in block]).alias(name) for name, block in blocks.items()])


def impute_with_flag(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Fill missing values with the column's mean and add ``<column>_imputed`` (1 where a value was filled)."""
    fit_rows = df if fit_on is None else df.filter(fit_on)
    means = fit_rows.agg(*[F.avg(F.col(c).cast("double")).alias(f"__m_{c}") for c in columns])
    joined = with_row(df, means, "__fit")
    for c in columns:
        joined = joined.withColumn(f"{c}_imputed", F.col(c).isNull().cast("int")).withColumn(
            c, F.coalesce(F.col(c).cast("double"), F.col("__fit")[f"__m_{c}"])
        )
    return joined.drop("__fit")
