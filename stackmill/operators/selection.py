"""Choosing runs and features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackmill.operators.ranks import with_row

# The band of validation MCC in which a run is kept.
MCC_BAND = (0.128, 0.351)
TOP_FRACTION = 0.7


def scores_long(wide: DataFrame, key: str, suffix: str = "_MCC") -> DataFrame:
    """One column per model (``knn_MCC``) to one row per (split, model)."""
    columns = [c for c in wide.columns if c.endswith(suffix)]
    long = wide.unpivot([key], columns, "model", "mcc")
    return long.withColumn("model", F.expr(f"left(model, length(model) - {len(suffix)})"))


def in_band(scores: DataFrame, value: str = "mcc", band: tuple[float, float] = MCC_BAND) -> DataFrame:
    """The runs inside the band, both ends included."""
    return scores.filter(F.col(value).between(*band))


def top_fraction(scores: DataFrame, model: str, value: str, run: Sequence[str], fraction: float = TOP_FRACTION) -> DataFrame:
    """The best ``fraction`` of every model's runs, at least one; ties to the later run. The table has one row per run."""
    group = Window.partitionBy(model)
    best = group.orderBy(F.col(value).desc(), *[F.col(c).desc() for c in run])
    keep = F.greatest(F.lit(1), F.floor(F.lit(fraction) * F.count(F.lit(1)).over(group)))
    ranked = scores.withColumn("rank", F.row_number().over(best).cast("bigint")).withColumn("__keep", keep)
    return ranked.filter(F.col("rank") <= F.col("__keep")).drop("__keep")


def leaderboard(scores: DataFrame, value: str, name: str, n: int | None = None) -> DataFrame:
    ordered = scores.orderBy(F.col(value).desc(), name)
    return ordered.limit(n) if n else ordered


def feature_variance(df: DataFrame, features: str = "features") -> DataFrame:
    """Population variance of every feature position; exactly 0 for a constant one."""
    s = Summarizer.metrics("count", "min", "max", "variance").summary(array_to_vector(F.col(features)))
    one = df.agg(s.alias("s")).select(
        F.col("s.count").alias("n"),
        F.arrays_zip(
            vector_to_array("s.min").alias("lo"),
            vector_to_array("s.max").alias("hi"),
            vector_to_array("s.variance").alias("v"),
        ).alias("z"),
    )
    population = F.when(F.col("c.lo") == F.col("c.hi"), 0.0).otherwise(F.col("c.v") * (F.col("n") - 1) / F.col("n"))
    return one.select("n", F.posexplode("z").alias("pos", "c")).select("pos", population.alias("score"))


def feature_label_correlation(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """Pearson correlation of every feature with the label."""
    long = df.select(F.col(label).cast("double").alias("__y"), F.posexplode(features).alias("pos", "x"))
    return long.groupBy("pos").agg(F.corr("x", "__y").alias("score"))


def mutual_information(df: DataFrame, features: str = "features", label: str = "label", bins: int = 16) -> DataFrame:
    """Mutual information (nats) of every feature, cut into equal-width bins, with the label."""
    s = Summarizer.metrics("min", "max").summary(array_to_vector(F.col(features)))
    ranges = df.agg(s.alias("s")).select(
        vector_to_array("s.min").alias("lo"), vector_to_array("s.max").alias("hi")
    )

    def bin_of(x: Column, i: Column) -> Column:
        lo, hi = F.get(F.col("__range.lo"), i), F.get(F.col("__range.hi"), i)
        place = F.floor(F.lit(float(bins)) * (x - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo))
        return F.least(F.lit(bins - 1), place.cast("int"))

    binned = with_row(df, ranges, "__range").select(
        F.col(label).alias("y"), F.posexplode_outer(F.transform(features, bin_of)).alias("pos", "bin")
    )
    cells = binned.groupBy("pos", "bin", "y").agg(F.count("*").alias("n"))  # features x bins x classes rows
    per = lambda *keys: F.sum("n").over(Window.partitionBy(*keys)).cast("double")
    joint = cells.select(
        "pos", F.col("n").cast("double").alias("n"), per("pos").alias("t"), per("pos", "bin").alias("b"), per("pos", "y").alias("c")
    )
    term = F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("b") * F.col("c")))
    return joint.groupBy("pos").agg(F.sum(term).alias("score"))


def top_features(scores: DataFrame, n: int, digits: int | None = None) -> DataFrame:
    """The ``n`` best-scored features with their rank; ties to the lower position."""
    value = F.col("score") if digits is None else F.round("score", digits)
    best = scores.withColumn("score", value).orderBy(F.col("score").desc(), "pos").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "pos")).cast("bigint"))
