"""Data profiles, stability, assessment and baselines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackmill.operators.ranks import with_row

# Acceptance thresholds and baselines.
THRESHOLDS = {"mcc": 0.3, "auc": 0.7, "sensitivity": 0.6, "specificity": 0.6}
MIN_ROWS = 100
BASELINES = {
    "random": {"mcc": 0.0, "auc": 0.5, "accuracy": 0.5},
    "majority": {"mcc": 0.0, "auc": 0.5, "accuracy": 0.6},
    "published": {"mcc": 0.45, "auc": 0.80, "accuracy": 0.75},
}
#: Features of one block of products in a task.
PRODUCT_BLOCK = 256


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class, the ratio of the smallest to the largest class, and a warning below 0.2."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    extremes = counts.agg(F.min("n").alias("__lo"), F.max("n").alias("__hi"), F.sum("n").alias("n_rows"))
    ratio = F.col("e.__lo") / F.col("e.__hi")
    return with_row(counts, extremes, "e").select(
        "label",
        "n",
        F.col("e.n_rows").alias("n_rows"),
        (F.col("n") / F.col("e.n_rows")).alias("share"),
        ratio.alias("class_ratio"),
        (ratio < 0.2).alias("imbalanced"),
    )


def class_weights(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """Add the balanced weight n / (classes * n_class) to every row."""
    counts = df.groupBy(label).agg(F.count("*").alias("__c"))
    totals = counts.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    per_class = with_row(counts, totals, "t").select(
        label, (F.col("t.__n") / (F.col("t.__k") * F.col("__c"))).alias(weight)
    )
    return df.join(F.broadcast(per_class), label)


def data_quality(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """One row: size, classes, NaN and infinite values, constant features, issues, warnings, validity.

    One pass over the rows; nothing is exploded.
    """
    x = F.col(features)
    count = lambda test: F.aggregate(
        x, F.lit(0).cast("bigint"), lambda acc, v: acc + test(v).cast("bigint")
    )
    finite = F.transform(
        x, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)
    )
    summary = Summarizer.metrics("min", "max").summary(array_to_vector(finite))
    profile = df.agg(
        F.count("*").alias("n_samples"),
        F.max(F.size(x)).alias("n_features"),
        F.sum(count(lambda v: F.coalesce(F.isnan(v), F.lit(True)))).alias("n_nan"),
        F.sum(count(lambda v: F.coalesce(F.abs(v) == float("inf"), F.lit(False)))).alias("n_inf"),
        summary.alias("s"),
    )
    constant = F.zip_with(vector_to_array("s.min"), vector_to_array("s.max"), lambda a, b: (a == b).cast("int"))
    classes = df.groupBy(label).agg(F.count("*").alias("c")).agg(
        F.count("*").alias("n_classes"), (F.min("c") / F.max("c")).alias("class_ratio")
    )
    one = with_row(profile, classes, "c").select(
        "*", "c.*", F.aggregate(constant, F.lit(0), lambda acc, v: acc + v).cast("bigint").alias("n_constant")
    )
    text = lambda c: F.col(c).cast("string")
    issues = [
        F.when(F.col("n_samples") < MIN_ROWS,
               F.concat(F.lit("Sample size ("), text("n_samples"), F.lit(f") below minimum ({MIN_ROWS})"))),
        F.when(F.col("n_nan") > 0, F.concat(F.lit("NaN values found: "), text("n_nan"))),
        F.when(F.col("n_inf") > 0, F.concat(F.lit("Inf values found: "), text("n_inf"))),
    ]
    warnings = [
        F.when(F.col("class_ratio") < 0.2, F.format_string("Imbalanced classes: ratio = %.2f", F.col("class_ratio"))),
        F.when(F.col("n_constant") > 0, F.concat(F.lit("Constant features: "), text("n_constant"))),
    ]
    return one.select(
        "n_samples", "n_features", "n_classes", "class_ratio", "n_nan", "n_inf", "n_constant",
        F.array_compact(F.array(*issues)).alias("issues"),
        F.array_compact(F.array(*warnings)).alias("warnings"),
    ).withColumn("is_valid", F.size("issues") == 0)


def _products(centre: np.ndarray):
    """Per batch and feature: the sums of its products with every block of features from its own on."""

    def run(batches):
        for batch in batches:
            values = batch.column(0)
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(centre)) - centre
            for low in range(0, len(centre), PRODUCT_BLOCK):
                rows = x[:, low : low + PRODUCT_BLOCK].T
                for start in range(low, len(centre), PRODUCT_BLOCK):
                    sums = rows @ x[:, start : start + PRODUCT_BLOCK]
                    features = np.arange(low, low + len(rows), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(features), pa.array(np.full(len(rows), start, np.int32)), pa.array(list(sums), pa.list_(pa.float64()))],
                        ["a", "start", "sums"],
                    )

    return run


def feature_correlations(df: DataFrame, features: str = "features") -> DataFrame:
    """Pearson r of every feature pair ``(a, b), a < b``, for any number of features; pairs with a constant feature and rows
    without a vector are left out.

    Rows are reduced where they lie to sums of products per feature and block of features. A task holds one batch and one
    block of sums, and the result stays distributed; only the means come to the driver.
    """
    rows = df.select(F.col(features).cast("array<double>").alias("x")).filter("x IS NOT NULL")
    mean = rows.groupBy(F.lit("all")).agg(Summarizer.mean(array_to_vector(F.col("x"))).alias("m")).first()  # none without rows
    centre = mean["m"].toArray() if mean else np.zeros(0)
    parts = rows.mapInArrow(_products(centre), "a int, start int, sums array<double>")
    total = vector_to_array(Summarizer.sum(array_to_vector(F.col("sums"))))
    sums = parts.groupBy("a", "start").agg(total.alias("sums"))
    pairs = sums.select("a", "start", F.posexplode("sums").alias("at", "s")).select("a", (F.col("start") + F.col("at")).alias("b"), "s")
    own = pairs.filter("a = b AND s > 0").select("a", F.col("s").alias("ss"))
    other = own.select(F.col("a").alias("b"), F.col("ss").alias("tt"))
    r = F.col("s") / F.sqrt(F.col("ss")) / F.sqrt(F.col("tt"))
    joined = pairs.filter("a < b").join(own, "a").join(other, "b")  # pairs of features, not of rows
    return joined.select("a", "b", r.alias("r")).filter(~F.isnan("r"))


def high_correlation(pairs: DataFrame, threshold: float = 0.95) -> DataFrame:
    return pairs.filter(F.abs("r") > threshold)


def redundant_features(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Features with an earlier partner above the threshold, each once."""
    return high_correlation(pairs, threshold).select(F.col("b").alias("pos")).distinct()


def stability(scores: DataFrame, keys: Sequence[str], value: Column, name: str = "mcc") -> DataFrame:
    """Mean, population deviation, range and coefficient of a metric over the folds of a run, with warnings."""
    base = scores.groupBy(*keys).agg(
        F.count("*").alias("n_folds"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    cv = F.when(F.col("mean") == 0.0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("std"), F.col("mean")))
    flagged = base.withColumn("cv_coefficient", cv).withColumn("is_stable", F.col("cv_coefficient") < 0.2)
    outlier = (F.col("max") - F.col("min")) > 3 * F.col("std")
    warnings = F.array(
        F.when(~F.col("is_stable"), F.format_string("High variability in CV scores (CV = %.2f)", F.col("cv_coefficient"))),
        F.when(outlier, F.lit("Potential outlier folds detected")),
        F.when(F.col("min") < 0, F.lit(f"Negative {name} in some folds")),
    )
    return flagged.withColumn("has_outliers", outlier).withColumn("warnings", F.array_compact(warnings))


def assess(metrics: DataFrame, thresholds: Mapping[str, float] = THRESHOLDS) -> DataFrame:
    """One pass column per threshold whose metric is present, and their conjunction."""
    used = {m: t for m, t in thresholds.items() if m in metrics.columns}
    out = metrics
    for metric, limit in used.items():
        out = out.withColumn(f"{metric}_pass", F.col(metric) >= F.lit(limit))
    overall = F.lit(True)
    for metric in used:
        overall = overall & F.col(f"{metric}_pass")
    return out.withColumn("overall_pass", overall)


def baseline_table(df: DataFrame) -> DataFrame:
    rows = [(b, m, v) for b, values in BASELINES.items() for m, v in values.items()]
    return df.sparkSession.createDataFrame(rows, "baseline string, metric string, baseline_value double")


def versus_baseline(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Improvement over every baseline in percent (percentage points where the baseline is 0)."""
    present = [m for m in BASELINES["random"] if m in metrics.columns]
    long = metrics.select(*keys, *present).unpivot(list(keys), present, "metric", "value")
    joined = long.join(F.broadcast(baseline_table(metrics)), "metric")
    gain = F.when(
        F.col("baseline_value") != 0,
        F.try_divide(F.col("value") - F.col("baseline_value"), F.abs("baseline_value")) * 100,
    ).otherwise(F.col("value") * 100)
    return joined.withColumn("improvement_pct", gain)


def beats_baseline(comparison: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether MCC and AUC both reach the baseline (a missing metric counts as reached)."""
    lost = F.col("metric").isin("mcc", "auc") & (F.col("value") < F.col("baseline_value"))
    return comparison.groupBy(*keys, "baseline").agg((F.count_if(lost) == 0).alias("beats_baseline"))


def validation_report(assessed: DataFrame) -> DataFrame:
    return assessed.agg(
        F.count("*").alias("n_validations"),
        F.avg("mcc").alias("avg_mcc"),
        F.max("mcc").alias("best_mcc"),
        F.avg("auc").alias("avg_auc"),
        F.max("auc").alias("best_auc"),
        F.avg(F.col("overall_pass").cast("double")).alias("pass_rate"),
    )
