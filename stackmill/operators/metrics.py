"""Confusion counts, metric vectors and exact ROC AUC per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackmill.functions import scores

LOGIT_STEP = 1.0 / 512
LOGIT_BOUND = 40.0


def confusion(df: DataFrame, keys: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "cls") -> DataFrame:
    t, p = F.col(y_true), F.col(y_pred)
    return df.groupBy(*keys).agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
    )


def _logit_bucket(prob: Column) -> Column:
    """A non-decreasing bucket number of a probability: at most about 41,000 buckets, fine near 0 and 1."""
    odds = F.try_divide(prob, F.lit(1.0) - prob)
    logit = (
        F.when(prob <= 0.0, F.lit(-LOGIT_BOUND))
        .when(prob >= 1.0, F.lit(LOGIT_BOUND))
        .otherwise(F.greatest(F.lit(-LOGIT_BOUND), F.least(F.lit(LOGIT_BOUND), F.ln(odds))))
    )
    return F.floor(logit / LOGIT_STEP)


def run_table(df: DataFrame, keys: Sequence[str], y_true: str = "y_true", prob: str = "prob") -> DataFrame:
    """Counts and exact ROC AUC of every run; ties count half, one class alone gives 0.5.

    Rows collapse to one per distinct probability first; ranks are then taken per (run, probability bucket) and the
    buckets are added up, so that no task sorts a whole run.
    """
    keys = list(keys)
    by_prob = (
        df.groupBy(*keys, F.col(prob).alias("__p"))
        .agg(F.count_if(F.col(y_true) == 1).alias("__pos"), F.count_if(F.col(y_true) == 0).alias("__neg"))
        .withColumn("__b", _logit_bucket(F.col("__p")))
        .withColumn("__cls", scores.threshold_class(F.col("__p")))
    )
    within = Window.partitionBy(*keys, "__b").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("__neg").over(within), F.lit(0))
    per_bucket = (
        by_prob.withColumn("__u", F.col("__pos").cast("double") * (below + F.col("__neg") / 2.0))
        .groupBy(*keys, "__b")
        .agg(
            F.sum("__u").alias("__u"),
            F.sum("__pos").alias("__pos"),
            F.sum("__neg").alias("__neg"),
            F.sum(F.when(F.col("__cls") == 0, F.col("__neg")).otherwise(0)).alias("tn"),
            F.sum(F.when(F.col("__cls") == 1, F.col("__neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(F.col("__cls") == 0, F.col("__pos")).otherwise(0)).alias("fn"),
            F.sum(F.when(F.col("__cls") == 1, F.col("__pos")).otherwise(0)).alias("tp"),
        )
    )
    runs = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("__neg").over(runs), F.lit(0))
    pairs = F.sum("__pos").cast("double") * F.sum("__neg").cast("double")
    return (
        per_bucket.withColumn("__u", F.col("__u") + F.col("__pos").cast("double") * lower)
        .groupBy(*keys)
        .agg(
            *[F.sum(c).alias(c) for c in scores.COUNTS],
            F.coalesce(F.try_divide(F.sum("__u"), pairs), F.lit(0.5)).alias("auc"),
        )
    )


def auc(df: DataFrame, keys: Sequence[str] = (), y_true: str = "y_true", prob: str = "prob") -> DataFrame:
    return run_table(df, keys, y_true, prob).select(*keys, "auc")


def mcc_by_run(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only the MCC of every run: one aggregation, no ranks."""
    return confusion(df, keys).select(*keys, scores.mcc().alias("mcc"))


def with_metrics(counts: DataFrame, digits: int | None = None) -> DataFrame:
    """The 13-value metric vector of a table with the four counts (and ``auc``, if the table has it)."""
    values = {
        "accuracy": scores.accuracy(),
        "sensitivity": scores.sensitivity(),
        "specificity": scores.specificity(),
        "ppv": scores.precision(),
        "npv": scores.npv(),
        "f1": scores.f1(),
        "mcc": scores.mcc(),
        "balanced_accuracy": scores.balanced_accuracy(),
    }
    if "auc" in counts.columns:
        values = {"auc": F.col("auc"), **values}
    if digits is not None:
        values = {k: F.round(v, digits) for k, v in values.items()}
    others = [c for c in counts.columns if c != "auc"]
    return counts.select(*others, *[v.alias(k) for k, v in values.items()])


def run_metrics(df: DataFrame, keys: Sequence[str], y_true: str = "y_true", prob: str = "prob") -> DataFrame:
    return with_metrics(run_table(df, keys, y_true, prob))


def agreement(pairs: DataFrame, prob_a: str, prob_b: str, class_a: str, class_b: str) -> DataFrame:
    """Share of equal classes and Pearson correlation of the probabilities where both models predict."""
    both = pairs.filter(F.col(class_a).isNotNull() & F.col(class_b).isNotNull())
    return both.agg(
        F.count(F.lit(1)).alias("n_both"),
        F.avg((F.col(class_a) == F.col(class_b)).cast("double")).alias("agreement"),
        F.corr(prob_a, prob_b).alias("prob_corr"),
    )
