"""Metric expressions over the four confusion counts ``tn, fp, fn, tp``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNTS = ("tn", "fp", "fn", "tp")


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def accuracy() -> Column:
    return F.try_divide(_d("tp") + _d("tn"), _d("tn") + _d("fp") + _d("fn") + _d("tp"))


def sensitivity() -> Column:
    return safe_ratio(_d("tp"), _d("tp") + _d("fn"))


def specificity(undefined_as_zero: bool = False) -> Column:
    """TN / (TN + FP): null without negatives, or 0 in the validators."""
    if undefined_as_zero:
        return safe_ratio(_d("tn"), _d("tn") + _d("fp"))
    return F.try_divide(_d("tn"), _d("tn") + _d("fp"))


def precision() -> Column:
    return safe_ratio(_d("tp"), _d("tp") + _d("fp"))


def npv(epsilon: float = 0.0) -> Column:
    """TN / (TN + FN + epsilon): null when the denominator is 0."""
    return F.try_divide(_d("tn"), _d("tn") + _d("fn") + F.lit(epsilon))


def f1() -> Column:
    return safe_ratio(2 * _d("tp"), 2 * _d("tp") + _d("fp") + _d("fn"))


def mcc() -> Column:
    """Matthews correlation, 0 when a margin is empty."""
    tn, fp, fn, tp = (_d(c) for c in COUNTS)
    return safe_ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def balanced_accuracy() -> Column:
    """Mean of sensitivity and specificity over the classes that occur."""
    sens = F.try_divide(_d("tp"), _d("tp") + _d("fn"))
    spec = F.try_divide(_d("tn"), _d("tn") + _d("fp"))
    return F.when(sens.isNull(), spec).when(spec.isNull(), sens).otherwise((sens + spec) / 2)


def threshold_class(prob: Column, cut: float = 0.5) -> Column:
    """1 above the cut, 0 at or below it."""
    return (prob > F.lit(cut)).cast("int")
