"""The run ledger: one row per action, append-only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackmill.operators.ranks import Running, prefix, ranked, top_rows


def numbered(ledger: DataFrame, run: str, ts: str, tie: str, bucket: Column, out: str = "iteration") -> DataFrame:
    """Number the actions of a run in the order of time. ``bucket`` is a coarse, non-decreasing function of ``ts``."""
    return ranked(ledger.withColumn("__t", bucket), [run], "__t", [ts, tie], rank=out).drop("__t")


def best_so_far(
    ledger: DataFrame, run: str, ts: str, tie: str, score: str, bucket: Column, start: float = 0.0, out: str = "iteration"
) -> DataFrame:
    """Number the actions of a run and add ``best_before`` (the best earlier score, at least ``start``), ``best_after``
    and whether the row improves strictly: one pass over the ledger."""
    placed = ledger.withColumn("__t", bucket)
    rows = prefix(placed, [run], "__t", [ts, tie], rank=out, values={"best_before": Running(score)}).drop("__t")
    best = F.greatest(F.coalesce(F.col("best_before"), F.lit(start)), F.lit(start))
    return (
        rows.withColumn("best_before", best)
        .withColumn("improved", F.coalesce(F.col(score) > F.col("best_before"), F.lit(False)))
        .withColumn("best_after", F.greatest(F.col("best_before"), F.col(score)))
    )


def recent(ledger: DataFrame, run: str, order: Sequence[Column], n: int = 5) -> DataFrame:
    """The last ``n`` rows of every run, newest first."""
    return top_rows(ledger, [run], order, n, rank="age")


def checkpoints(ledger: DataFrame, every: int = 5) -> DataFrame:
    """The iterations at which the state is saved, with the name of the saved state."""
    return ledger.filter(F.col("iteration") % every == 0).withColumn(
        "checkpoint", F.concat(F.lit("checkpoint_iter_"), F.col("iteration").cast("string"))
    )


def goal_reached(best: DataFrame, run: str, target: float, max_iterations: int) -> DataFrame:
    """Per run: the first iteration whose best score reaches the target or that is the last allowed one."""
    hit = F.min(F.when(F.col("best_after") >= target, F.col("iteration")))
    last = F.min(F.when(F.col("iteration") >= max_iterations, F.col("iteration")))
    return best.groupBy(run).agg(
        hit.alias("goal_iteration"),
        F.least(hit, last).alias("stop_iteration"),
        F.max("best_after").alias("best_score"),
    )


def state_summary(ledger: DataFrame, run: str, score: str, action: str, failed: Column, trained: Column) -> DataFrame:
    return ledger.groupBy(run).agg(
        F.max("iteration").alias("iteration"),
        F.greatest(F.max(score), F.lit(0.0)).alias("best_score"),
        F.count_if(trained).alias("models_trained"),
        F.count_if(failed).alias("errors"),
        F.count_distinct(action).alias("n_actions"),
        F.max_by(action, "iteration").alias("last_action"),
    )


def success(status: Column) -> Column:
    """An action succeeded unless its result says 'error' (a stored flag may say otherwise)."""
    return ~F.lower(F.coalesce(status, F.lit(""))).contains("error")

