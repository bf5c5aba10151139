"""Banks of base classifiers: every kind on every split, their predictions in one partitioned table."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.functions import arrays
from stackmill.operators import neighbors, scaling, splits
from stackmill.plans import shared
from stackmill.plans.estimators import Fitted, TrainSize, fit
from stackmill.session import scratch_path, spread, stored
from stackmill.sources.writers import write_partitioned

PRED_SCHEMA = "id bigint, role string, y_true int, prob double, model string, seed int, fold int"


@dataclass
class Bank:
    """Where the predictions and fitted models of a bank lie, and its scaler per split."""

    path: str
    scaler: str
    stats: dict[tuple[int, int], Any]
    base: DataFrame

    def predictions(self, spark: SparkSession) -> DataFrame:
        pred = spark.read.schema(PRED_SCHEMA).parquet(f"{self.path}/pred")
        return pred.withColumn("cls", (F.col("prob") > 0.5).cast("int"))

    def scaled(self, df: DataFrame, split: tuple[int, int]) -> DataFrame:
        return df.withColumn("features", scaled_features(self.stats[split], self.scaler))

    def model_path(self, model: str, split: tuple[int, int]) -> str:
        return f"{self.path}/models/{model}-{split[0]}-{split[1]}"


def scaled_features(row: Any, kind: str):
    if kind == "minmax":
        return arrays.minmax(F.col("features"), arrays.literal(row["low"]), arrays.literal(row["high"]))
    if kind == "standard":
        return arrays.standardize(F.col("features"), arrays.literal(row["mean"]), arrays.literal(row["std"]))
    return F.col("features")


def scale_of(stats: Mapping[str, Any] | Any, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Shift and span of a scaler; a feature that is constant in the fit rows is only shifted."""
    if kind == "minmax":
        shift, span = np.array(stats["low"], float), np.array(stats["high"], float) - np.array(stats["low"], float)
    elif kind == "standard":
        shift, span = np.array(stats["mean"], float), np.array(stats["std"], float)
    else:
        return np.zeros(len(stats["mean"])), np.ones(len(stats["mean"]))
    return shift, np.where(span == 0.0, 1.0, span)


def _mark(spark: SparkSession, path: str) -> str | None:
    """What a finished part of a bank says it was made of; None if the part is not there."""
    try:
        return spark.read.schema("value string").text(path).first()["value"]
    except AnalysisException:
        return None


def _rows_mark(rows: DataFrame) -> str:
    """Number and order-free checksum of the rows of a bank."""
    r = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "label", "role", "features").cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}:{r['s']}"


def with_folds(rows: DataFrame, seeds: Sequence[int], folds: int) -> DataFrame:
    """Add ``fold_of``: per seed the fold that validates a training row; null outside the training rows."""
    pool = rows.filter("role = 'train'").select("id", "label")
    long = splits.stratified_folds(pool, "id", "label", seeds=seeds, folds=folds)
    one = long.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seed", "fold"))).alias("s"))  # one per seed
    return rows.join(one.select("id", F.col("s.fold").alias("fold_of")), "id", "left")


def split_stats(base: DataFrame, seeds: Sequence[int]) -> tuple[dict, dict]:
    """Scaler statistics and class counts of every split's training side (splits x features values, collected)."""
    pool = base.filter(F.col("fold_of").isNotNull())
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in sorted(seeds)]).alias("seed"), F.col("fold_of").alias("fold")))
    long = pool.select("label", "features", pairs.alias("s")).select("label", "features", "s.seed", "s.fold")
    stats = {(r["seed"], r["fold"]): r for r in scaling.train_stats(long).collect()}
    counts: dict[tuple[int, int], dict[int, int]] = {}
    held: dict[tuple[int, int, int], int] = {
        (r["seed"], r["fold"], r["label"]): r["count"] for r in long.groupBy("seed", "fold", "label").count().collect()
    }
    for seed, fold in stats:
        counts[seed, fold] = {
            y: sum(n for (s, f, label), n in held.items() if s == seed and f != fold and label == y) for y in (0, 1)
        }
    return stats, counts


def _size(row: Any, counts: Mapping[int, int], kind: str) -> TrainSize:
    """Rows per class, and the variance of all scaled cells from the statistics of the columns."""
    means, variances = [], []
    for low, high, mean, std in zip(row["low"], row["high"], row["mean"], row["std"], strict=True):
        if kind == "minmax":
            span = (high - low) or 1.0
            means.append((mean - low) / span)
            variances.append((std / span) ** 2)
        elif kind == "standard":
            means.append(0.0)
            variances.append(1.0 if std else 0.0)
        else:
            means.append(mean)
            variances.append(std * std)
    d = len(means)
    centre = sum(means) / d
    variance = sum(v + (m - centre) ** 2 for m, v in zip(means, variances, strict=True)) / d
    return TrainSize(d, counts[0], counts[1], max(variance, 1e-12))


def votes_of_runs(
    pool: DataFrame, queries: DataFrame, runs: Sequence[tuple[int, int]], place: Mapping[int, int], stats: Mapping, scaler: str, k: int,
    metric: str = "euclidean",
) -> DataFrame:
    """``run, neighbour, distance, label, rank`` per query ``id``: the nearest rows of many splits (seed, fold) by one join,
    grouped by run, the index of a split.

    ``pool``: training rows with ``fold_of``; a run sees those outside its fold. ``queries``: id, features and, if a query
    belongs to some runs only, ``fold_of`` (null: to all). Every run has its own scaler, so both sides are spread over the runs
    by a table with one row of statistics per run.
    """
    lines = []
    for n, (seed, fold) in enumerate(runs):
        shift, span = scale_of(stats[seed, fold], scaler)
        lines.append((n, place[seed], fold, shift.tolist(), span.tolist()))
    table = pool.sparkSession.createDataFrame(lines, "run int, place int, fold int, shift array<double>, span array<double>")
    width = len(lines[0][3])

    def spread_over(df: DataFrame, keep) -> DataFrame:
        usable = df.filter(F.size("features") == width).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(len(lines) - 1))))
        long = usable.join(F.broadcast(table), "run").filter(keep)
        return long.withColumn("features", arrays.standardize(F.col("features"), F.col("shift"), F.col("span")))

    outside = F.get("fold_of", F.col("place")) != F.col("fold")
    mine = F.col("fold_of").isNull() | ~outside if "fold_of" in queries.columns else F.lit(True)
    t = spread_over(pool.filter(F.col("fold_of").isNotNull()), outside).select("run", "id", "label", "features")
    return neighbors.knn_join(spread_over(queries, mine).select("run", "id", "features"), t, k, groups=["run"], metric=metric)


def run_bank(
    rows: DataFrame,
    models: Mapping[str, Mapping[str, Any]],
    seeds: Sequence[int] = tuple(range(20)),
    folds: int = 5,
    path: str | None = None,
    scaler: str = "minmax",
    parallelism: int = 8,
    keep_models: bool = False,
    kinds: Mapping[str, str] | None = None,
) -> Bank:
    """Fit every model on every split and write its predictions for the split's validation rows and all other roles.

    ``rows``: id, label, features and role ('train' rows are split; 'holdout' and 'test' rows are only scored). ``kinds``
    names the classifier of a model whose name does not. All logistic regressions and machines, of whatever parameters, are
    fitted by shared passes over the rows (``shared``), neighbours vote by one join a metric, and their Spark jobs do not grow
    with the splits; all other fits are independent jobs, submitted from a few threads. Every part leaves a mark of its rows,
    splits and parameters when it is done, so a restarted run with the same ``path`` skips what is done and nothing else.
    """
    spark = rows.sparkSession
    path = path or scratch_path(spark, "bank")
    base = stored(spread(with_folds(rows, seeds, folds), "id"), "bank-rows")
    stats, counts = split_stats(base, seeds)
    place = {s: i for i, s in enumerate(sorted(seeds))}
    bank = Bank(path, scaler, stats, base)
    kind_of = {m: (kinds or {}).get(m, m) for m in models}
    made_of = json.dumps([_rows_mark(base), scaler, sorted(seeds), folds])
    all_splits = sorted(stats)

    def missing(name: str, part: str) -> bool:
        return _mark(spark, f"{path}/done/{part}") != json.dumps([made_of, kind_of[name], models[name]])

    def done(name: str, part: str) -> None:
        mark = json.dumps([made_of, kind_of[name], models[name]])
        spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/done/{part}")

    def size_of(split: tuple[int, int]) -> TrainSize:
        return _size(stats[split], counts[split], scaler)

    def linear(names: Sequence[str]) -> None:
        runs = [(m, *split) for m in names for split in all_splits]
        jobs = [
            shared.job_of(kind_of[m], models[m], place[s], f, scale_of(stats[s, f], scaler), size_of((s, f)), s + 1) for m, s, f in runs
        ]
        fits = shared.fit_shared(base, jobs)
        for m in names:
            own = [k for k, r in enumerate(runs) if r[0] == m]
            found = shared.predictions(base, [runs[k] for k in own], [jobs[k] for k in own], [fits[k] for k in own])
            write_partitioned(found.drop("model"), f"{path}/pred/model={m}", ["seed", "fold"])
            for k in own if keep_models else ():
                fits[k].save(bank.model_path(m, runs[k][1:]))
            done(m, m)

    def votes(metric: str, names: Sequence[str]) -> None:
        most = max(models[m]["k"] for m in names)  # fewer neighbours are the first of more
        found = votes_of_runs(base, base.select("id", "features", "fold_of"), all_splits, place, stats, scaler, most, metric)
        found = found if len(names) == 1 else stored(found, "neighbours")
        runs = F.array(*[F.struct(F.lit(n).alias("run"), F.lit(s).alias("seed"), F.lit(f).alias("fold"), F.lit(place[s]).alias("place")) for n, (s, f) in enumerate(all_splits)])
        own = F.col("role") == "train"
        asked = base.withColumn("r", F.explode(runs)).filter(~own | (F.get("fold_of", F.col("r.place")) == F.col("r.fold"))).select(
            F.col("id").cast("bigint").alias("id"), F.when(own, F.lit("fold_val")).otherwise(F.col("role")).alias("role"),
            F.col("label").cast("int").alias("y_true"), "r.run", "r.seed", "r.fold",
        )
        for m in names:
            probs = neighbors.vote(found, ["run"], models[m].get("weights", "uniform"), models[m]["k"])
            write_partitioned(asked.join(probs, ["run", "id"], "left").drop("run"), f"{path}/pred/model={m}", ["seed", "fold"])
            done(m, m)

    def one(job: tuple[str, tuple[int, int]]) -> None:
        name, (seed, fold) = job
        part = f"{name}-{seed}-{fold}"
        if not missing(name, part):
            return
        own = F.col("role") == "train"
        in_fold = F.get("fold_of", F.lit(place[seed])) == fold
        ready = bank.scaled(base, (seed, fold))
        train = ready.filter(own & ~in_fold)
        rest = ready.filter(~own | in_fold).select(
            "id", F.when(own, F.lit("fold_val")).otherwise(F.col("role")).alias("role"), F.col("label").alias("y_true"), "features"
        )
        fitted = fit(kind_of[name], train, models[name], seed=seed + 1, size=size_of((seed, fold)))
        if keep_models:
            fitted.save(bank.model_path(name, (seed, fold)))
        scored = fitted.score(rest)
        scored.select(F.col("id").cast("bigint").alias("id"), "role", F.col("y_true").cast("int").alias("y_true"), "prob").write.mode(
            "overwrite"
        ).parquet(f"{path}/pred/model={name}/seed={seed}/fold={fold}")
        done(name, part)

    together = [m for m in models if kind_of[m] in ("lr", "svm") and missing(m, m)]
    parts = [lambda: linear(together)] if together else []
    metrics: dict[str, list[str]] = {}
    for m in models:
        if kind_of[m] == "knn" and missing(m, m):
            metrics.setdefault(models[m].get("metric", "euclidean"), []).append(m)
    parts += [lambda g=g: votes(*g) for g in metrics.items()]
    parts += [lambda j=(m, s): one(j) for m in models if kind_of[m] not in ("lr", "svm", "knn") for s in all_splits]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        list(pool.map(lambda part: part(), parts))
    return bank


def load_model(spark: SparkSession, bank: Bank, model: str, split: tuple[int, int]) -> Fitted:
    return Fitted.load(spark, bank.model_path(model, split))
