"""Cross-validation, model comparison, search, ensembles, and end-to-end training and scoring."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.functions import arrays, scores
from stackmill.operators import metrics, neighbors, quality, scaling, selection, splits
from stackmill.operators import stacking as stack
from stackmill.plans import scoring
from stackmill.plans.bank import Bank, run_bank, scale_of, votes_of_runs
from stackmill.plans.estimators import META, Fitted, fit, train_size
from stackmill.session import stored

# Search grid per model type; the first value of each list is the default.
GRID: dict[str, dict[str, list[Any]]] = {
    "random_forest": {"trees": [100, 200, 500], "depth": [5, 10, 20, None], "split": [2, 5, 10], "balanced": [True]},
    "xgboost": {"trees": [100, 200], "depth": [3, 5, 7], "step": [0.01, 0.1, 0.3], "positive_weight": [1, 2, 5]},
    "gradient_boosting": {"trees": [100, 200], "depth": [3, 5], "step": [0.01, 0.1]},
    "svm": {"C": [0.1, 1, 10], "kernel": ["rbf", "linear"], "gamma": ["scale", "auto"], "balanced": [True]},
    "logistic_regression": {"C": [0.1, 1, 10], "balanced": [True], "max_iter": [1000]},
    "knn": {"k": [3, 5, 7, 11], "weights": ["uniform", "distance"], "metric": ["euclidean", "manhattan"]},
    "mlp": {"hidden": [(100,), (100, 50), (200, 100)], "max_iter": [500]},
}
KIND = {
    "random_forest": "rf", "xgboost": "xgboost", "gradient_boosting": "gb", "svm": "svm", "logistic_regression": "lr",
    "knn": "knn", "mlp": "mlp",
}
SEARCH_SEED = 42


def default_params(model_type: str) -> dict[str, Any]:
    """The first value of each grid list."""
    return {k: v[0] for k, v in GRID[model_type].items()}


def spark_params(model_type: str, params: Mapping[str, Any], width: int) -> dict[str, Any]:
    """Grid values in the terms of the estimators: a node that must hold ``split`` rows gets leaves of half of that."""
    out = dict(params)
    if model_type == "random_forest" and "split" in out:
        out["leaf"] = max(1, out.pop("split") // 2)
    if model_type == "svm" and out.get("gamma") == "auto":
        out["gamma"] = 1.0 / width
    return out


def train_model(train: DataFrame, model_type: str = "random_forest", params: Mapping[str, Any] | None = None) -> Fitted:
    """Fit one model type, with its default parameters unless others are given."""
    if model_type not in GRID:
        raise ValueError(f"unknown model type {model_type!r}; available: {sorted(GRID)}")
    size = train_size(train)
    chosen = spark_params(model_type, params or default_params(model_type), size.width)
    return fit(KIND[model_type], train, chosen, seed=SEARCH_SEED, size=size)


def cross_validate(
    rows: DataFrame, models: Mapping[str, Mapping[str, Any]], folds: int = 5, repeats: int = 3, parallelism: int = 8
) -> DataFrame:
    """Metrics of every (model, seed, fold) on its validation rows. ``rows``: id, label, features."""
    bank = run_bank(rows.withColumn("role", F.lit("train")), models, range(repeats), folds, scaler="standard", parallelism=parallelism)
    return metrics.run_metrics(bank.predictions(rows.sparkSession), ["model", "seed", "fold"])


def cv_summary(folds: DataFrame) -> DataFrame:
    names = {"mcc": "mcc", "auc": "auc", "accuracy": "accuracy", "sensitivity": "sensitivity", "ppv": "precision"}
    return folds.groupBy("model").agg(
        *[f for c, n in names.items() for f in (F.avg(c).alias(f"{n}_mean"), F.stddev_pop(c).alias(f"{n}_std"))]
    )


def compare_models(rows: DataFrame, models: Mapping[str, Mapping[str, Any]], folds: int = 5) -> DataFrame:
    """One cross-validation per model, best mean MCC first."""
    summary = cv_summary(cross_validate(rows, models, folds, repeats=1))
    board = summary.select(
        "model", F.col("mcc_mean").alias("mcc"), F.col("auc_mean").alias("auc"), F.col("accuracy_mean").alias("accuracy")
    )
    return selection.leaderboard(board, "mcc", "model")


def grid_points(model_type: str, grid: Mapping[str, Sequence[Any]], method: str, n_iter: int) -> list[dict[str, Any]]:
    points = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    if method == "random" and n_iter < len(points):
        points = random.Random(SEARCH_SEED).sample(points, n_iter)
    return points


def hyperparameter_search(
    rows: DataFrame,
    model_type: str = "random_forest",
    grid: Mapping[str, Sequence[Any]] | None = None,
    method: str = "random",
    n_iter: int = 20,
    folds: int = 5,
    parallelism: int = 8,
) -> DataFrame:
    """Mean MCC over stratified folds of every tried parameter set, best first. ``rows``: id, label, features.

    The parameter sets are the models of one bank: every one is fitted on the rows of a fold's training side, scaled by them,
    and judged on the fold. Regressions, machines and neighbours of all sets pass over the rows together. Rows whose vector
    has another width than most are judged by nothing.
    """
    points = grid_points(model_type, grid or GRID[model_type], method, n_iter)
    width = rows.agg(F.mode(F.size("features")).alias("d")).first()["d"] or 1
    models = {f"p{n}": spark_params(model_type, p, width) for n, p in enumerate(points)}
    bank = run_bank(
        rows.withColumn("role", F.lit("train")), models, [SEARCH_SEED], folds, scaler="standard", parallelism=parallelism,
        kinds=dict.fromkeys(models, KIND[model_type]),
    )
    spark = rows.sparkSession
    per_fold = metrics.mcc_by_run(bank.predictions(spark).where("prob IS NOT NULL"), ["model", "seed", "fold"])
    tried = spark.createDataFrame([(m, json.dumps(p, sort_keys=True)) for m, p in zip(models, points, strict=True)], "model string, params string")
    board = per_fold.groupBy("model").agg(F.avg("mcc").alias("mcc")).join(F.broadcast(tried), "model").select("params", "mcc")
    return selection.leaderboard(board, "mcc", "params")


# -- ensembles ---------------------------------------------------------------------------------------------------------


@dataclass
class Ensemble:
    """Selected base runs and the meta-learner over their mean probabilities."""

    bank: Bank
    models: dict[str, Mapping[str, Any]]
    chosen: dict[str, list[tuple[int, int]]]
    meta_stats: Any
    meta: Fitted


def select_runs(pred: DataFrame, fraction: float) -> dict[str, list[tuple[int, int]]]:
    """The best runs of every model by validation MCC (one row per run is collected)."""
    table = metrics.mcc_by_run(pred.filter("role = 'fold_val'"), ["model", "seed", "fold"])
    best = selection.top_fraction(table, "model", "mcc", ["seed", "fold"], fraction)
    chosen: dict[str, list[tuple[int, int]]] = {}
    for r in best.collect():
        chosen.setdefault(r["model"], []).append((r["seed"], r["fold"]))
    return {m: sorted(runs) for m, runs in chosen.items()}


def chosen_predictions(pred: DataFrame, chosen: Mapping[str, Sequence[tuple[int, int]]]) -> DataFrame:
    runs = [(m, s, f) for m, splits_ in chosen.items() for s, f in splits_]
    table = pred.sparkSession.createDataFrame(runs, "model string, seed int, fold int")
    return stack.selected(pred, table, ["model", "seed", "fold"])


def standardized(df: DataFrame, stats: Any) -> DataFrame:
    scaled = arrays.standardize(F.col("features"), arrays.literal(stats["mean"]), arrays.literal(stats["std"]))
    return df.withColumn("features", scaled)


def fit_meta(
    meta_rows: DataFrame, shape: Mapping[str, Any] = META["base"], linear: bool = False
) -> tuple[Any, Fitted]:
    """Standardise the meta features and fit the meta-learner. ``meta_rows``: id, label, features. The net stops early on a
    part carved out of these rows, never on rows it is judged by."""
    stats = scaling.feature_stats(meta_rows).first()
    ready = standardized(meta_rows, stats)
    params = {"C": 1.0, "max_iter": 100} if linear else shape
    return stats, fit("lr" if linear else "meta", ready, params, seed=42)


def _stack_tables(pred: DataFrame, base: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What a meta-learner is fitted on (``id, label, features``: out-of-fold means of the training rows) and judged by
    (``id, y_true, features``: means over all runs of the test rows)."""
    oof = stack.oof_mean(pred.filter("role = 'fold_val'"), names)
    meta_rows = stored(base.select("id", "label").join(oof, "id").select("id", "label", F.array(*names).alias("features")), "meta")
    test = stack.wide(pred.filter("role = 'test'"), ["id", "y_true"], F.col("model"), names, how=F.avg)
    return meta_rows, test.select("id", "y_true", F.array(*names).alias("features"))


def train(
    rows: DataFrame,
    models: Mapping[str, Mapping[str, Any]],
    seeds: Sequence[int] = tuple(range(10)),
    folds: int = 5,
    holdout: float = 0.2,
    fraction: float = selection.TOP_FRACTION,
    shape: Mapping[str, Any] = META["base"],
    max_iter: int | None = None,
    linear: bool = False,
    parallelism: int = 8,
) -> tuple[Ensemble, DataFrame]:
    """Hold-out, bank of fits, selection, out-of-fold meta features, meta-learner.

    Returns the ensemble and the metrics of every base model and of the stack on the hold-out rows.
    """
    spark = rows.sparkSession
    marked = splits.stratified_holdout(rows.select("id", "label"), "id", "label", seed=42, fraction=holdout)
    roles = marked.select("id", F.when(F.col("is_holdout") == 1, "test").otherwise("train").alias("role"))
    bank = run_bank(rows.join(roles, "id"), models, seeds, folds, scaler="standard", parallelism=parallelism, keep_models=True)
    pred = bank.predictions(spark)
    chosen = select_runs(pred, fraction)
    used = chosen_predictions(pred, chosen)
    names = list(models)

    meta_rows, test = _stack_tables(used, bank.base, names)
    stats, meta = fit_meta(meta_rows, shape if max_iter is None else {**shape, "epochs": max_iter}, linear)

    mean = stack.ensemble_mean(used.filter("role = 'test'"), ["id", "model", "y_true"])
    stacked = meta.score(standardized(test, stats)).select(F.lit("stack").alias("model"), "y_true", "prob")
    everything = mean.select("model", "y_true", "prob").unionByName(stacked)
    return Ensemble(bank, dict(models), chosen, stats, meta), metrics.run_metrics(everything, ["model"])


def _neighbour_votes(ensemble: Ensemble, rows: DataFrame) -> DataFrame:
    """id and the mean vote of all chosen neighbour runs: one join, grouped by run."""
    bank, p = ensemble.bank, ensemble.models["knn"]
    place = {s: i for i, s in enumerate(sorted({s for s, _ in bank.stats}))}
    pool, queries = bank.base.filter("role = 'train'"), rows.select("id", "features")
    found = votes_of_runs(pool, queries, ensemble.chosen["knn"], place, bank.stats, bank.scaler, p["k"], p.get("metric", "euclidean"))
    return neighbors.vote(found, ["run"], p.get("weights", "uniform")).groupBy("id").agg(F.avg("prob").alias("knn"))


def base_probabilities(ensemble: Ensemble, rows: DataFrame) -> DataFrame:
    """id and the mean probability of every base model as ``features``.

    All fitted runs score a row in one narrow pass, whatever their number (``scoring``); only neighbour votes need a join, one
    for all runs. Rows whose vector is null or of another width keep null means.
    """
    spark, bank = rows.sparkSession, ensemble.bank
    runs = []
    for model, chosen in ensemble.chosen.items():
        for split in chosen if model != "knn" else ():
            width, predictor = scoring.packed(spark, bank.model_path(model, split))
            runs.append(scoring.Run(model, width, *scale_of(bank.stats[split], bank.scaler), predictor))
    out = scoring.mean_probabilities(rows, runs)
    if "knn" in ensemble.chosen:
        out = out.join(_neighbour_votes(ensemble, rows), "id", "left")  # no row is lost for want of neighbours
    return out.select("id", F.array(*ensemble.models).alias("features"))


def predict(ensemble: Ensemble, rows: DataFrame) -> DataFrame:
    """id, prob, cls of new rows (id, features)."""
    ready = standardized(base_probabilities(ensemble, rows), ensemble.meta_stats)
    return ensemble.meta.score(ready).select("id", "prob", scores.threshold_class(F.col("prob")).alias("cls"))


def _files(spark: SparkSession, path: str) -> dict[str, str]:
    """sha256 of every file of a bundle but its training rows and its manifest, by the path inside the bundle."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{path}/{p}" for p in ("meta", "scalers", "selection", "state", "base")])
    listed = [(r["path"], r["h"]) for r in found.select("path", F.sha2("content", 256).alias("h")).toLocalIterator()]
    root = next(p for p, _ in listed if "/state/part-" in p).rpartition("/state/")[0]
    return {p[len(root) + 1 :]: h for p, h in listed}


def _rows_mark(rows: DataFrame) -> str:
    """Number and order-free checksum of the training rows."""
    r = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "label", "features").cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}:{r['s']}"


def save(ensemble: Ensemble, path: str, names: Sequence[str]) -> str:
    """Write a bundle that stands alone: meta-learner, base models, selection, scalers, feature names, the training rows if
    neighbours vote, and a manifest of the content hashes. It names no path outside itself and can be copied elsewhere."""
    spark, bank = SparkSession.active(), ensemble.bank
    ensemble.meta.save(f"{path}/meta")
    scalers = [(s, f, r["low"], r["high"], r["mean"], r["std"]) for (s, f), r in bank.stats.items()]
    arrays_ddl = "low array<double>, high array<double>, mean array<double>, std array<double>"
    spark.createDataFrame(scalers, f"seed int, fold int, {arrays_ddl}").write.mode("overwrite").parquet(f"{path}/scalers")
    runs = [(m, s, f) for m, splits_ in ensemble.chosen.items() for s, f in splits_]
    selected = spark.createDataFrame(runs, "model string, seed int, fold int")
    selected.write.mode("overwrite").parquet(f"{path}/selection")
    selected.limit(0).write.mode("overwrite").parquet(f"{path}/base/none")  # the folder is there without any fitted base model
    for model, seed, fold in runs:
        if model != "knn":
            Fitted.load(spark, bank.model_path(model, (seed, fold))).save(f"{path}/base/models/{model}-{seed}-{fold}")
    rows = bank.base if "knn" in ensemble.chosen else bank.base.limit(0)
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    state = {
        "models": ensemble.models, "scaler": bank.scaler, "names": list(names), "mean": list(ensemble.meta_stats["mean"]),
        "std": list(ensemble.meta_stats["std"]), "rows": _rows_mark(spark.read.parquet(f"{path}/rows")),
    }
    spark.createDataFrame([(json.dumps(state),)], "state string").write.mode("overwrite").parquet(f"{path}/state")
    spark.createDataFrame(sorted(_files(spark, path).items()), "file string, sha256 string").write.mode("overwrite").parquet(f"{path}/manifest")
    return path


def load(spark: SparkSession, path: str, verify: bool = True) -> Ensemble:
    """Read a bundle from wherever it lies now. ``verify`` refuses one whose files or training rows are not those it was saved with."""
    state = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
    rows = spark.read.parquet(f"{path}/rows")
    if verify:
        listed, there = {r["file"]: r["sha256"] for r in spark.read.parquet(f"{path}/manifest").collect()}, _files(spark, path)
        wrong = sorted(f for f in listed.keys() | there.keys() if listed.get(f) != there.get(f))
        if wrong or _rows_mark(rows) != state["rows"]:
            raise ValueError(f"the bundle {path} is not as it was saved: {', '.join(wrong) or 'rows'}")
    stats = {(r["seed"], r["fold"]): r for r in spark.read.parquet(f"{path}/scalers").collect()}
    chosen: dict[str, list[tuple[int, int]]] = {}
    for r in spark.read.parquet(f"{path}/selection").orderBy("model", "seed", "fold").collect():
        chosen.setdefault(r["model"], []).append((r["seed"], r["fold"]))
    bank = Bank(f"{path}/base", state["scaler"], stats, rows)
    meta_stats = {"mean": state["mean"], "std": state["std"]}
    return Ensemble(bank, state["models"], chosen, meta_stats, Fitted.load(spark, f"{path}/meta"))


@dataclass
class Scaled:
    """A fitted model and the means and deviations its rows are standardised by."""

    stats: Any
    fitted: Any

    def score(self, df: DataFrame, prob: str = "prob") -> DataFrame:
        scaled = self.fitted.score(standardized(df.withColumn("__raw", F.col("features")), self.stats), prob)
        return scaled.withColumn("features", F.col("__raw")).drop("__raw")


def train_ensemble(
    rows: DataFrame, models: Mapping[str, Mapping[str, Any]], folds: int = 5, inner: int = 5, parallelism: int = 8
) -> tuple[DataFrame, dict[str, Scaled], Scaled]:
    """Stacking with a logistic meta-learner: nested scores per fold, and the base models and the meta-learner of all rows,
    each with its scaler. ``rows``: id, label, features.

    The rows of an outer fold are judged by a stack that never saw them: base models, scalers and out-of-fold probabilities come
    from ``inner`` folds of the other rows alone, and so does the meta-learner. The returned meta-learner is fitted on the
    out-of-fold probabilities of all rows, the returned base models on all rows.
    """
    spark, names = rows.sparkSession, list(models)
    outer = splits.stratified_folds(rows.select("id", "label"), "id", "label", seeds=[0], folds=folds)
    marked = stored(rows.join(outer.select("id", F.col("fold").alias("outer")), "id"), "ensemble")

    def stack_of(table: DataFrame):
        bank = run_bank(table, models, [1], inner, scaler="standard", parallelism=parallelism)
        meta_rows, test = _stack_tables(bank.predictions(spark), bank.base, names)
        return *fit_meta(meta_rows, linear=True), test

    def judged(fold: int) -> DataFrame:
        role = F.when(F.col("outer") == fold, "test").otherwise("train")
        stats, meta, test = stack_of(marked.withColumn("role", role).drop("outer"))
        scored = meta.score(standardized(test, stats)).select(F.lit(fold).alias("fold"), "y_true", "prob")
        return stored(scored, "judged")

    with ThreadPoolExecutor(max_workers=min(parallelism, folds)) as pool:
        parts = list(pool.map(judged, range(folds)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    stats, meta, _ = stack_of(marked.withColumn("role", F.lit("train")).drop("outer"))
    all_stats = scaling.feature_stats(rows).first()
    ready = standardized(rows, all_stats)
    base = {m: Scaled(all_stats, fit(m, ready, p)) for m, p in models.items()}
    return metrics.run_metrics(out, ["fold"]), base, Scaled(stats, meta)


def validate_external(fitted: Fitted, rows: DataFrame, name: str = "external") -> DataFrame:
    """Score an external table (id, label, features) and assess it against the thresholds."""
    scored = fitted.score(rows).select(F.lit(name).alias("dataset"), F.col("label").alias("y_true"), "prob")
    counts = metrics.run_table(scored, ["dataset"])
    vector = counts.select(
        "dataset", *scores.COUNTS, scores.mcc().alias("mcc"), "auc", scores.accuracy().alias("accuracy"),
        scores.sensitivity().alias("sensitivity"), scores.specificity(undefined_as_zero=True).alias("specificity"),
    )
    return quality.assess(vector)

