"""Fits of many splits by shared passes: against plain solutions, single fits, and in the number of jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackmill.operators import neighbors
from stackmill.plans import bank, estimators, scoring, shared, stacking


def table(spark, n=240, seed=3, extra=()):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 4)) * [1.0, 5.0, 0.2, 1.0] + [0.0, 100.0, 0.0, 3.0]
    y = (x[:, 0] + 3 * x[:, 2] + 0.4 * draw.normal(size=n) > 0).astype(int)
    rows = [(i, int(y[i]), [float(v) for v in x[i]], "train" if i % 6 else "test") for i in range(n)]
    return spark.createDataFrame([*rows, *extra], "id long, label int, features array<double>, role string")


def newton(x, y, weight, C):
    xb, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    ridge = np.diag([0.0, *np.ones(x.shape[1])])
    for _ in range(60):
        p = 1 / (1 + np.exp(-xb @ w))
        w -= np.linalg.solve(C * (xb * (weight * p * (1 - p))[:, None]).T @ xb + ridge, C * xb.T @ (weight * (p - y)) + ridge @ w)
    return w


MODELS = {
    "a": {"C": 0.1, "max_iter": 300, "balanced": True}, "b": {"C": 10.0, "max_iter": 300, "balanced": False},
    "c": {"C": 1.0, "kernel": "linear", "balanced": True, "max_iter": 300},
    "d": {"C": 1.0, "kernel": "rbf", "gamma": "scale", "balanced": True, "n_features": 32, "max_iter": 300},
}
KINDS = {"a": "lr", "b": "lr", "c": "svm", "d": "svm"}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shared") / "bank")
    return bank.run_bank(table(spark), MODELS, seeds=[0, 7], folds=3, path=path, scaler="standard", keep_models=True, kinds=KINDS)


def fit_rows(built, place, fold):
    rows = [r for r in built.base.collect() if r.role == "train" and r.fold_of[place] != fold]
    return np.array([r.features for r in rows]), np.array([r.label for r in rows])


def test_regressions_of_all_splits_minimise_their_objective(spark, built):
    for name in ("a", "b"):
        for place, seed in enumerate((0, 7)):
            for fold in range(3):
                x, y = fit_rows(built, place, fold)
                x = (x - x.mean(0)) / x.std(0)
                weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if name == "a" else np.ones(len(y))
                fit = estimators.Fitted.load(spark, built.model_path(name, (seed, fold)))
                assert [fit.intercept, *fit.weights] == pytest.approx(list(newton(x, y, weight, MODELS[name]["C"])), abs=2e-3)


def test_machines_reach_the_loss_of_a_long_plain_descent(spark, built):
    x, y = fit_rows(built, 1, 2)
    x = (x - x.mean(0)) / x.std(0)
    s, weight = 2 * y - 1, np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))

    def objective(w):
        return (weight * np.maximum(0, 1 - s * (x @ w[1:] + w[0]))).sum() + w[1:] @ w[1:] / 2

    best, w = np.inf, np.zeros(5)
    for t in range(1, 20001):  # subgradients with falling steps
        inside = s * (x @ w[1:] + w[0]) < 1
        g = np.concatenate([[-(weight * s * inside).sum()], -(x.T @ (weight * s * inside)) + w[1:]])
        w = w - 0.5 / np.sqrt(t) * g / max(np.linalg.norm(g), 1e-9)
        best = min(best, objective(w))
    fit = estimators.Fitted.load(spark, built.model_path("c", (7, 2)))
    got = objective(np.concatenate([[fit.intercept], fit.weights]))
    assert got <= best + len(y) * shared.ROUND / 4 and fit.slope > 0


def test_predictions_are_those_of_the_saved_models(spark, built):
    pred = built.predictions(spark)
    n = {(r["model"], r["role"]): r["count"] for r in pred.groupBy("model", "role").count().collect()}
    assert n == {(m, r): c for m in MODELS for r, c in (("fold_val", 2 * 200), ("test", 6 * 40))}
    for name in MODELS:
        fit = estimators.Fitted.load(spark, built.model_path(name, (0, 1)))
        own = built.scaled(built.base, (0, 1)).filter("role = 'test' OR fold_of[0] = 1").select("id", "features")
        want = {r.id: r.prob for r in fit.score(own).collect()}
        got = {r.id: r.prob for r in pred.filter(f"model = '{name}' AND seed = 0 AND fold = 1").collect()}
        assert got == pytest.approx(want) and 0 < min(got.values()) and max(got.values()) < 1
        width, predict = scoring.packed(spark, built.model_path(name, (0, 1)))
        rows = own.orderBy("id").collect()
        assert list(predict(np.array([r.features for r in rows]))) == pytest.approx([want[r.id] for r in rows]) and width == 4


def test_single_fits_agree(spark, built):
    train = built.scaled(built.base, (0, 0)).filter("role = 'train' AND fold_of[0] <> 0").select("id", "label", "features")
    rest = built.scaled(built.base, (0, 0)).filter("role = 'test'").select("id", "features")
    for name, gap in (("a", 0.01), ("b", 0.01), ("c", 0.08), ("d", 0.12)):
        alone = {r.id: r.prob for r in estimators.fit(KINDS[name], train, MODELS[name], seed=1).score(rest).collect()}
        got = {r.id: r.prob for r in built.predictions(spark).filter(f"model = '{name}' AND seed = 0 AND fold = 0 AND role = 'test'").collect()}
        assert np.mean([abs(got[i] - alone[i]) for i in alone]) < gap


def test_neighbours_of_all_splits_are_those_of_one(spark, tmp_path):
    built = bank.run_bank(table(spark), {"knn": {"k": 5}}, seeds=[0, 7], folds=3, path=str(tmp_path / "b"))
    ready = built.scaled(built.base, (7, 2))
    train, rest = ready.filter("role = 'train' AND fold_of[1] <> 2"), ready.filter("role = 'test' OR fold_of[1] = 2")
    want = {r.id: r.prob for r in neighbors.vote(neighbors.knn_join(rest.select("id", "features"), train.select("id", "label", "features"), 5)).collect()}
    got = {r.id: r.prob for r in built.predictions(spark).filter("seed = 7 AND fold = 2").collect()}
    assert got == pytest.approx(want)


def test_jobs_do_not_grow_with_the_splits(spark, tmp_path, monkeypatch):
    passes = []
    real = shared._pass
    monkeypatch.setattr(shared, "_pass", lambda rows, width, jobs, points: passes.append(len(jobs)) or real(rows, width, jobs, points))
    one = {"lr": {"C": 1.0, "max_iter": 12, "balanced": True}}
    bank.run_bank(table(spark), one, seeds=[0], folds=3, path=str(tmp_path / "few"))
    few = len(passes)
    passes.clear()
    bank.run_bank(table(spark), one, seeds=range(10), folds=5, path=str(tmp_path / "many"))
    assert passes[0] == 50 and len(passes) <= few + 6
    passes.clear()
    bank.run_bank(table(spark), one, seeds=range(10), folds=5, path=str(tmp_path / "many"))
    assert not passes  # done and marked
    bank.run_bank(table(spark), {"lr": {**one["lr"], "C": 2.0}}, seeds=range(10), folds=5, path=str(tmp_path / "many"))
    assert passes  # other parameters: not the same fits


def test_odd_rows_are_scored_null_and_change_no_fit(spark, tmp_path):
    odd = [(1000, 1, None, "test"), (1001, 0, [1.0], "test"), (1002, 1, [1.0, float("nan"), 0.0, 0.0], "test"), (1003, None, [0.0] * 4, "test")]
    one = {"lr": {"C": 1.0, "max_iter": 20, "balanced": True}}
    plain = bank.run_bank(table(spark), one, seeds=[0], folds=3, path=str(tmp_path / "a")).predictions(spark)
    mixed = bank.run_bank(table(spark, extra=odd), one, seeds=[0], folds=3, path=str(tmp_path / "b")).predictions(spark)
    probs = {r.id: r.prob for r in mixed.filter("id >= 1000 AND fold = 0").collect()}
    assert [probs[i] for i in (1000, 1001, 1002)] == [None] * 3 and 0 < probs[1003] < 1
    both = plain.alias("p").join(mixed.alias("m"), ["id", "fold", "role"])
    assert both.count() == plain.count() and both.filter(F.abs(F.col("p.prob") - F.col("m.prob")) > 1e-6).count() == 0


def test_search_takes_every_kind_and_scales(spark):
    df = table(spark).drop("role")
    far = df.withColumn("features", F.transform("features", lambda v: v * 1e6))
    grid = {"k": [3, 9], "weights": ["uniform", "distance"], "metric": ["euclidean", "manhattan"]}
    board = stacking.hyperparameter_search(df, "knn", grid, "grid", folds=3).collect()
    again = stacking.hyperparameter_search(far, "knn", grid, "grid", folds=3).collect()
    assert len(board) == 8 and [r.mcc for r in board] == pytest.approx([r.mcc for r in again])
    assert [r.mcc for r in board] == sorted((r.mcc for r in board), reverse=True) and board[0].mcc > 0.5
    machines = stacking.hyperparameter_search(df, "svm", {"C": [0.1, 1.0], "kernel": ["rbf", "linear"], "gamma": ["auto"], "balanced": [True]}, "grid", folds=3)
    assert machines.count() == 4 and machines.first().mcc > 0.5


def test_neighbours_are_a_model(spark, tmp_path):
    df = table(spark).drop("role")
    odd = spark.createDataFrame([(900, None, None), (901, None, [1.0])], "id long, label int, features array<double>")
    fitted = stacking.train_model(df, "knn", {"k": 3, "weights": "distance", "metric": "manhattan"})
    got = {r.id: r.prob for r in fitted.score(df.unionByName(odd)).collect()}
    assert got == {**{r.id: float(r.label) for r in df.collect()}, 900: None, 901: None}  # every row is its own nearest
    fitted.save(str(tmp_path / "model"))
    loaded = estimators.Fitted.load(spark, str(tmp_path / "model"))
    assert {r.id: r.prob for r in loaded.score(df).collect()} == {i: v for i, v in got.items() if i < 900}


def test_ensemble_scores_are_nested(spark):
    """Labels of noise: whoever has seen a row's label with its features would do better than chance."""
    draw = np.random.default_rng(8)
    noise = spark.createDataFrame([(i, int(draw.integers(0, 2)), [float(v) for v in draw.normal(size=3)]) for i in range(240)], "id long, label int, features array<double>")
    models = {"knn": {"k": 1}, "lr": {"C": 1.0, "max_iter": 50, "balanced": True}}
    folds, base, meta = stacking.train_ensemble(noise, models, folds=3, inner=2)
    rows = folds.collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2] and sum(r.tp + r.tn + r.fp + r.fn for r in rows) == 240
    assert abs(np.mean([r.auc for r in rows]) - 0.5) < 0.12
    real, base, meta = stacking.train_ensemble(table(spark).drop("role"), models, folds=3, inner=2)
    assert np.mean([r.auc for r in real.collect()]) > 0.85 and set(base) == set(models)
    scored = base["knn"].score(table(spark).drop("role"))
    assert scored.columns == ["id", "label", "features", "prob"] and scored.filter("prob <> label").count() == 0
    assert meta.score(spark.createDataFrame([(1, [0.0, 0.1]), (2, [1.0, 0.9])], "id long, features array<double>")).orderBy("id").collect()[1].prob > 0.5


def test_rows_are_packed_once_and_a_calibration_maps_nothing(spark, tmp_path, monkeypatch):
    packed, passes = [], []
    real_packed, real_pass = shared._packed, shared._pass
    monkeypatch.setattr(shared, "_packed", lambda *a: packed.append(1) or real_packed(*a))
    monkeypatch.setattr(shared, "_pass", lambda rows, width, jobs, points: passes.append((width, jobs)) or real_pass(rows, width, jobs, points))
    machine = {"svm": {"C": 1.0, "kernel": "rbf", "gamma": "scale", "balanced": True, "n_features": 16, "max_iter": 5}}
    bank.run_bank(table(spark), machine, seeds=[0], folds=3, path=str(tmp_path / "b"), scaler="standard")
    curves = [jobs for width, jobs in passes if width == 3]
    assert len(packed) == 1 and curves and all(not j.kernel and j.column is not None for jobs in curves for j in jobs)
    assert all(j.kernel for width, jobs in passes if width == 4 for j in jobs)


def test_sums_of_tasks_that_meet_in_levels_are_those_added_here(spark, monkeypatch):
    rows = table(spark).withColumn("fold_of", F.array((F.col("id") % 3).cast("int")))
    blocks = shared._packed(rows, 4)
    jobs = [shared.Job("lr", 0, f, np.zeros(4), np.ones(4), (1.0, 2.0), 200.0, 1.0, 10) for f in range(3)]
    points = [np.full(5, 0.01 * (f + 1)) for f in range(3)]
    here = shared._pass(blocks, 4, jobs, points)
    monkeypatch.setattr(shared, "DIRECT", 0)
    levels = shared._pass(blocks, 4, jobs, points)
    assert all(a == pytest.approx(b) for a, b in zip(here, levels, strict=True))
    monkeypatch.setattr(shared, "BLOCK_BYTES", 320)  # ten rows a block
    small = shared._packed(rows, 4)
    assert small.count() >= 24
    assert all(a == pytest.approx(b) for a, b in zip(here, shared._pass(small, 4, jobs, points), strict=True))
