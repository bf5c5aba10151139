"""Packed models against the models they were packed from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackmill.plans import estimators, scoring, stacking

FITS = {
    "lr": estimators.SMALL["lr"], "rf": estimators.SMALL["rf"], "xgboost": estimators.SMALL["xgboost"], "gb": estimators.SMALL["gb"],
    "svm": estimators.SMALL["svm"], "mlp": estimators.SMALL["mlp"], "dnn": {"hidden": (6, 4), "norm": (True, False), "epochs": 3},
}
CASES = {**{k: (k, p) for k, p in FITS.items()}, "poly": ("svm", {"C": 1.0, "kernel": "poly", "n_features": 64, "max_iter": 10}),
         "linear": ("svm", {"C": 1.0, "kernel": "linear", "max_iter": 10})}
DDL = "id long, label int, features array<double>"


def table(n=150, seed=4):
    x = np.random.default_rng(seed).normal(size=(n, 4))
    return [(i, int(r[0] - r[1] * r[2] > 0), r.tolist()) for i, r in enumerate(x)]


@pytest.mark.parametrize("case", CASES)
def test_packed_model_scores_alike(spark, tmp_path, case):
    kind, params = CASES[case]
    df = spark.createDataFrame(table(), DDL)
    fitted = estimators.fit(kind, df, params)
    fitted.save(str(tmp_path / "m"))
    width, predictor = scoring.packed(spark, str(tmp_path / "m"))
    got = {r.id: r.one for r in scoring.mean_probabilities(df, [scoring.Run("one", width, np.zeros(4), np.ones(4), predictor)]).collect()}
    assert width == 4 and got == pytest.approx({r.id: r.prob for r in fitted.score(df).collect()}, abs=1e-9)


def linear(name, k):
    return scoring.Run(name, 2, np.array([k, 0.0]), np.array([1.0, 2.0]), scoring.Linear(np.array([1.0, -1.0]), 0.1 * k))


def test_means_groups_and_odd_rows(spark):
    """Any bound gives the same means; nulls, other widths, repeated ids, other columns and empty tables."""
    rows = [(1, [0.5, 1.0], "g"), (2, None, "g"), (3, [1.0], "g"), (1, [0.5, 1.0], "g"), (None, [2.0, 2.0], None), (4, [None, 1.0], "g")]
    df = spark.createDataFrame(rows, "id long, features array<double>, g0 string")
    runs = [linear("a" if k % 3 else "b", k) for k in range(20)]
    want = []
    for i, x, _ in rows:
        ok = x is not None and len(x) == 2 and None not in x
        p = {n: [1 / (1 + np.exp(-((x[0] - k) - x[1] / 2 + 0.1 * k))) for k in range(20) if (k % 3 > 0) == (n == "a")] for n in "ab"} if ok else {}
        want.append((str(i), *(round(float(np.mean(p[n])), 9) if ok else None for n in "ba")))
    for most in (scoring.MOST_BYTES, 1, 1500):
        found = scoring.mean_probabilities(df, runs, most)
        assert found.columns == ["id", "b", "a"]
        got = [(str(r.id), *(None if v is None or np.isnan(v) else round(v, 9) for v in (r.b, r.a))) for r in found.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert scoring.mean_probabilities(df.limit(0), runs, most).count() == 0
    assert [len(g) for g in scoring.groups_of(runs, 1)] == [1] * 20 and len(scoring.groups_of(runs)) == 1
    assert scoring.mean_probabilities(df, []).columns == ["id"]
    with pytest.raises(ValueError, match="widths"):
        scoring.mean_probabilities(df, [*runs, scoring.Run("c", 3, np.zeros(3), np.ones(3), scoring.Linear(np.zeros(3), 0.0))])


def steps(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("\n")


def test_plan_does_not_grow_with_the_runs(spark):
    df = spark.createDataFrame(table(20), DDL).select("id", F.slice("features", 1, 2).alias("features"))
    few, many = ([linear("a", k) for k in range(n)] for n in (2, 200))
    assert steps(scoring.mean_probabilities(df, few)) == steps(scoring.mean_probabilities(df, many))


def test_predict_equals_the_mean_of_all_runs(spark):
    """Every chosen run scored by itself, on its own scaler and training rows, against the one plan."""
    df = spark.createDataFrame(table(120), DDL)
    ensemble, _ = stacking.train(df, {m: estimators.SMALL[m] for m in ("knn", "lr", "rf")}, seeds=[0, 1], folds=3, max_iter=5)
    new = spark.createDataFrame([(1000 + i, y, x) for i, y, x in table(30, 9)] + [(2000, 0, None), (2001, 0, [1.0])], DDL).select("id", "features")
    got = {r.id: r.features for r in stacking.base_probabilities(ensemble, new).collect()}
    assert len(got) == 32 and got[2000] == got[2001] == [None, None, None]
    bank = ensemble.bank
    base = [(r.id, r.label, r.features, r.fold_of) for r in bank.base.filter("role = 'train'").collect()]
    plain = new.filter("id < 2000")
    want = {r.id: [0.0, 0.0, 0.0] for r in plain.collect()}
    for m, name in enumerate(ensemble.models):
        for seed, fold in ensemble.chosen[name]:
            s = bank.stats[seed, fold]
            mean, std = np.array(s["mean"]), np.array(s["std"])
            if name == "knn":
                inside = [(i, y, (np.array(x) - mean) / std) for i, y, x, f in base if f[[0, 1].index(seed)] != fold]
                one = {}
                for r in plain.collect():
                    q = (np.array(r.features) - mean) / std
                    near = sorted((float(np.sqrt(((q - x) ** 2).sum())), i, y) for i, y, x in inside)[: estimators.SMALL["knn"]["k"]]
                    one[r.id] = float(np.mean([y for _, _, y in near]))
            else:
                fitted = estimators.Fitted.load(spark, bank.model_path(name, (seed, fold)))
                one = {r.id: r.prob for r in fitted.score(bank.scaled(plain, (seed, fold))).collect()}
            for i, p in one.items():
                want[i][m] += p / len(ensemble.chosen[name])
    for i, p in want.items():
        assert got[i] == pytest.approx(p, abs=1e-9)
