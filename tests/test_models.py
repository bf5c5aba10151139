"""Fits, banks and end-to-end plans."""

import shutil

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from stackmill.catalog.inputs import labelled
from stackmill.functions import arrays, kernels
from stackmill.operators import metrics, splits
from stackmill.plans import bank, estimators, stacking
from stackmill.session import scratch_path, stored


@pytest.fixture(scope="module")
def rows(spark, data):
    return stored(labelled(spark, data), "rows")


def separable(spark, n=200, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 3))
    y = (x[:, 0] + 0.3 * draw.normal(size=n) > 0).astype(int)
    table = [(i, int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(table, "id long, label int, features array<double>"), x, y


def test_logistic_regression_minimises_the_stated_objective(spark):
    df, x, y = separable(spark)
    C = 0.1
    model = estimators.fit("lr", df, {"C": C, "max_iter": 200, "balanced": True}).model.stages[-1]
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w = np.zeros(4)
    xb = np.c_[x, np.ones(len(x))]
    ridge = np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-xb @ w))
        gradient = C * xb.T @ (weight * (p - y)) + ridge @ w
        hessian = C * (xb * (weight * p * (1 - p))[:, None]).T @ xb + ridge
        w -= np.linalg.solve(hessian, gradient)
    assert list(model.coefficients) == pytest.approx(list(w[:3]), abs=1e-4)
    assert model.intercept == pytest.approx(w[3], abs=1e-4)


def test_random_features_approximate_the_kernel(spark):
    x = np.random.default_rng(0).normal(size=(6, 4))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "features array<double>").coalesce(1)
    z = np.array([r[0] for r in df.select(estimators.random_features(F.col("features"), 4, 4000, 0.2, 7)).collect()])
    gap = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-0.2 * gap)).max() < 0.1


def test_tensor_sketch_approximates_the_kernel(spark):
    x = np.random.default_rng(3).normal(size=(12, 30)) / np.sqrt(30)
    df = spark.createDataFrame([([float(v) for v in r],) for r in x] + [(None,), ([1.0],)], "features array<double>").coalesce(1)
    for offset in (0.0, 1.0):
        got = [r[0] for r in df.select(kernels.tensor_sketch(F.col("features"), 30, 8192, 0.7, 5, offset)).collect()]
        assert got[12] is None and got[13] is None
        z, exact = np.array(got[:12]), (0.7 * x @ x.T + offset) ** 3
        scale = np.sqrt(np.outer(np.diag(exact), np.diag(exact)))
        assert (np.abs(z @ z.T - exact) / scale).max() < 0.1


@pytest.mark.parametrize("kind", ["lr", "rf", "xgboost", "gb", "svm", "mlp"])
def test_fits_learn(spark, kind):
    df, _, _ = separable(spark)
    fitted = estimators.fit(kind, df, estimators.SMALL[kind])
    scored = fitted.score(df).select(F.col("label").alias("y_true"), "prob")
    assert scored.filter("prob < 0 or prob > 1").count() == 0
    assert metrics.auc(scored).first()["auc"] > 0.9


@pytest.mark.parametrize("kind", ["lr", "rf", "svm", "mlp"])
def test_fits_score_in_a_session_that_has_observed_a_query(spark, kind):
    seen = Observation()
    assert spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).count() == 5 and seen.get["n"] == 5
    df, _, _ = separable(spark, 60)
    scored = estimators.fit(kind, df, estimators.SMALL[kind]).score(df)
    assert scored.where("prob BETWEEN 0 AND 1").count() == 60


def test_polynomial_kernel_learns_a_product(spark):
    x = np.random.default_rng(2).normal(size=(300, 2))
    table = [(i, int(r[0] * r[1] > 0), [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(table, "id long, label int, features array<double>")
    params = {"C": 10.0, "kernel": "poly", "balanced": True, "max_iter": 50}
    scored = estimators.fit("svm", df, params).score(df).select(F.col("label").alias("y_true"), "prob")
    assert metrics.auc(scored).first()["auc"] > 0.95


def test_model_round_trip_with_random_features(spark, tmp_path):
    df, _, _ = separable(spark)
    fitted = estimators.fit("svm", df, estimators.SMALL["svm"])
    fitted.save(str(tmp_path / "m"))
    again = estimators.Fitted.load(spark, str(tmp_path / "m"))
    both = again.score(fitted.score(df, "a"), "b")
    assert both.filter(F.abs(F.col("a") - F.col("b")) > 1e-12).count() == 0


def test_bank_covers_every_split_and_restarts(spark, rows, tmp_path):
    marks = splits.stratified_holdout(rows.select("id", "label"), "id", "label")
    roles = marks.select("id", F.when(F.col("is_holdout") == 1, "test").otherwise("train").alias("role"))
    table = rows.join(roles, "id")
    models = {m: estimators.SMALL[m] for m in ("knn", "lr")}
    path = str(tmp_path / "bank")
    built = bank.run_bank(table, models, seeds=[0, 1], folds=3, path=path)
    pred = built.predictions(spark)
    n_train, n_test = (roles.filter(F.col("role") == r).count() for r in ("train", "test"))
    per = {(r["model"], r["seed"], r["role"]): r["count"] for r in pred.groupBy("model", "seed", "role").count().collect()}
    for m in models:
        for s in (0, 1):
            assert per[m, s, "fold_val"] == n_train and per[m, s, "test"] == 3 * n_test
    assert pred.filter("prob is null or prob < 0 or prob > 1").count() == 0
    before = sorted(map(tuple, pred.select("id", "model", "seed", "fold", "role", "prob").collect()))
    again = bank.run_bank(table, models, seeds=[0, 1], folds=3, path=path).predictions(spark)
    assert sorted(map(tuple, again.select("id", "model", "seed", "fold", "role", "prob").collect())) == before


def test_scaled_variance_matches_the_rows(spark, rows):
    built = bank.with_folds(rows.withColumn("role", F.lit("train")), [0], 3)
    stats, counts = bank.split_stats(built, [0])
    size = bank._size(stats[0, 1], counts[0, 1], "minmax")
    train = built.filter(F.get("fold_of", F.lit(0)) != 1)
    direct = estimators.train_size(train.withColumn("features", bank.scaled_features(stats[0, 1], "minmax")))
    assert (size.width, size.negatives, size.positives) == (direct.width, direct.negatives, direct.positives)
    assert size.variance == pytest.approx(direct.variance)


def test_lexical_descriptors_predict_quality(spark, data):
    rows = stored(labelled(spark, data.replace("sf0.001", "sf0.01")), "rows")
    folds = stacking.cross_validate(rows, {"rf": estimators.SMALL["rf"]}, folds=3, repeats=1)
    assert folds.agg(F.avg("auc")).first()[0] > 0.75


def test_train_save_load_predict(spark, rows, tmp_path):
    models = {m: estimators.SMALL[m] for m in ("knn", "lr", "rf")}
    ensemble, report = stacking.train(rows, models, seeds=[0], folds=3, max_iter=30)
    assert {r["model"] for r in report.collect()} == {"knn", "lr", "rf", "stack"}
    assert all(len(runs) == 2 for runs in ensemble.chosen.values())
    path = stacking.save(ensemble, str(tmp_path / "bundle"), ["a"])
    new = rows.select("id", "features")
    first = sorted(map(tuple, stacking.predict(ensemble, new).collect()))
    second = sorted(map(tuple, stacking.predict(stacking.load(spark, path), new).collect()))
    assert len(first) == rows.count() and [r[0] for r in first] == [r[0] for r in second]
    assert [r[1] for r in first] == pytest.approx([r[1] for r in second])


def test_search_orders_by_mcc(spark, rows):
    board = stacking.hyperparameter_search(rows, "logistic_regression", {"C": [0.01, 1.0], "balanced": [True], "max_iter": [20]}, "grid", folds=3)
    values = [r["mcc"] for r in board.collect()]
    assert len(values) == 2 and values == sorted(values, reverse=True)


def test_grid_points_and_defaults():
    assert stacking.default_params("random_forest") == {"trees": 100, "depth": 5, "split": 2, "balanced": True}
    points = stacking.grid_points("xgboost", stacking.GRID["xgboost"], "random", 20)
    assert len(points) == 20 and len({tuple(p.items()) for p in points}) == 20
    assert len(stacking.grid_points("knn", stacking.GRID["knn"], "random", 20)) == 16


def test_unknown_model_is_refused(spark, rows):
    with pytest.raises(ValueError, match="unknown model type"):
        stacking.train_model(rows, "oracle")


def test_literal_scaler_equals_joined_scaler(spark):
    df, x, _ = separable(spark, 30)
    low, high = x.min(0), x.max(0)
    got = df.select(arrays.minmax(F.col("features"), arrays.literal(low), arrays.literal(high)).alias("f")).collect()
    assert np.array([r[0] for r in got]) == pytest.approx((x - low) / (high - low))


@pytest.mark.parametrize(("name", "kind"), [("validate_external", "lr"), ("model_roundtrip", "rf")])
def test_queries_fit_the_full_profile(monkeypatch, spark, rows, name, kind):
    from stackmill.catalog import model_queries

    used = []

    def fit(kind, train, params):
        used.append((kind, params))
        raise InterruptedError

    monkeypatch.setattr(model_queries, "_halves", lambda spark, folder: (rows, rows.withColumn("is_holdout", F.lit(1))))
    monkeypatch.setattr(estimators, "fit", fit)
    with pytest.raises(InterruptedError):
        getattr(model_queries, name)(spark, "")
    assert used == [(kind, estimators.PROFILES["numeric"][kind])]


def test_bundle_stands_alone(spark, rows, tmp_path):
    models = {m: estimators.SMALL[m] for m in ("knn", "lr", "xgboost")}
    ensemble, _ = stacking.train(rows, models, seeds=[0], folds=3, max_iter=5)
    path = stacking.save(ensemble, str(tmp_path / "bundle"), ["a"])
    copy = str(tmp_path / "elsewhere")
    shutil.copytree(path, copy)
    loaded = stacking.load(spark, copy)
    assert loaded.bank.path.startswith(copy) and loaded.chosen == ensemble.chosen
    new = rows.select("id", "features").limit(40)
    first = {r.id: r.prob for r in stacking.predict(ensemble, new).collect()}
    assert {r.id: r.prob for r in stacking.predict(loaded, new).collect()} == pytest.approx(first)
    for p in (tmp_path / "bundle").rglob("*"):
        assert p.is_dir() or ensemble.bank.path.rsplit("/", 1)[-1].encode() not in p.read_bytes()
    extra = tmp_path / "elsewhere" / "base" / "models" / "extra"
    extra.mkdir()
    (extra / "part-0").write_bytes(b"x")
    with pytest.raises(ValueError, match="part-0"):
        stacking.load(spark, copy)


def test_kernel_maps_pass_rows_in_pieces(spark, monkeypatch):
    made = kernels.fourier_map(2, 8, 0.5, 3)

    def narrow():
        def apply(x):
            assert len(x) <= 512, "a whole batch at once"
            return made(x)

        return apply

    rows = spark.range(2000).select("id", F.array(F.col("id") / 1000.0, F.lit(1.0)).alias("x")).coalesce(1)
    mapped = rows.select("id", kernels._mapped(F.col("x"), 2, narrow).alias("z")).collect()
    plain = made(np.array([[i / 1000.0, 1.0] for i in range(2000)]))
    assert [r["id"] for r in mapped] == list(range(2000)) and np.allclose([r["z"] for r in mapped], plain)


def test_cosine_features_are_those_of_numpy():
    x = np.random.default_rng(2).normal(size=(300, 6)) * 40
    draw = np.random.default_rng(7)
    w, b = draw.normal(scale=np.sqrt(0.6), size=(6, 50)), draw.uniform(0.0, 2.0 * np.pi, size=50)
    x[3, 2] = np.nan
    got = kernels.fourier_map(6, 50, 0.3, 7)(x)
    assert np.allclose(got, np.sqrt(2.0 / 50) * np.cos(x @ w + b), rtol=0, atol=1e-12, equal_nan=True)
    turns, square, out = np.linspace(-3, 3, 4001), np.empty(4001), np.empty(4001)
    kernels._cosine(turns.copy(), square, out)
    assert np.abs(out - np.cos(2 * np.pi * turns)).max() < 1e-14


def test_base_bank_fits_five_kinds_on_all_splits_with_full_parameters(monkeypatch):
    """forests and boosting ran on one repeat of five, with 10 and 8 small trees."""
    import inspect

    from stackmill.catalog import model_queries

    plain, calls = inspect.signature(bank.run_bank), []

    class Asked(Exception):
        pass

    def run_bank(*given, **named):
        call = plain.bind(*given, **named)
        call.apply_defaults()
        calls.append(call.arguments)
        raise Asked

    monkeypatch.setattr(model_queries.B, "run_bank", run_bank)
    monkeypatch.setattr(model_queries, "_roles", lambda spark, folder: None)
    with pytest.raises(Asked):
        model_queries.base_bank(None, "")
    (call,) = calls
    assert call["models"] == estimators.PROFILES["numeric"] and set(call["models"]) == {"knn", "lr", "svm", "rf", "xgboost"}
    assert list(call["seeds"]) == list(range(20)) and call["folds"] == 5


def test_fitted_models_keep_no_summary(spark, rows):
    """A forest of 700 trees took 3 s to be stored and read back, only to lose its summary."""
    vectors = estimators.Fitted("rf", None, 0).vector(rows.select(F.col("label").cast("double").alias("label"), F.lit(1.0).alias("weight"), "features"))
    for kind in ("rf", "lr", "svm"):
        model = estimators.stages(kind, estimators.SMALL[kind], 4, 100.0)[0].setFeaturesCol("__x").fit(vectors)
        path = scratch_path(spark, "with-summary")
        model.write().overwrite().save(path)
        bare = estimators._without_summary(model, spark)
        assert bare is model and not bare.hasSummary
        got, stored_model = ([r[0] for r in m.transform(vectors).select(m.getRawPredictionCol()).collect()] for m in (bare, type(bare).load(path)))
        assert got == stored_model
