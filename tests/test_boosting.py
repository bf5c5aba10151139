"""Boosting against a plain version that tries every cut of every node, and blocks against one block."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackmill.plans import boosting, estimators

SCHEMA = "id long, label int, weight double, features array<double>"


def sample(n=500, seed=4):
    draw = np.random.default_rng(seed)
    x = np.clip(np.round(draw.normal(size=(n, 4)), 1), -1.5, 1.5)  # few values, so that every one is an edge
    x[:, 3] = 2.5  # constant
    y = (x[:, 0] * x[:, 1] + 0.3 * draw.normal(size=n) > 0).astype(int)
    return x, y


def frame(spark, x, y, weight=1.0):
    return spark.createDataFrame([(k, int(b), float(weight if b else 1.0), a.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))], SCHEMA)


def plain(x, y, w, trees, depth, step, ridge=1.0, least=1.0, newton=True, start=0.0):
    margin = np.full(len(x), start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)

        def node(at, left_depth):
            value = -step * g[at].sum() / (h[at].sum() + ridge)
            best = (1e-6, None)
            weight = h if newton else np.ones(len(x))

            def worth(k):
                return g[k].sum() ** 2 / (weight[k].sum() + ridge)

            if left_depth:
                for f in range(x.shape[1]):
                    for cut in np.unique(x[at, f])[:-1]:
                        a, b = at[x[at, f] <= cut], at[x[at, f] > cut]
                        if not newton or min(h[a].sum(), h[b].sum()) >= least:
                            gain = worth(a) + worth(b) - worth(at)
                            if gain > best[0] + 1e-9:
                                best = (gain, (a, b))
            if best[1] is None:
                margin_step[at] = value
            else:
                node(best[1][0], left_depth - 1)
                node(best[1][1], left_depth - 1)

        margin_step = np.zeros(len(x))
        node(np.arange(len(x)), depth)
        margin = margin + margin_step
    return 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("newton", [True, False])
def test_boosting_equals_plain(spark, newton):
    x, y = sample()
    w = np.where(y == 1, 0.66, 1.0)
    params = {"trees": 6, "depth": 4, "step": 0.3, "newton": newton, "ridge": 1.0 if newton else 0.0, "prior": not newton}
    df = frame(spark, x, y, 0.66)
    model = boosting.fit_boosted("xgboost", df, params, 4)
    start = 0.0 if newton else math.log((w * y).sum() / (w * (1 - y)).sum())
    want = plain(x, y, w, 6, 4, 0.3, params["ridge"], newton=newton, start=start)
    got = np.array([r.prob for r in model.score(df).orderBy("id").collect()])
    assert np.abs(got - want).max() < 1e-5


def test_blocks_equal_one_block(spark, monkeypatch):
    x, y = sample(400, 7)
    x[:150] = x[0]  # copies of one row
    df = frame(spark, x, y)
    params = {"trees": 4, "depth": 5, "step": 0.3}
    one = boosting.fit_boosted("xgboost", df, params, 4)
    monkeypatch.setattr(boosting, "BLOCK", 90)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    many = boosting.fit_boosted("xgboost", df.repartition(3), params, 4)
    assert one.margins(x) == pytest.approx(many.margins(x), abs=1e-6)
    assert len(many.feature) == len(one.feature) > 20


def test_bins_of_wide_values(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(3000, 2)) ** 3
    df = frame(spark, x, (x[:, 0] > 0.2).astype(int))
    edges = boosting.bin_edges(df)
    assert [len(e) for e in edges] == [255, 255]
    counts = np.bincount(boosting.binned(x, edges)[:, 0], minlength=256)
    assert counts.max() < 40
    model = boosting.fit_boosted("xgboost", df, {"trees": 5, "depth": 2, "step": 0.5, "subsample": 0.7}, 2)
    right = model.score(df).where(F.expr("(prob > 0.5) = (label = 1)")).count()
    assert right > 2950


def test_order_of_rows_does_not_matter(spark):
    x, y = sample()
    df, params = frame(spark, x, y), {"trees": 5, "depth": 4, "step": 0.5, "subsample": 0.7}
    one = boosting.fit_boosted("xgboost", df, params, 4)
    two = boosting.fit_boosted("xgboost", df.orderBy(F.desc("id")).repartition(3), params, 4)
    assert (one.margins(x) == two.margins(x)).all()


def test_odd_rows(spark, tmp_path):
    x, y = sample(120, 2)
    rows = [(k, int(b), 1.0, a.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    odd = [(900, 1, 1.0, None), (901, 1, 1.0, [1.0]), (902, None, 1.0, [1.0] * 4), (903, 1, 1.0, [None, math.nan, math.inf, 0.0])]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    params = {"trees": 3, "depth": 3, "step": 0.3}
    model = boosting.fit_boosted("xgboost", df, params, 4)
    got = {r.id: r.prob for r in model.score(df).collect()}
    assert got[900] is None and got[901] is None and all(0 < got[k] < 1 for k in (902, 903, 5))
    model.save(str(tmp_path / "m"))
    again = estimators.Fitted.load(spark, str(tmp_path / "m"))
    assert {r.id: r.prob for r in again.score(df).collect()} == got
    none = boosting.fit_boosted("xgboost", df.limit(0), params, 4)
    assert {r.prob for r in none.score(df).where("id < 900").collect()} == {0.5}
    alike = boosting.fit_boosted("gb", df.where("label = 1"), params, 4)
    assert all(r.prob > 0.5 for r in alike.score(df).where("id < 900").collect())
