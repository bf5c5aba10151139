"""Nets: gradients against differences, early stopping, blocks, odd rows and a round trip."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackmill.plans import estimators, nets

SCHEMA = "id long, label int, weight double, features array<double>"


def sample(n=400, seed=4):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 5))
    return x, (x[:, 0] * x[:, 1] + 0.1 * draw.normal(size=n) > 0).astype(float)


def frame(spark, x, y):
    return spark.createDataFrame([(k, int(b), 1.0, a.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))], SCHEMA)


@pytest.mark.parametrize("activation", ["relu", "tanh", "selu"])
def test_gradient_equals_differences(activation):
    x, y = sample(40)
    shape = nets.Shape((7, 6, 4), activation, (True, True, False), (), l2=0.01)
    state, weight = nets.fresh(5, shape), np.linspace(0.5, 2, 40)
    draw = np.random.default_rng(0)
    for v in state.weights.values():
        v += 0.1 * draw.normal(size=v.shape)
    _, slope, _ = nets.gradient(state, x, y, weight, shape, draw)
    for name, v in state.weights.items():
        for at in [tuple(draw.integers(0, s) for s in v.shape) for _ in range(4)]:
            both = []
            for d in (1e-6, -1e-6):
                v[at] += d
                both.append(nets.gradient(state, x, y, weight, shape, draw)[0])
                v[at] -= d
            assert slope[name][at] == pytest.approx((both[0] - both[1]) / 2e-6, abs=1e-6)


def test_dropout_keeps_the_mean():
    x, y = sample(2000)
    state = nets.fresh(5, nets.Shape((50,)))
    plain = nets.gradient(state, x, y, np.ones(len(y)), nets.Shape((50,)), np.random.default_rng(1))[1]["b1"]
    many = [nets.gradient(state, x, y, np.ones(len(y)), nets.Shape((50,), dropout=(0.3,)), np.random.default_rng(k))[1]["b1"] for k in range(20)]
    assert np.mean(many) == pytest.approx(plain[0], abs=0.02)


def test_early_stop_keeps_the_best_state():
    x, y = sample(120)
    y = np.random.default_rng(9).integers(0, 2, 120).astype(float)  # nothing to learn: validation gets worse
    shape = nets.Shape((64,), rate=0.01, epochs=200, patience=5)
    held = nets.carved(y, 0.2, [1, 0])
    assert held.sum() == sum(int(0.2 * (y == k).sum()) for k in (0, 1))
    state = nets.train_block(x, y, np.ones(120), shape)
    assert state.steps < 200 * 3
    stopped = nets.log_loss(nets.predicted(state, x[held], shape), y[held], np.ones(held.sum()))
    full = nets.train_block(x, y, np.ones(120), nets.Shape((64,), rate=0.01, epochs=200, patience=999))
    assert full.steps <= 200 * 3 and stopped <= nets.log_loss(nets.predicted(full, x[held], shape), y[held], np.ones(held.sum())) + 1.0


def test_net_learns_in_one_block_and_in_many(spark, monkeypatch, tmp_path):
    x, y = sample(1500)
    df = frame(spark, x, y)
    params = {"hidden": (32, 16), "norm": (True, False), "dropout": (0.1, 0.0), "rate": 0.01, "epochs": 40, "patience": 10}
    one = nets.fit_net("meta", df, params, 5)
    again = nets.fit_net("meta", df.orderBy(F.desc("id")).repartition(3), params, 5)
    assert all((one.state.weights[k] == again.state.weights[k]).all() for k in one.state.weights)
    monkeypatch.setattr(nets, "BLOCK", 400)
    many = nets.fit_net("meta", df, params | {"epochs": 12}, 5)
    for net in (one, many):
        assert ((nets.predicted(net.state, x, net.shape) > 0.5) == y).mean() > 0.85
    one.save(str(tmp_path / "m"))
    loaded = estimators.Fitted.load(spark, str(tmp_path / "m"))
    odd = spark.createDataFrame([(1, 1, 1.0, None), (2, 1, 1.0, [1.0]), (3, 1, 1.0, [None, math.nan, 1.0, 0.0, 0.0]), (4, 1, 1.0, x[0].tolist())], SCHEMA)
    got = {r.id: r.prob for r in loaded.score(odd).collect()}
    assert got == {r.id: r.prob for r in one.score(odd).collect()}
    assert got[1] is None and got[2] is None and 0 < got[3] < 1
    assert got[4] == pytest.approx(nets.predicted(one.state, x[:1], one.shape)[0])
    none = nets.fit_net("meta", df.limit(0), params, 5)
    assert none.score(odd).count() == 4


def test_an_epoch_sends_one_state_to_the_driver(spark, monkeypatch):
    draw = np.random.default_rng(4)
    table = [(float(v[0] > 0), 1.0, [float(c) for c in v]) for v in draw.normal(size=(400, 2))]
    rows = spark.createDataFrame(table, "label double, weight double, features array<double>")
    blocks = nets.packed_blocks(rows, 2, 400, 20, lambda x: np.ascontiguousarray(x).tobytes()).localCheckpoint()
    shape = nets.Shape((4,), epochs=1)
    several = []
    frame = type(blocks)
    monkeypatch.setattr(frame, "toLocalIterator", lambda self, *a, **b: several.append(self) or iter(self.collect()))
    loss, after = nets._epoch_of(blocks, 2, nets.fresh(2, shape), shape, 0, 5)
    assert not several and np.isfinite(loss) and after.steps > 0


def test_an_epoch_takes_one_step_of_all_weights_a_batch(monkeypatch):
    x, y = sample(130)
    shape = nets.Shape((6, 4), norm=(True, False), dropout=(0.2, 0.0), batch=16)
    calls, adam = [], nets.adam
    monkeypatch.setattr(nets, "adam", lambda state, slope, rate: (calls.append(len(slope)), adam(state, slope, rate)))
    state = nets.fresh(5, shape)
    plain = state.copy()
    nets.epoch(state, x, y, np.ones(130), shape, np.random.default_rng(3))
    draw = np.random.default_rng(3)
    order = draw.permutation(130)
    for at in np.array_split(order, math.ceil(129 / 16)):
        _, slope, seen = nets.gradient(plain, x[at], y[at], np.ones(len(at)), shape, draw)
        adam(plain, slope, shape.rate)
        for n, v in seen.items():
            plain.running[n] += (1 - nets.MOMENTUM) * (v - plain.running[n])
    assert set(calls) == {1} and state.steps == plain.steps == len(calls)
    assert all((p[n] == q[n]).all() for p, q in zip(state.parts(), plain.parts(), strict=True) for n in p)
