"""Nets for a binary label with batch normalisation, dropout, Adam and early stopping on a carved part of the rows.

Rows lie in blocks of one stored table. In an epoch every task takes Adam steps on the minibatches of its blocks, from the same
state, and the states are averaged by rows, in two levels of bounded fan-in; the driver holds one state. A table that is one
block trains all epochs in one task, step by step as written.
"""

from __future__ import annotations

import pickle
from collections.abc import Mapping
from dataclasses import dataclass, field
from math import ceil, isqrt
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.plans.boosting import packed_blocks
from stackmill.session import stored

#: Rows of a block; momentum and floor of the running normalisation; constants of Adam.
BLOCK = 1 << 15
MOMENTUM, FLOOR = 0.99, 1e-3
BETA1, BETA2, TINY = 0.9, 0.999, 1e-7


@dataclass(frozen=True)
class Shape:
    """``norm`` and ``dropout`` per hidden layer (behind the activation); ``l2`` on the first layer's weights. ``validation`` is
    the share of rows that only tells when to stop: after ``patience`` epochs without a lower loss, the best state stays."""

    hidden: tuple[int, ...]
    activation: str = "relu"
    norm: tuple[bool, ...] = ()
    dropout: tuple[float, ...] = ()
    l2: float = 0.0
    rate: float = 1e-3
    epochs: int = 200
    batch: int = 32
    patience: int = 20
    validation: float = 0.2
    seed: int = 1


@dataclass
class State:
    """Weights by name, running means and variances, and Adam's moments."""

    weights: dict[str, np.ndarray]
    running: dict[str, np.ndarray]
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)
    steps: int = 0

    def parts(self) -> list[dict[str, np.ndarray]]:
        return [self.weights, self.running, self.first, self.second]

    def copy(self) -> State:
        return State(*({k: v.copy() for k, v in p.items()} for p in self.parts()), self.steps)


def fresh(width: int, shape: Shape) -> State:
    """Random weights with a variance that keeps the scale of the activations."""
    draw, weights, running, last = np.random.default_rng(shape.seed), {}, {}, width
    for k, units in enumerate([*shape.hidden, 1]):
        weights[f"w{k}"] = draw.normal(0, np.sqrt(2.0 / max(last, 1)), (last, units))
        weights[f"b{k}"] = np.zeros(units)
        if k < len(shape.hidden) and shape.norm and shape.norm[k]:
            weights[f"g{k}"], weights[f"s{k}"] = np.ones(units), np.zeros(units)
            running[f"m{k}"], running[f"v{k}"] = np.zeros(units), np.ones(units)
        last = units
    moments = [{n: np.zeros_like(v) for n, v in weights.items()} for _ in range(2)]
    return State(weights, running, *moments)


def _active(z: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Activation and its derivative."""
    if kind == "tanh":
        a = np.tanh(z)
        return a, 1 - a * a
    if kind == "selu":  # fixed values: the constants of the self-normalising unit
        scale, alpha = 1.0507009873554805, 1.6732632423543772
        low = scale * alpha * np.exp(np.minimum(z, 0))
        return np.where(z > 0, scale * z, low - scale * alpha), np.where(z > 0, scale, low)
    return np.maximum(z, 0), (z > 0).astype(float)


def predicted(state: State, x: np.ndarray, shape: Shape) -> np.ndarray:
    """Probabilities, with the running normalisation and without dropout."""
    w, r = state.weights, state.running
    for k in range(len(shape.hidden)):
        x = _active(x @ w[f"w{k}"] + w[f"b{k}"], shape.activation)[0]
        if f"g{k}" in w:
            x = (x - r[f"m{k}"]) / np.sqrt(r[f"v{k}"] + FLOOR) * w[f"g{k}"] + w[f"s{k}"]
    k = len(shape.hidden)
    return 1 / (1 + np.exp(-np.clip(x @ w[f"w{k}"] + w[f"b{k}"], -40, 40)[:, 0]))


def log_loss(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Sum of the weighted losses."""
    q = np.clip(np.where(y == 1, p, 1 - p), 1e-12, 1)
    return float(-(weight * np.log(q)).sum())


def gradient(state: State, x: np.ndarray, y: np.ndarray, weight: np.ndarray, shape: Shape, draw: np.random.Generator) -> tuple[float, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Loss per row of a minibatch, its gradient, and the means and variances the batch was normalised with."""
    w, kept, seen = state.weights, [], {}
    for k in range(len(shape.hidden)):
        a, slope = _active(x @ w[f"w{k}"] + w[f"b{k}"], shape.activation)
        centred = spread = None
        out = a
        if f"g{k}" in w:
            mean, var = a.mean(0), a.var(0)
            seen[f"m{k}"], seen[f"v{k}"] = mean, var
            spread = np.sqrt(var + FLOOR)
            centred = (a - mean) / spread
            out = centred * w[f"g{k}"] + w[f"s{k}"]
        rate = shape.dropout[k] if shape.dropout else 0.0
        mask = (draw.random(out.shape) >= rate) / (1 - rate) if rate else None
        kept.append((x, slope, centred, spread, mask))
        x = out * mask if mask is not None else out
    k = len(shape.hidden)
    p = 1 / (1 + np.exp(-np.clip(x @ w[f"w{k}"] + w[f"b{k}"], -40, 40)[:, 0]))
    loss = log_loss(p, y, weight) / len(y) + shape.l2 * float((w["w0"] ** 2).sum())
    back = (weight * (p - y) / len(y))[:, None]
    out = {f"w{k}": x.T @ back, f"b{k}": back.sum(0)}
    back = back @ w[f"w{k}"].T
    for k in range(len(shape.hidden) - 1, -1, -1):
        x, slope, centred, spread, mask = kept[k]
        if mask is not None:
            back = back * mask
        if centred is not None:
            out[f"g{k}"], out[f"s{k}"] = (back * centred).sum(0), back.sum(0)
            back = back * w[f"g{k}"]
            back = (back - back.mean(0) - centred * (back * centred).mean(0)) / spread
        back = back * slope
        out[f"w{k}"], out[f"b{k}"] = x.T @ back, back.sum(0)
        back = back @ w[f"w{k}"].T
    out["w0"] = out["w0"] + 2 * shape.l2 * w["w0"]
    return loss, out, seen


def adam(state: State, slope: Mapping[str, np.ndarray], rate: float) -> None:
    """One step of all weights that have a slope."""
    state.steps += 1
    step = rate * np.sqrt(1 - BETA2**state.steps) / (1 - BETA1**state.steps)
    for n, g in slope.items():
        m, v = state.first[n], state.second[n]
        m += (1 - BETA1) * (g - m)
        v += (1 - BETA2) * (g * g - v)
        state.weights[n] -= step * m / (np.sqrt(v) + TINY)


def joined_up(state: State) -> State:
    """The weights and their moments as one vector each (named ``all``); the arrays of ``state`` become views of them, so that a
    step is a few operations, however many layers."""
    out = State({}, state.running, steps=state.steps)
    for part, into in ((state.weights, out.weights), (state.first, out.first), (state.second, out.second)):
        into["all"] = np.concatenate([part[n].ravel() for n in state.weights])
        at = 0
        for n in state.weights:
            part[n], at = into["all"][at : at + part[n].size].reshape(part[n].shape), at + part[n].size
    return out


def epoch(state: State, x: np.ndarray, y: np.ndarray, weight: np.ndarray, shape: Shape, draw: np.random.Generator) -> None:
    """One pass over the rows in random minibatches; a rest of one row joins the batch before it."""
    order = draw.permutation(len(x))
    batches = max(1, ceil((len(x) - 1) / shape.batch)) if len(x) else 0
    whole = joined_up(state)
    for at in np.array_split(order, batches) if batches else []:
        _, slope, seen = gradient(state, x[at], y[at], weight[at], shape, draw)
        adam(whole, {"all": np.concatenate([slope[n].ravel() for n in state.weights])}, shape.rate)
        for n, v in seen.items():
            state.running[n] += (1 - MOMENTUM) * (v - state.running[n])
    state.steps = whole.steps


def carved(y: np.ndarray, share: float, seed: list[int]) -> np.ndarray:
    """True for the rows that validate: the share of each label, at random."""
    out = np.zeros(len(y), bool)
    draw = np.random.default_rng(seed)
    for label in np.unique(y):
        at = draw.permutation(np.flatnonzero(y == label))
        out[at[: int(share * len(at))]] = True
    return out


class Stopper:
    """Keeps the best state; tells when ``patience`` epochs in a row were not better."""

    def __init__(self, patience: int):
        self.patience, self.best, self.loss, self.bad = patience, None, np.inf, 0

    def done(self, state: State, loss: float) -> bool:
        if loss < self.loss:
            self.best, self.loss, self.bad = state.copy(), loss, 0
        else:
            self.bad += 1
        return self.bad >= self.patience


def train_block(x: np.ndarray, y: np.ndarray, weight: np.ndarray, shape: Shape, block: int = 0) -> State:
    """All epochs over the rows of one block. Without validating rows all epochs run and the last state stays."""
    state, stop = fresh(x.shape[1], shape), Stopper(shape.patience)
    held = carved(y, shape.validation, [shape.seed, block])
    for k in range(shape.epochs):
        epoch(state, x[~held], y[~held], weight[~held], shape, np.random.default_rng([shape.seed, k, block]))
        if held.any() and stop.done(state, log_loss(predicted(state, x[held], shape), y[held], weight[held]) / weight[held].sum()):
            break
    return stop.best or state


def _blocks_of(batches, width: int):
    for b in batches:
        for r in b.to_pylist():
            yield r["block"], np.frombuffer(r["bins"], float).reshape(-1, width), np.frombuffer(r["label"], float), np.frombuffer(r["weight"], float)


def _sum(states: list[tuple[float, float, float, State]]) -> tuple[float, float, float, State]:
    """(rows, validation loss, validation weight, state weighted by rows) of several."""
    rows = sum(s[0] for s in states)
    parts = [{n: sum(s[0] / rows * p[n] for s, p in zip(states, ps, strict=True)) if rows else ps[0][n] for n in ps[0]} for ps in zip(*(s[3].parts() for s in states), strict=True)]
    return rows, sum(s[1] for s in states), sum(s[2] for s in states), State(*parts, max(s[3].steps for s in states))


def _epoch_of(blocks: DataFrame, width: int, state: State, shape: Shape, k: int, groups: int) -> tuple[float, State]:
    """The validation loss of ``state``, and the averaged state after one epoch from it."""

    def run(batches):
        mine, rows, loss, weights = state.copy(), 0, 0.0, 0.0
        for block, x, y, w in _blocks_of(batches, width):
            held = carved(y, shape.validation, [shape.seed, block])
            if held.any():
                loss += log_loss(predicted(state, x[held], shape), y[held], w[held])
                weights += w[held].sum()
            epoch(mine, x[~held], y[~held], w[~held], shape, np.random.default_rng([shape.seed, k, block]))
            rows += int((~held).sum())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups]), pa.array([pickle.dumps((rows, loss, weights, mine.parts(), mine.steps))], pa.binary())], ["part", "state"])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        total = _sum([(r, a, b, State(*p, s)) for r, a, b, p, s in map(pickle.loads, frame["state"])])
        return pd.DataFrame({"state": [pickle.dumps((*total[:3], total[3].parts(), total[3].steps))]})

    parts = blocks.mapInArrow(run, "part long, state binary").groupBy("part").applyInPandas(joined, "state binary")
    found = parts.groupBy().applyInPandas(joined, "state binary").first()  # one state, however many rows
    _, loss, weight, after = (lambda r, a, b, p, s: (r, a, b, State(*p, s)))(*pickle.loads(bytes(found["state"])))
    return (loss / weight if weight else np.nan), after


@dataclass
class Net:
    """A trained net; scoring is a narrow step in Arrow batches."""

    kind: str
    width: int
    shape: Shape
    state: State

    def score(self, df: DataFrame, prob: str = "prob") -> DataFrame:
        """Add the probability of the positive class; null where the vector is null or of another width."""
        width, shape, state = self.width, self.shape, State(self.state.weights, self.state.running)

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            ok = [k for k, v in enumerate(x) if v is not None and len(v) == width]
            out = np.full(len(x), None, object)
            if ok:
                out[ok] = predicted(state, np.nan_to_num(np.stack(x.to_numpy()[ok]).astype(float)), shape)
            return pd.Series(out)

        kept = [c for c in df.columns if c != prob]
        return df.withColumn(prob, run(F.col("features").cast("array<double>"))).select(*kept, prob)

    def save(self, path: str) -> None:
        spark, s = SparkSession.active(), self.shape
        arrays = [(p, n, list(v.shape), v.ravel().tolist()) for p, part in enumerate((self.state.weights, self.state.running)) for n, v in part.items()]
        spark.createDataFrame(arrays, "part int, name string, shape array<int>, cells array<double>").write.mode("overwrite").parquet(f"{path}/arrays")
        row = [(self.kind, self.width, list(s.hidden), s.activation)]
        spark.createDataFrame(row, "kind string, width int, hidden array<int>, activation string").write.mode("overwrite").json(f"{path}/net")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Net:
        row = spark.read.schema("kind string, width int, hidden array<int>, activation string").json(f"{path}/net").first()
        parts: list[dict[str, np.ndarray]] = [{}, {}]
        for r in spark.read.parquet(f"{path}/arrays").collect():
            parts[r["part"]][r["name"]] = np.array(r["cells"]).reshape(r["shape"])
        return cls(row["kind"], row["width"], Shape(tuple(row["hidden"]), row["activation"]), State(*parts))


def fit_net(kind: str, rows: DataFrame, params: Mapping[str, Any], width: int, seed: int = 1) -> Net:
    """Fit on ``label, weight, features``; rows whose vector is null or not ``width`` long, or whose label is null, are left out, and
    null or undefined entries count as 0. ``params``: the fields of ``Shape``."""
    shape = Shape(**{k: tuple(v) if isinstance(v, list) else v for k, v in params.items() if k in Shape.__dataclass_fields__ and k != "seed"}, seed=seed)
    usable = rows.where(F.col("features").isNotNull() & (F.size("features") == width) & F.col("label").isNotNull())
    usable = usable.withColumn("features", F.transform(F.col("features").cast("array<double>"), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))
    n = usable.count()
    if not n:
        return Net(kind, width, shape, fresh(width, shape))
    blocks = stored(packed_blocks(usable, width, n, BLOCK, lambda x: np.ascontiguousarray(x).tobytes()), "net-blocks")
    if n <= BLOCK:

        def whole(batches):
            for block, x, y, w in _blocks_of(batches, width):
                state = train_block(x, y, w, shape, block)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((state.weights, state.running))], pa.binary())], ["state"])

        found = blocks.mapInArrow(whole, "state binary").first()
        return Net(kind, width, shape, State(*pickle.loads(bytes(found["state"]))))
    state, stop, groups = fresh(width, shape), Stopper(shape.patience), max(1, isqrt(ceil(n / BLOCK)))
    for k in range(shape.epochs + 1):  # an epoch's job also tells how good the state before it was
        loss, after = _epoch_of(blocks, width, state, shape, k, groups)
        if k and loss == loss and stop.done(state, loss):
            break
        if k < shape.epochs:
            state = after
    return Net(kind, width, shape, stop.best or state)
