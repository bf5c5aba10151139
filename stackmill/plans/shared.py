"""Linear classifiers and kernel machines of many splits and parameters, fitted together by shared passes over the rows.

The rows are packed once into blocks of matrices. A pass is one Spark job: every task reads its blocks and adds up, for all
models that are still moving, the loss and the gradient at the model's trial point. The driver holds a limited-memory quasi-Newton search per model (a few vectors of its
width) and moves all of them after each pass, every model by its own step. The number of jobs follows from the iterations and
not from the number of models.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.functions.kernels import MATRIX_MAPS
from stackmill.session import stored

#: Half width of the parabola that rounds the kink of the hinge loss; it changes the loss by a quarter of it at most.
ROUND = 0.1
#: Steps that a search remembers, and the partial sums that one task adds in the first of two levels.
MEMORY, FAN_IN = 10, 64
#: Tasks whose partial sums the driver adds itself, in the order of the tasks; those of more meet in two levels.
DIRECT = 32
#: Bytes of the matrix of a block, and rows that a step works on: of scaled features, and of kernel features.
BLOCK_BYTES, STEP, KERNEL_STEP = 1 << 24, 512, 256
#: Passes of the calibration of a margin.
CURVE_STEPS = 50


@dataclass(frozen=True)
class Job:
    """A model to fit: on the training rows that the seed at ``place`` puts outside ``fold``, shifted and divided first.

    The objective is ``C * sum(w * loss) + |v|^2 / 2`` without the intercept; ``weights`` are those of the classes 0 and 1 and
    ``total`` is their sum over the training rows. With a ``column`` the only feature is that column of the matrices, unscaled.
    """

    kind: str
    place: int
    fold: int
    shift: np.ndarray
    span: np.ndarray
    weights: tuple[float, float]
    total: float
    C: float | None
    most: int
    kernel: dict[str, Any] = field(default_factory=dict)
    column: int | None = None

    @property
    def width(self) -> int:
        return 1 if self.column is not None else self.kernel["n"] if self.kernel else len(self.shift)

    def mapping(self) -> Callable[[np.ndarray], np.ndarray]:
        """From rows to the features of the job; a kernel map is drawn once."""
        if not self.kernel:
            return lambda x: (x - self.shift) / self.span
        given = dict(self.kernel)
        apply = MATRIX_MAPS[given.pop("kernel")](len(self.shift), **given)
        return lambda x: apply((x - self.shift) / self.span)


def _loss(kind: str, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of the scores and its derivative; ``y`` is 1 or -1. A machine's hinge is rounded at its kink, all else is logistic."""
    m = y * z
    if kind != "svm":
        low = np.exp(-np.abs(m))
        return np.maximum(-m, 0.0) + np.log1p(low), -y * np.where(m >= 0, low, 1.0) / (1.0 + low)
    gap = 1.0 - m
    near = np.clip(gap + ROUND, 0.0, 2 * ROUND)
    return np.where(gap > ROUND, gap, near * near / (4 * ROUND)), -y * near / (2 * ROUND)


def _matrices(frame: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are whole (not null, ``width`` finite numbers), and those as a matrix."""
    column = frame["features"].to_numpy()
    ok = np.array([v is not None and len(v) == width for v in column], bool)
    x = np.stack(column[ok]).astype(float) if ok.any() else np.zeros((0, width))
    whole = np.isfinite(x).all(1)
    ok[ok] = whole
    return ok, x[whole]


#: A block: a matrix, which of its rows are positive, and their folds by place.
PACKED = "x binary, label binary, folds binary"


def _blocks(x: np.ndarray, label: np.ndarray, folds: np.ndarray) -> Iterator[pd.DataFrame]:
    step = max(1, BLOCK_BYTES // (8 * max(1, x.shape[1])))
    for a in range(0, len(x), step):
        part = (np.ascontiguousarray(v[a : a + step]).tobytes() for v in (x, label, folds))
        yield pd.DataFrame([tuple(part)], columns=["x", "label", "folds"])


def _packed(rows: DataFrame, width: int, name: str = "blocks") -> DataFrame:
    """``label, features, fold_of`` as stored blocks, dealt over all cores; rows without a whole vector are left out."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            ok, x = _matrices(frame, width)
            if len(x):
                held.append((x, (frame["label"].to_numpy()[ok] == 1), np.stack(frame["fold_of"].to_numpy()[ok]).astype(np.int32)))
                size += x.nbytes
            if size >= BLOCK_BYTES:
                yield from _blocks(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield from _blocks(*map(np.concatenate, zip(*held, strict=True)))

    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * width * 8 // BLOCK_BYTES))
    return stored(rows.select("label", "features", "fold_of").repartition(parts).mapInPandas(pack, PACKED), name)


def _read(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for x, label, folds in zip(*b.columns, strict=True):
            matrix = np.frombuffer(x.as_buffer()).reshape(-1, width)
            yield matrix, np.frombuffer(label.as_buffer(), bool), np.frombuffer(folds.as_buffer(), np.int32).reshape(len(matrix), -1)


def _evaluate(x: np.ndarray, label: np.ndarray, folds: np.ndarray, jobs: Sequence[Job], points: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Per job: the sum of the losses, and the gradient by intercept and weights, over these rows."""
    out = [np.zeros(j.width + 2) for j in jobs]
    groups: dict[tuple[str, bool], list[int]] = {}
    for k, job in enumerate(jobs):
        if not job.kernel:
            groups.setdefault((job.kind, job.column is not None), []).append(k)
            continue
        apply = job.mapping()
        inside = np.flatnonzero(folds[:, job.place] != job.fold)
        for a in range(0, len(inside), KERNEL_STEP):  # features of a few rows stay in the cache
            own = inside[a : a + KERNEL_STEP]
            f, positive = apply(x[own]), label[own]
            loss, slope = _loss(job.kind, f @ points[k][1:] + points[k][0], np.where(positive, 1.0, -1.0))
            weight = np.where(positive, job.weights[1], job.weights[0])
            slope *= weight
            out[k][0] += (weight * loss).sum()
            out[k][1] += slope.sum()
            out[k][2:] += slope @ f
    for (kind, curve), own in groups.items():
        sums = _together(kind, curve, x, label, folds, [jobs[k] for k in own], np.stack([points[k] for k in own], 1))
        for c, k in enumerate(own):
            out[k] += sums[:, c]
    return out


def _together(kind: str, curve: bool, x: np.ndarray, label: np.ndarray, folds: np.ndarray, jobs: Sequence[Job], v: np.ndarray) -> np.ndarray:
    """The sums of jobs without a kernel, a column each: all splits pass together, by one product of matrices."""
    out = np.zeros((len(v) + 1, len(jobs)))
    places, held, columns = [j.place for j in jobs], np.array([j.fold for j in jobs]), [j.column for j in jobs]
    negative, positive = (np.array([j.weights[y] for j in jobs]) for y in (0, 1))
    if not curve:
        span, shift = np.stack([j.span for j in jobs], 1), np.stack([j.shift for j in jobs], 1)
        centre = shift.mean(1)
        shift = (shift - centre[:, None]) / span
        scaled, start = v[1:] / span, v[0] - (shift * v[1:]).sum(0)
    for a in range(0, len(x), STEP):
        part = slice(a, a + STEP)
        y = label[part, None]
        own = x[part][:, columns] if curve else x[part] - centre
        loss, slope = _loss(kind, own * v[1] + v[0] if curve else own @ scaled + start, np.where(y, 1.0, -1.0))
        weight = np.where(y, positive, negative) * (folds[part][:, places] != held)
        slope *= weight
        total = slope.sum(0)
        out[0] += (weight * loss).sum(0)
        out[1] += total
        out[2:] += (slope * own).sum(0) if curve else own.T @ slope / span - shift * total
    return out


def _pass(rows: DataFrame, width: int, jobs: Sequence[Job], points: Sequence[np.ndarray]) -> list[np.ndarray]:
    """``_evaluate`` over all blocks. The partial sums of a few tasks are added here; those of many meet in two levels, so nobody
    gets those of all others."""
    sent = rows.sparkSession.sparkContext.broadcast((list(jobs), list(points)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jobs, points = sent.value
        sums = None
        for block in _read(batches, width):
            part = _evaluate(*block, jobs, points)
            sums = part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(jobs)), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], ["job", "sums"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"job": frame["job"][:1], "sums": [np.sum([np.frombuffer(s) for s in frame["sums"]], axis=0).tobytes()]})

    parts = rows.mapInArrow(run, "job int, sums binary")
    if rows.rdd.getNumPartitions() > DIRECT:
        parts = parts.withColumn("slot", F.floor(F.spark_partition_id() / FAN_IN))
        once = parts.groupBy("job", "slot").applyInPandas(lambda frame: add(frame), "job int, sums binary")
        parts = once.groupBy("job").applyInPandas(add, "job int, sums binary")
    found = [np.zeros(j.width + 2) for j in jobs]
    for r in parts.collect():
        found[r["job"]] += np.frombuffer(r["sums"])
    sent.destroy()
    return found


class Search:
    """A limited-memory quasi-Newton search that is told the value and gradient at ``trial`` and chooses the next one."""

    def __init__(self, job: Job, tolerance: float = 1e-9):
        self.job, self.tolerance = job, tolerance
        self.trial = np.zeros(job.width + 1)
        self.at: np.ndarray | None = None
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.taken, self.done = 0, False

    def _objective(self, sums: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean form: losses by the total weight, and the ridge of the weights where the job has one."""
        total = max(self.job.total, 1e-300)
        value, gradient = sums[0] / total, sums[1:] / total
        if self.job.C is not None:
            ridge = 1.0 / (self.job.C * max(total, 1.0))
            value += ridge / 2 * float(self.trial[1:] @ self.trial[1:])
            gradient = gradient + ridge * np.concatenate([[0.0], self.trial[1:]])
        return value, gradient

    def _direction(self) -> np.ndarray:
        q, kept = self.gradient.copy(), []
        for s, y in reversed(self.steps):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        if self.steps:
            s, y = self.steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.steps, reversed(kept), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        return -q

    def tell(self, sums: np.ndarray) -> None:
        value, gradient = self._objective(sums)
        if self.at is not None:
            if not value <= self.value + 1e-4 * self.step * self.fall:  # also when it is no number
                self.step *= 0.4
                self.trial = self.at + self.step * self.way
                self.done = self.step < 1e-8
                return
            s, y = self.trial - self.at, gradient - self.gradient
            if s @ y > 1e-12 * (y @ y):
                self.steps = [*self.steps[1 - MEMORY :], (s, y)] if len(self.steps) >= MEMORY else [*self.steps, (s, y)]
            self.taken += 1
            self.done = self.taken >= self.job.most or self.value - value <= self.tolerance * max(abs(value), 1e-12)
        self.at, self.value, self.gradient = self.trial, value, gradient
        size = float(np.linalg.norm(gradient))
        self.done = self.done or size < 1e-9
        if not self.done:
            self.way = self._direction()
            self.fall = float(self.way @ gradient)
            if self.fall >= 0:
                self.steps, self.way, self.fall = [], -gradient, -size * size
            self.step = 1.0 if self.steps else min(1.0, 1.0 / size)
            self.trial = self.at + self.step * self.way


def _solved(rows: DataFrame, width: int, jobs: Sequence[Job]) -> list[np.ndarray]:
    searches = [Search(j) for j in jobs]
    while moving := [s for s in searches if not s.done]:
        for s, sums in zip(moving, _pass(rows, width, [s.job for s in moving], [s.trial for s in moving]), strict=True):
            s.tell(sums)
    return [s.trial if s.at is None else s.at for s in searches]


@dataclass
class LinearFit:
    """A linear score of the scaled features, or of their kernel map, and a logistic curve over it."""

    kind: str
    width: int
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    offset: float = 0.0
    kernel: dict[str, Any] = field(default_factory=dict)

    def margins(self, x: np.ndarray) -> np.ndarray:
        if self.kernel:
            given = dict(self.kernel)
            x = MATRIX_MAPS[given.pop("kernel")](self.width, **given)(x)
        return x @ self.weights + self.intercept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margins(x) + self.offset, -700, 700)))

    def score(self, df: DataFrame, prob: str = "prob") -> DataFrame:
        """Add the probability of the positive class; null where the vector is not ``width`` finite numbers."""
        sent = df.sparkSession.sparkContext.broadcast(self)
        width = self.width

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            ok, whole = _matrices(x.to_frame("features"), width)
            out = np.full(len(x), None, object)
            out[ok] = sent.value.probabilities(whole)
            return pd.Series(out)

        kept = [c for c in df.columns if c != prob]
        return df.withColumn(prob, run(F.col("features").cast("array<double>"))).select(*kept, prob)

    def save(self, path: str) -> None:
        row = [("linear", self.kind, self.width, json.dumps(self.kernel), self.weights.tolist(), self.intercept, self.slope, self.offset)]
        SparkSession.active().createDataFrame(row, SAVED).write.mode("overwrite").json(f"{path}/linear")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearFit:
        r = spark.read.schema(SAVED).json(f"{path}/linear").first()
        return cls(r["of"], r["width"], np.array(r["weights"], float), r["intercept"], r["slope"], r["offset"], json.loads(r["kernel"]))


SAVED = "kind string, of string, width int, kernel string, weights array<double>, intercept double, slope double, offset double"


def job_of(kind: str, params: Mapping[str, Any], place: int, fold: int, scale: tuple[np.ndarray, np.ndarray], size: Any, seed: int) -> Job:
    """The job of a logistic regression or a machine; ``size`` is the ``TrainSize`` of the scaled training rows."""
    w0, w1 = size.class_weights(params)
    kernel: dict[str, Any] = {}
    if kind == "svm" and params["kernel"] in MATRIX_MAPS:
        poly, gamma = params["kernel"] == "poly", params.get("gamma", "scale")
        value = 1.0 / (size.width * size.variance) if gamma == "scale" else 1.0 / size.width if gamma == "auto" else float(gamma)
        kernel = {"kernel": params["kernel"], "n": int(params.get("n_features", 1024 if poly else 512)), "gamma": value, "seed": seed}
        if poly:
            kernel["offset"] = float(params.get("offset", 1.0))
    total = size.negatives * w0 + size.positives * w1
    return Job(kind, place, fold, *scale, (w0, w1), total, float(params["C"]), int(params.get("max_iter", 100)), kernel)


def _margins(rows: DataFrame, width: int, machines: Sequence[Job], points: Sequence[np.ndarray]) -> DataFrame:
    """Stored blocks whose matrix has one column per machine, its margin: a calibration does not map the rows in every pass."""
    sent = rows.sparkSession.sparkContext.broadcast((list(machines), list(points)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines, points = sent.value
        maps = [j.mapping() for j in machines]
        step = max(1, BLOCK_BYTES // (8 * len(machines)))
        for x, label, folds in _read(batches, width):
            for a in range(0, len(x), step):
                part = x[a : a + step]
                out = np.empty((len(part), len(machines)))
                for c, (apply, v) in enumerate(zip(maps, points, strict=True)):
                    for s in range(0, len(part), KERNEL_STEP):
                        out[s : s + KERNEL_STEP, c] = apply(part[s : s + KERNEL_STEP]) @ v[1:] + v[0]
                for frame in _blocks(out, label[a : a + step], folds[a : a + step]):
                    yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return stored(rows.mapInArrow(run, PACKED), "margins")


def fit_shared(base: DataFrame, jobs: Sequence[Job]) -> list[LinearFit]:
    """Fit all jobs on ``label, features, fold_of`` (rows without ``fold_of``, without a label or a whole vector are left out).

    Machines get a logistic curve over their margin, fitted on the same rows, as ``estimators.fit`` does. A job without rows
    stays at zero, so its probability is 0.5.
    """
    if not jobs:
        return []
    width = len(jobs[0].shift)
    rows = _packed(base.where(F.col("fold_of").isNotNull() & F.col("label").isNotNull()), width)
    found = _solved(rows, width, jobs)
    machines = [k for k, j in enumerate(jobs) if j.kind == "svm"]
    curves: dict[int, np.ndarray] = {}
    if machines:
        margins = _margins(rows, width, [jobs[k] for k in machines], [found[k] for k in machines])
        asked = [replace(jobs[k], kind="lr", kernel={}, column=c, C=None, most=CURVE_STEPS) for c, k in enumerate(machines)]
        curves = dict(zip(machines, _solved(margins, len(machines), asked), strict=True))
    out = []
    for k, (job, v) in enumerate(zip(jobs, found, strict=True)):
        offset, slope = curves.get(k, (0.0, 1.0))
        out.append(LinearFit(job.kind, width, v[1:], float(v[0]), float(slope), float(offset), dict(job.kernel)))
    return out


def predictions(base: DataFrame, runs: Sequence[tuple[str, int, int]], jobs: Sequence[Job], fits: Sequence[LinearFit]) -> DataFrame:
    """``id, role, y_true, prob, model, seed, fold`` of all runs (model, seed, fold) by one narrow pass: training rows under the
    runs that validate them, all other rows under every run. Null where the vector is not whole."""
    sent = base.sparkSession.sparkContext.broadcast((list(runs), list(jobs), list(fits)))
    width = len(jobs[0].shift)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, jobs, fits = sent.value
        for frame in frames:
            ok, x = _matrices(frame, width)
            at = np.cumsum(ok) - 1
            own = (frame["role"] == "train").to_numpy()
            split = np.array([f is not None for f in frame["fold_of"]], bool)
            folds = np.stack(frame["fold_of"].to_numpy()[split]) if split.any() else None
            for (model, seed, fold), job, fit in zip(runs, jobs, fits, strict=True):
                held = split.copy()
                if folds is not None:
                    held[split] = folds[:, job.place] == job.fold
                chosen = np.flatnonzero(~own | held)
                prob = np.full(len(chosen), np.nan)
                whole = ok[chosen]
                if whole.any():
                    prob[whole] = fit.probabilities((x[at[chosen[whole]]] - job.shift) / job.span)
                part = frame.iloc[chosen]
                yield pd.DataFrame({
                    "id": part["id"].astype("Int64"), "role": np.where(own[chosen], "fold_val", part["role"].to_numpy()),
                    "y_true": part["label"].astype("Int64"), "prob": prob, "model": model, "seed": seed, "fold": fold,
                })

    rows = base.select(F.col("id").cast("bigint").alias("id"), "role", F.col("label").cast("int").alias("label"), "features", "fold_of")
    out = rows.mapInPandas(run, "id bigint, role string, y_true int, prob double, model string, seed int, fold int")
    return out.withColumn("prob", F.nanvl("prob", F.lit(None).cast("double")))
