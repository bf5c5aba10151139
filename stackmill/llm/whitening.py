"""Embedding whitening with an exact scatter matrix: shifted bit planes, packed across rows, meet in weighted AND-popcounts."""

from __future__ import annotations

from dataclasses import dataclass
from math import isfinite

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed point of an entry, rows of one block of bit planes, and words of a plane that one step works on.
SCALE, BLOCK, WORDS = 256, 1 << 16, 128

#: Sums leave a task in limbs of so many bits, so that a sum of longs over any number of blocks stays exact.
LIMB = 32

_LONG = 1 << 63


def usable(vector: Column) -> Column:
    """True where the vector is there and all its entries are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-point entries of all vectors of a batch, one behind the other, and the vectors' lengths. Entries beyond a long
    stop at its ends, as in a cast."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    x = np.floor(values * float(SCALE))
    low, high = -(2.0**63), np.nextafter(2.0**63, 0)
    whole = np.clip(x, low, high).astype(np.int64)
    whole[x >= 2.0**63] = _LONG - 1
    return whole, np.asarray(column.value_lengths()).astype(np.int64)


def _matrix(x: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Vectors as rows; a shorter one ends in zeros."""
    out = np.zeros((len(lengths), width), np.int64)
    if len(x) == out.size:
        return x.reshape(out.shape)
    out[np.arange(width) < lengths[:, None]] = x
    return out


def _packed(column: pa.Array) -> list[bytes]:
    """One canonical byte string per vector: the width of its numbers (2, 4 or 8 bytes), then the numbers."""
    x, lengths = _entries(column)
    ends = np.cumsum(lengths)
    out = []
    for a, b in zip(ends - lengths, ends, strict=True):
        v = x[a:b]
        top = max(int(v.max()), -1 - int(v.min())) if b > a else 0
        kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
        out.append(kind[-1:].encode() + v.astype(kind).tobytes())
    return out


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums and exact upper triangle of the cross-products of the columns of an integer matrix.

    Every column is shifted to start at 0 and cut into bit planes; a plane is packed across rows into 64-bit words. The
    popcount of two planes' AND, weighted by both places, adds up to the product of the shifted columns, and the shift is
    taken back in integers.
    """
    rows, width = x.shape
    low = [int(v) for v in x.min(0)]
    shifted = x.view(np.uint64) - np.array(low, np.int64).view(np.uint64)  # wraps around to the true difference
    planes, place, owner = [], [], []
    padded = -(-rows // 64) * 64
    for i in range(width):
        for b in range(int(shifted[:, i].max()).bit_length()):
            bits = np.zeros(padded, np.uint8)
            bits[:rows] = shifted[:, i] >> np.uint64(b) & np.uint64(1)
            planes.append(np.packbits(bits).view(np.uint64))
            place.append(b)
            owner.append(i)
    square = [[0] * width for _ in range(width)]
    sums = [0] * width
    if planes:
        field = np.stack(planes)
        counts = np.zeros((len(field), len(field)), np.int64)
        for start in range(0, field.shape[1], WORDS):
            part = np.ascontiguousarray(field[:, start : start + WORDS])
            for p in range(len(part)):
                counts[p, p:] += np.bitwise_count(part[p:] & part[p]).sum(1, dtype=np.int64)
        place_of, owner_of = np.array(place), np.array(owner)
        first = np.searchsorted(owner_of, np.arange(width + 1))
        for p in range(len(field)):
            sums[owner[p]] += int(counts[p, p]) << place[p]
        for i in range(width):
            for j in range(i, width):
                block = counts[first[i] : first[i + 1], first[j] : first[j + 1]]
                if not block.size:
                    continue
                weight = place_of[first[i] : first[i + 1], None] + place_of[None, first[j] : first[j + 1]]
                if i == j:  # only the upper half was counted; a pair of different planes occurs twice in a square
                    weight = weight + (weight - 2 * place_of[first[i] : first[i + 1], None] > 0)
                by_place = np.bincount(weight.ravel(), block.ravel().astype(np.float64))  # counts stay far below 2^53
                square[i][j] = sum(int(v) << k for k, v in enumerate(by_place) if v)
    for i in range(width):
        for j in range(i, width):
            square[i][j] += low[i] * sums[j] + low[j] * sums[i] + rows * low[i] * low[j]
    return [s + rows * m for s, m in zip(sums, low, strict=True)], square


def _limbs(value: int) -> list[int]:
    """Places of a number to the base 2^LIMB, the last with its sign."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


@dataclass
class Model:
    """Integer moments of the fit list and its components: ``axes[k]`` belongs to ``variances[k]``, the largest first."""

    n: int
    sums: list[int]
    scatter: list[list[int]]
    variances: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float

    @property
    def width(self) -> int:
        return len(self.sums)


def _solved(n: int, sums: list[int], cross: list[list[int]], components: int) -> Model:
    """Centre the integer scatter exactly (n * sum xy - sum x * sum y), divide once, and take the eigenvectors."""
    width = len(sums)
    centred = [[n * cross[min(i, j)][max(i, j)] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    v = np.array([[c / (n * n) for c in row] for row in centred], float).reshape(width, width)
    e, q = np.linalg.eigh(v)
    e, q = np.maximum(e[::-1], 0.0), q[:, ::-1].T
    at = np.abs(q).argmax(1)
    q = q * np.where(q[np.arange(width), at] < 0, -1.0, 1.0)[:, None]
    floor = width * np.finfo(float).eps * (e[0] if width else 0.0)
    k = min(components, width)
    e = np.where(e > floor, e, 0.0)
    seen = [c for c in range(k) if e[c] > 0]
    scaled = (q[seen] / np.sqrt(e[seen])[:, None]).astype(np.longdouble)
    error = np.abs(scaled @ v.astype(np.longdouble) @ scaled.T - np.eye(len(seen))).max() if seen else 0.0
    return Model(n, sums, cross, e[:k], q[:k], sum(centred[i][i] for i in range(width)) / (n * n), float(error))


def fit(df: DataFrame, column: str = "embedding", components: int = 4) -> Model | None:
    """Exact moments of the distinct fixed-point vectors of ``df`` and their first principal components.

    Vectors that are null or hold null or non-finite entries are left out; if none is left there is no model. Copies meet by
    a grouping on the packed vector (copies of a task are merged before the shuffle), blocks of distinct vectors become sums
    per pair of dimensions, and those are added in a second grouping, so the driver reads one number per pair of dimensions
    whatever the number of rows. Vectors of different lengths are all filled up with zeros to the longest, and count as
    different vectors.
    """

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_packed(b.column(0)), pa.binary())], ["key"])

    def sums(batches):
        def rows_of(held):
            width = max((len(k) - 1) // int(k[:1]) for k in held)
            lengths = np.array([(len(k) - 1) // int(k[:1]) for k in held])
            x = np.concatenate([np.frombuffer(k, f"<i{int(k[:1])}", offset=1).astype(np.int64) for k in held])
            out = [(-1, width, 0, 0), (-1, -1, 0, len(held))]
            if width:
                total, cross = scatter(_matrix(x, lengths, width))
                for i in range(width):
                    out += [(i, -1, p, v) for p, v in enumerate(_limbs(total[i]))]
                    out += [(i, j, p, v) for j in range(i, width) for p, v in enumerate(_limbs(cross[i][j])) if v]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["i", "j", "limb", "value"])

        held: list[bytes] = []
        for b in batches:
            held += b.column(0).to_pylist()
            while len(held) >= BLOCK:
                yield rows_of(held[:BLOCK])
                held = held[BLOCK:]
        if held:
            yield rows_of(held)

    vector = F.col(column).cast("array<double>")
    distinct = df.where(usable(vector)).select(vector.alias("v")).mapInArrow(packed, "key binary").groupBy("key").agg(F.lit(1).alias("one")).select("key")
    added = distinct.mapInArrow(sums, "i long, j long, limb long, value long").groupBy("i", "j", "limb").agg(F.sum("value").alias("value"))
    n, width, parts = 0, 0, []
    for r in added.toLocalIterator():
        if r["i"] >= 0:
            parts.append((r["i"], r["j"], r["value"] << (LIMB * r["limb"])))
        elif r["j"] < 0:
            n = r["value"]
        else:
            width = max(width, r["j"])
    if not n:
        return None
    total, cross = [0] * width, [[0] * width for _ in range(width)]
    for i, j, v in parts:
        if j < 0:
            total[i] += v
        else:
            cross[i][j] += v
    return _solved(n, total, cross, components)


def _deviations(y: np.ndarray, exact: bool) -> list[int | None]:
    """Exact sums of squares of the rows; null beyond a long."""
    if exact and (len(y) == 0 or float((y.astype(float) ** 2).sum(1).max()) < 2.0**62):
        return (y * y).sum(1).tolist()
    return [d if (d := sum(int(v) ** 2 for v in row)) < _LONG else None for row in y]


def whiten(df: DataFrame, model: Model, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``id_column, deviation, whitened`` (one number per component) of every usable row of ``df``, whose other columns are
    ignored. Repeated rows and null ids give rows of their own. ``deviation`` is the exact sum of (n*x - S)^2, null beyond a
    long; ``whitened`` is null in a component without variance. A map; nothing is shuffled."""
    n, width, sums = model.n, model.width, model.sums

    def run(batches):
        scale = np.sqrt(model.variances)
        divided = model.axes.T / np.where(scale > 0, scale, 1.0)
        for b in batches:
            x = _matrix(*_entries(b.column(1)), width) if width else np.zeros((b.num_rows, 0), np.int64)
            top = max([abs(int(x.min())), abs(int(x.max()))]) if x.size else 0
            exact = n * top + max(map(abs, sums), default=0) < 1 << 62
            y = n * x - np.array(sums, np.int64) if exact else n * x.astype(object) - np.array(sums, object)
            z = (y.astype(float) / n) @ divided
            z[:, scale == 0] = np.nan
            white = [[None if v != v else v for v in row] for row in z.tolist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(_deviations(y, exact), pa.int64()), pa.array(white, pa.list_(pa.float64()))], [id_column, "deviation", "whitened"])

    vector = F.col(column).cast("array<double>")
    return df.where(usable(vector)).select(F.col(id_column).cast("bigint").alias(id_column), vector.alias("v")).mapInArrow(run, f"`{id_column}` long, deviation long, whitened array<double>")


def op11(spark, folder):
    """One row per usable row and component (up to 4); an empty table gives none."""
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    model = fit(table)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    found = whiten(table, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(e / model.trace) if model.trace > 0 and isfinite(e) else 0.0) for e in model.variances])
    return found.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
