"""Explicit features whose inner products approximate a kernel, so that a linear machine stands for a kernel machine.

Both maps are drawn from a seed, once per task; rows pass in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Rows that are mapped and sent on at a time.
MAPPED_ROWS = 512


def _mapped(values: Column, width: int, made: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> Column:
    """Apply a map of matrices; null where the vector is null or of another width."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        apply = made()
        for x in batches:
            for at in range(0, len(x), MAPPED_ROWS):  # a mapped row is far wider than its vector
                part = x.iloc[at : at + MAPPED_ROWS]
                ok = [k for k, v in enumerate(part) if v is not None and len(v) == width]
                out = np.full(len(part), None, object)
                if ok:
                    for k, row in zip(ok, apply(np.stack(part.to_numpy()[ok]).astype(float)), strict=True):
                        out[k] = row
                yield pd.Series(out)

    return run(values)


#: Rows whose angles stay in the cache, and the series of sin(2 pi t): for a quarter of a turn its rest is below 3e-16.
ANGLE_ROWS = 32
SINE = [(-1) ** k * (2 * np.pi) ** (2 * k + 1) / math.factorial(2 * k + 1) for k in range(11)]


def _cosine(t: np.ndarray, square: np.ndarray, out: np.ndarray, factor: float = 1.0) -> None:
    """``out`` = factor * cos(2 pi t) of turns; ``t`` and ``square`` are overwritten. Several times as fast as ``np.cos``, which takes
    doubles one at a time."""
    np.rint(t, out=out)
    t -= out
    np.abs(t, out=t)
    np.subtract(0.25, t, out=t)  # cos(2 pi t) = sin(2 pi (1/4 - |t|))
    np.multiply(t, t, out=square)
    np.multiply(square, factor * SINE[-1], out=out)
    for c in SINE[-2:0:-1]:
        out += factor * c
        out *= square
    out += factor * SINE[0]
    out *= t


def fourier_map(width: int, n: int, gamma: float, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """cos(Wx + b) features whose inner products approximate exp(-gamma |x - y|^2)."""
    draw = np.random.default_rng(seed)
    w = draw.normal(scale=np.sqrt(2.0 * gamma), size=(width, n))
    b = draw.uniform(0.0, 2.0 * np.pi, size=n)
    turns, start = w / (2.0 * np.pi), b / (2.0 * np.pi)

    work = np.empty((2, ANGLE_ROWS, n))

    def apply(x):
        out = np.empty((len(x), n))
        for a in range(0, len(x), ANGLE_ROWS):
            part = x[a : a + ANGLE_ROWS]
            t, square = work[:, : len(part)]
            np.matmul(part, turns, out=t)
            t += start
            _cosine(t, square, out[a : a + ANGLE_ROWS], np.sqrt(2.0 / n))
        return out

    return apply


def sketch_map(width: int, n: int, gamma: float, seed: int, offset: float = 0.0, degree: int = 3) -> Callable[[np.ndarray], np.ndarray]:
    """Sketches whose inner products approximate (gamma x.y + offset)^degree, of all features.

    The offset is one more feature. Each factor of the power gets a count sketch of its own (every feature adds, with a random
    sign, to one random cell); the sketch of the product is the circular convolution of the factors' sketches, a product in
    the Fourier domain. The expected inner product is the kernel, its deviation about kernel(x,x) kernel(y,y) / sqrt(n).
    """
    draw = np.random.default_rng(seed)
    cells = draw.integers(0, n, (degree, width + 1))
    signs = draw.choice([-1.0, 1.0], (degree, width + 1))

    def apply(x):
        full = np.hstack([np.sqrt(gamma) * x, np.full((len(x), 1), np.sqrt(offset))])
        product = np.ones((len(x), n // 2 + 1), complex)
        for cell, sign in zip(cells, signs, strict=True):
            place = np.zeros((width + 1, n))
            place[np.arange(width + 1), cell] = sign
            product *= np.fft.rfft(full @ place, axis=1)
        # the transform's rounding goes, or a linear machine would scale up the cells that are 0 or constant
        return np.round(np.fft.irfft(product, n, axis=1), 12) + 0.0

    return apply


def random_features(values: Column, width: int, n: int, gamma: float, seed: int) -> Column:
    """``fourier_map`` of a column of vectors."""
    return _mapped(values, width, lambda: fourier_map(width, n, gamma, seed))


def tensor_sketch(values: Column, width: int, n: int, gamma: float, seed: int, offset: float = 0.0, degree: int = 3) -> Column:
    """``sketch_map`` of a column of vectors."""
    return _mapped(values, width, lambda: sketch_map(width, n, gamma, seed, offset, degree))


#: The maps by the kernel they stand for: of columns, and of matrices.
MAPS = {"rbf": random_features, "poly": tensor_sketch}
MATRIX_MAPS = {"rbf": fourier_map, "poly": sketch_map}
