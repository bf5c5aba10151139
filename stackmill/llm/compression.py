"""Quality by compression: dictionaries of good and of bad text, and the difference of the compressed sizes as a score."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackmill.llm.common import documents, fitted, fold, labelled_sample

#: Bound of the labelled sample: rows, and characters in all.
LABELLED = 8000
MOST_CHARACTERS = 40_000_000

#: Texts are compressed in pieces of so many bytes, so that a long text cannot become its own dictionary.
PIECE = 512
DICTIONARY, LEVEL = 64 * 1024, 3

THRESHOLD = 0.7


def pieces(raw: bytes) -> list[bytes]:
    """The whole text, cut every ``PIECE`` bytes; a short rest stays with the piece before it."""
    n = max(1, round(len(raw) / PIECE))
    return [raw[k * len(raw) // n : (k + 1) * len(raw) // n] for k in range(n)]


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary trained on the pieces of texts; few texts are the dictionary themselves."""
    samples = [p for t in texts for p in pieces(t) if p]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples to train on
        return b"".join(samples)[-DICTIONARY:]


class Sizes:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.coders = []
        for raw in (good, bad):
            given = zstandard.ZstdCompressionDict(raw) if raw else None
            if given is not None:
                given.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_content_size=False, write_checksum=False, write_dict_id=False))

    def differences(self, raw: bytes) -> tuple[float, float]:
        """(bad - good) / (bad + good) of the whole text, and of its piece that is most like bad text; 0 for an empty text."""
        if not raw:
            return 0.0, 0.0
        sizes = [[len(c.compress(p)) for c in self.coders] for p in pieces(raw)]
        good, bad = (sum(s[k] for s in sizes) for k in (0, 1))
        return (bad - good) / (bad + good), min((b - g) / (b + g) for g, b in sizes)


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Intercept and weights of a ridge logistic regression by Newton steps; without both labels the share of ones alone."""
    x1 = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x1.shape[1])
    if not 0 < y.sum() < len(y):
        w[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return tuple(w.tolist())
    penalty = np.r_[0.0, np.full(x.shape[1], ridge)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, x1.T @ (p - y) + penalty * w)
        w -= np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _design(found: list[tuple[float, float]]) -> np.ndarray:
    return np.array(found, float).reshape(-1, 2)


def train(texts: list[str], labels: list[int]) -> tuple[bytes, bytes, tuple[float, ...]]:
    """Dictionaries of good and of bad text, and the calibration. Two halves of the texts take turns: dictionaries of one half give the sizes of the other, which calibrate the score;
    the dictionaries of the model then hold both halves. So no text is measured with a dictionary that has seen it, and
    copies of a text count once, or else the halves would share them."""
    seen: dict[bytes, int] = {}
    for t, y in zip(texts, labels, strict=True):
        seen.setdefault(t.encode("utf-8", "replace"), int(y))
    raw, y = list(seen), np.array(list(seen.values()), int)

    def both(at):
        return [dictionary([raw[i] for i in at if y[i] == k]) for k in (1, 0)]

    x = np.zeros((len(raw), 2))
    for part in (0, 1):
        sizes = Sizes(*both(range(1 - part, len(raw), 2)))
        for i in range(part, len(raw), 2):
            x[i] = sizes.differences(raw[i])
    good, bad = both(range(len(raw)))
    return good, bad, calibrated(x, y.astype(float))


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED, characters: int = MOST_CHARACTERS) -> Model:
    """Train on a bounded sample (``labelled_sample``) of ``docs`` (``doc_id, text``) with ``labels`` (``doc_id, quality``);
    several labels of an id count as good if all are. Null texts and labels are not learned from."""
    labelled = labels.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    return Model(*fitted(labelled_sample(docs, labelled, rows, characters), train))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, difference, worst``: the probability of good quality, and the normalised differences it comes from (of
    the whole text and of its worst piece). Null and empty texts have the differences 0; repeated rows give repeated results;
    other columns are ignored. A map over whole texts; nothing is shuffled."""

    def run(batches):
        sizes, w = Sizes(model.good, model.bad), np.array(model.weights)
        for b in batches:
            x = _design([sizes.differences(t or b"") for t in b.column(1).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(x[:, 0]), pa.array(x[:, 1])], ["doc_id", "score", "difference", "worst"])

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, score double, difference double, worst double")


def learned(spark, folder) -> Model:
    """The model of the test tables, learned outside fold 2 of 4."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").where(fold(4) != 2)
    return fit(documents(spark, folder), labels)


def op13(spark, folder):
    found = score(documents(spark, folder), learned(spark, folder))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "difference", "worst")
