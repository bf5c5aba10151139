"""Language identification: averaged hashed subword embeddings, a linear softmax, stochastic gradient descent, calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackmill.llm.common import chunks, documents, fold, id_text, mix64

BUCKETS = 1 << 16
WIDTH = 16
ORDERS = (1, 2, 3, 4)
#: Bound of the training sample: rows per language and characters in all, both drawn by hash of the id.
ROWS_PER_LANGUAGE = 600
LANGUAGES = 512
MOST_CHARACTERS = 20_000_000
UNKNOWN = "und"
#: Predictions of lower calibrated confidence are marked rejected.
REJECT = 0.5


def _folding() -> np.ndarray:
    """Lower-case code of every letter, 32 for all else."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Subwords:
    """Hashed letter n-grams inside words (with the word's edges) of many texts at once."""

    def __init__(self):
        self.fold = _folding()

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket of every n-gram, the text it belongs to (both ordered by text within an order n), and letters per text."""
        codes = self.fold[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
        letter = codes != 32
        scrambled = mix64(codes.astype(np.uint64) + np.uint64(1))
        buckets, owners = [], []
        for n in ORDERS:
            if len(codes) < n:
                continue
            size = len(codes) - n + 1
            key = np.zeros(size, np.uint64)
            inner = np.ones(size, bool)
            for k in range(n):
                key = key * np.uint64(0x9E3779B97F4A7C15) + scrambled[k : k + size]
                if 0 < k < n - 1 or n == 1:
                    inner &= letter[k : k + size]
            if n == 2:
                inner &= letter[:size] | letter[1:]
            buckets.append(((key[inner] ^ np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int32) % BUCKETS)
            owners.append(owner[:size][inner])
        letters = np.bincount(owner[letter], minlength=len(texts))
        return np.concatenate(buckets) if buckets else np.zeros(0, np.int32), np.concatenate(owners) if owners else np.zeros(0, np.int32), letters


@dataclass
class Model:
    """``table`` holds the embedding of each bucket already multiplied by the softmax weights: averages commute with it."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str], subwords: Subwords) -> tuple[np.ndarray, np.ndarray]:
        bucket, owner, letters = subwords.grams(texts)
        total = np.stack([np.bincount(owner, self.table[bucket, k], len(texts)) for k in range(len(self.languages))], 1)
        count = np.bincount(owner, minlength=len(texts))
        logits = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True), letters


def _examples(texts: list[str], seed: int) -> tuple[list[str], list[int]]:
    """Whole texts and, from each, one random passage of 20 to 200 characters, so that short texts are learned as well."""
    draw = np.random.default_rng(seed)
    out, of = list(texts), list(range(len(texts)))
    for i, t in enumerate(texts):
        if len(t) > 40:
            n = int(draw.integers(20, 201))
            at = int(draw.integers(0, max(1, len(t) - n)))
            out.append(t[at : at + n])
            of.append(i)
    return out, of


def train(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Fit on whole texts (a bounded sample). A tenth of the texts sets the temperature and is not learned from."""
    languages = sorted(set(labels))
    subwords, draw = Subwords(), np.random.default_rng(seed)
    examples, of = _examples(texts, seed)
    target = np.array([languages.index(labels[i]) for i in of])
    rows = []
    for start in range(0, len(examples), 64):
        bucket, owner, _ = subwords.grams(examples[start : start + 64])
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(examples[start : start + 64]) + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            ids, n = np.unique(bucket[order[a:b]], return_counts=True)
            rows.append((ids, (n / max(1, b - a)).astype(np.float32)))
    kept = np.array([i % 10 == 9 and len(texts) >= 100 for i in of])
    embedding = draw.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    weights += draw.normal(0, 0.3, weights.shape).astype(np.float32)
    learn = np.flatnonzero(~kept)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in draw.permutation(learn):
            ids, share = rows[i]
            if not len(ids):
                continue
            hidden = share @ embedding[ids]
            logits = hidden @ weights + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[target[i]] -= 1
            embedding[ids] -= step * 20 * share[:, None] * (weights @ error)
            weights -= step * np.outer(hidden, error)
            bias -= step * 0.1 * error
    table = embedding @ weights
    logits = np.array([rows[i][1] @ table[rows[i][0]] + bias if len(rows[i][0]) else bias for i in np.flatnonzero(kept)])
    temperature = 1.0
    if len(logits):
        def loss(t):
            z = logits / t - (logits / t).max(1, keepdims=True)
            return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), target[kept]]).mean())

        temperature = min((0.25 * 1.25**k for k in range(20)), key=loss)
    return Model(languages, table.astype(np.float32), bias, temperature)


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, characters: int = MOST_CHARACTERS, languages: int = LANGUAGES) -> Model | None:
    """Train on a bounded sample of ``docs`` (``doc_id, text, lang``): of each language the rows with the smallest md5 of
    their id whose texts fit into an equal share of ``characters``; a language of longer texts only gives its shortest one.
    So every language is learned and the driver reads a bounded number of texts. More than ``languages`` languages are
    refused, not cut. A null language or text is not learned from. Without a usable row there is no model."""
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang", F.md5(id_text()).alias("key"), F.length("text").alias("n"))
    # Hash prefixes thin the rows before any window sees them: expected rows per language stay a few times the bound.
    counts = {r["lang"]: r for r in usable.groupBy("lang").agg(F.count("*").alias("rows"), F.min("n").alias("least")).limit(languages + 1).collect()}
    if not counts:
        return None
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages: pass a larger bound")
    own = characters // len(counts)
    table = docs.sparkSession.createDataFrame(
        [(k, min(1.0, 4 * rows_per_language / v["rows"]), max(own, v["least"]), v["least"]) for k, v in counts.items()], "of string, share double, budget long, least long")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    thin = usable.join(F.broadcast(table), F.col("lang") == F.col("of")).where(F.col("n") <= F.col("budget"))
    thin = thin.where((place < F.col("share")) | ((F.col("least") > own) & (F.col("n") == F.col("least"))))
    by_key = Window.partitionBy("lang").orderBy("key", "text")
    ranked = thin.withColumn("rn", F.row_number().over(by_key)).withColumn("size", F.sum("n").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.where((F.col("rn") <= rows_per_language) & (F.col("size") <= F.col("budget")))
    texts, labels = [], []
    for row in ranked.orderBy("rn", "lang").select("text", "lang").toLocalIterator():
        texts.append(row["text"])
        labels.append(row["lang"])
    return train(texts, labels)


def identify(docs: DataFrame, model: Model | None, reject: float = REJECT) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row of ``docs`` (``doc_id, text``).

    ``lang_pred`` is a learned language, or ``und`` with score 0 if the text is null or has no letter (or nothing was
    learned). ``score`` is the calibrated probability; ``rejected`` marks scores below ``reject`` and ``und``. Repeated rows
    give repeated results; other columns are ignored. A map over whole texts, a million characters at a time.
    """

    def run(frames):
        subwords = Subwords()
        for frame in frames:
            for part, texts in chunks(frame, limit=400_000):
                pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                if model:
                    p, letters = model.probabilities(texts, subwords)
                    has = letters > 0
                    pred[has] = np.array(model.languages, object)[p.argmax(1)][has]
                    score[has] = p.max(1)[has]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(object), "lang_pred": pred, "score": score, "rejected": (score < reject) | (pred == UNKNOWN)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op7(spark, folder):
    docs = documents(spark, folder)
    model = fit(docs.where(fold(4) != 2))
    return identify(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
