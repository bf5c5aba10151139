"""Helpers that several operators share: the word pattern, folds, batches of bounded size, keys and hashes of words."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stackmill.session import stored

#: A word is a maximal run of anything but ASCII white space. ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Characters of text that one numpy step works on; larger batches are cut, a single longer text is a step of its own.
CHUNK = 1_000_000


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def id_text(column: str = "doc_id") -> Column:
    """The id as text; a null id counts as the empty text, so that folds and seeds stay defined."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id's text modulo n."""
    return F.pmod(F.crc32(id_text(column)), F.lit(n))


def n_words(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("bigint")


def unit(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) drawn from the md5 of a seed and columns: the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *columns)), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def chunks(frame: pd.DataFrame, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pd.DataFrame, list[str]]]:
    """Cut a batch into pieces of at most ``limit`` characters (one text at least); null texts become empty."""
    texts = [t if isinstance(t, str) else "" for t in frame[column]]
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield frame.iloc[start:i], texts[start:i]
            start, size = i, 0
        size += len(t)
    if texts:
        yield frame.iloc[start:], texts[start:]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, characters: int) -> DataFrame:
    """``text, label, place``: a bounded sample for a fit.

    ``labels`` holds one ``label`` per ``doc_id``; null ids, labels and texts are left out. Labelled rows are taken in the order
    of crc32(id), id, and md5(text), whatever the order of the files: the first ``rows`` of them, of which each one joins if its
    text still fits into ``characters`` (a text that does not fit is left out, and shorter ones behind it may still join). Only
    ids and lengths are read by the driver, ``rows`` of them at most.
    """
    chosen = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id"), "label", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    chosen = chosen.orderBy("h", "id").limit(rows)
    found = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    found = found.select("h", "id", F.md5("text").alias("m"), "label", F.length("text").alias("n"), "text")
    left, wanted = characters, {}
    for r in found.drop("text").orderBy("h", "id", "m").limit(rows).collect():
        if r["n"] <= left:
            left -= r["n"]
            wanted.setdefault((r["id"], r["m"]), len(wanted))  # a repeated row counts once
    keys = docs.sparkSession.createDataFrame([(i, m, k) for (i, m), k in wanted.items()], "wid long, wm string, place long")
    both = found.join(F.broadcast(keys), (F.col("id") == F.col("wid")) & (F.col("m") == F.col("wm")))
    return both.groupBy("place").agg(F.min(F.struct("text", "label")).alias("r")).select("r.text", "r.label", "place")


def fitted(sample: DataFrame, train: Callable[[list[str], list], tuple]) -> tuple:
    """What ``train(texts, labels)`` makes of a bounded sample (``text, label, place``), run by one task of the executors, so
    that neither the texts nor the work of the fit stay with the driver. ``train`` gives a tuple of built-in values."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        return pd.DataFrame({"model": [pickle.dumps(train(frame["text"].tolist(), frame["label"].tolist()))]})

    found = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "model binary").first()
    return pickle.loads(bytes(found["model"])) if found else train([], [])


def counted(df: DataFrame, name: str, *more: Column) -> tuple[DataFrame, dict]:
    """``df`` written to the shared folder and read back, and what the same job counted: ``rows``, and more aggregates."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("rows"), *more), name)
    return out, seen.get


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (multiply and shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end byte of every word of a byte string, without a Python step per word."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    table = mix64(np.arange(1, 257, dtype=np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[data] * _powers(_BASE, len(data)), dtype=np.uint64)))
    return mix64((sums[end] - sums[start]) * _powers(_BASE_INVERSE, len(data))[start]), start, end


#: Bits of a filter of keys that travels with tasks (16 MB whatever the corpus), and its blocks.
FILTER_BITS, FILTER_BLOCKS = 1 << 27, 1 << 10


def _probe(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter, in one block."""
    h = mix64(key ^ np.uint64(0x5EED))
    inside = np.uint64(FILTER_BITS // FILTER_BLOCKS)
    base = (h >> np.uint64(54)) * inside
    return base + h % inside, base + (h >> np.uint64(20)) % inside


def in_filter(field: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter: all that were put in, and few others while the filter is not full."""

    def bit(x):
        return field[(x >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (x & np.uint64(7))).astype(np.uint8) & 1

    one, two = _probe(key)
    return (bit(one) & bit(two)).astype(bool)


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size of a column ``key`` (long), made by the executors in blocks. It may only save work: what
    it lets through has to be decided exactly."""
    inside = FILTER_BITS // FILTER_BLOCKS

    def bits(frames):
        for frame in frames:
            both = np.unique(np.concatenate(_probe(frame["key"].to_numpy().view(np.uint64))))
            block = (both // np.uint64(inside)).astype(np.int64)
            for k in np.unique(block):
                field = np.zeros(inside, bool)
                field[(both[block == k] % np.uint64(inside)).astype(np.int64)] = True
                yield pd.DataFrame({"block": [k], "field": [np.packbits(field).tobytes()]})

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        field = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in frame["field"]])
        return pd.DataFrame({"block": frame["block"][:1], "field": [field.tobytes()]})

    schema = "block long, field binary"
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in keys.mapInPandas(bits, schema).groupBy("block").applyInPandas(join, schema).toLocalIterator():
        out[r["block"] * inside // 8 : (r["block"] + 1) * inside // 8] = np.frombuffer(r["field"], np.uint8)
    return out
