"""Language-model scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax.

The features predict the class of a word, and then the word inside its class: its words are the leaves of an 8-ary Huffman
tree, and every choice on the way to a leaf is a softmax over the same features.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackmill.llm.common import chunks, documents, fold, mix64, word_hashes
from stackmill.session import stored

CLASSES = 16
#: At most 2^16, as ``learn_chunk`` sorts them as 16-bit numbers.
BUCKETS = 1 << 15
#: Branches of a choice inside a class, and rows of the features of these choices.
BRANCHES = 8
WORD_BUCKETS = 1 << 17
PASSES = 2
RATE = 0.3
STEP = 1 << 15
LONG_STEP = 1 << 18
#: Tokens for which a training task is worth its tables (6 MB); smaller partitions are read by one task.
TASK_TOKENS = 1 << 20
BLOCKS = 32
SALTS = 16
SMOOTH = 0.1
#: Words whose counts and places in the trees travel with the tasks (about 65 bytes each, so 17 MB). All others share one leaf a
#: class, which the features predict too; inside it they go by their counts, which are looked up by a join.
FREQUENT = 1 << 18
END = np.uint64(0x656E64)
START = np.uint64(0x737461)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, class and text of every token: the words with A-Z in lower case, and one end per text.

    A word's class comes from its last two bytes, so that it follows the language and the form of the word; 0 is the end.
    """
    raw = [t.encode().lower() for t in texts]
    data = b"\n".join(raw)
    key, start, stop = word_hashes(data)
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
    owner = np.searchsorted(begins, start, side="right") - 1
    view = np.frombuffer(data, np.uint8)
    kind = np.zeros(len(key), np.int64)
    if len(key):
        last = view[stop - 1].astype(np.uint64)
        before = np.where(stop - start > 1, view[np.maximum(stop - 2, 0)], 0).astype(np.uint64)
        kind = 1 + (mix64(last * np.uint64(256) + before) % np.uint64(CLASSES - 1)).astype(np.int64)
    at = np.searchsorted(owner, np.arange(len(texts)), side="right")
    return np.insert(key, at, END), np.insert(kind, at, 0), np.insert(owner, at, np.arange(len(texts)))


def history(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashed features of every token's history (tokens x 3): the word before, the word before that (a skip), and both."""
    one = np.full(len(key), START, np.uint64)
    one[1:] = np.where(owner[1:] == owner[:-1], key[:-1], START)
    two = np.full(len(key), START, np.uint64)
    two[2:] = np.where(owner[2:] == owner[:-2], key[:-2], START)
    parts = (one, mix64(two) ^ np.uint64(0x5A5A), one * np.uint64(0x9E3779B97F4A7C15) + two)
    return np.stack([mix64(p + np.uint64(i)) for i, p in enumerate(parts)], 1)


def _buckets(past: np.ndarray) -> np.ndarray:
    return (past % np.uint64(BUCKETS)).astype(np.int64)


def context(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The feature rows of every token's class (tokens x 3)."""
    return _buckets(history(key, owner))


def _scores(bias: np.ndarray, table: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Scores of all branches of each choice, the greatest at 0."""
    z = table.take(features[:, 0], 0)
    z += table.take(features[:, 1], 0)
    z += table.take(features[:, 2], 0)
    z += bias
    top = z
    while top.shape[1] > 1:
        top = np.maximum(top[:, : top.shape[1] // 2], top[:, top.shape[1] // 2 :])
    z -= top
    return z


def _totals(z: np.ndarray) -> np.ndarray:
    """Sums over the branches, as a matrix product: faster than a sum over so few."""
    return z @ np.ones(z.shape[1], z.dtype)


def _of_words(table: np.ndarray) -> np.ndarray:
    """The rows of the choices inside classes, which lie behind those of the classes."""
    return table[BUCKETS:].reshape(-1, BRANCHES)


def _log_softmax(bias: np.ndarray, table: np.ndarray, features: np.ndarray) -> np.ndarray:
    z = _scores(bias, table, features)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


@dataclass
class Trees:
    """The words inside every class. A leaf is a word of ``keys`` or, behind them, the other words of a class; its choices, from
    ``start`` on, are ``length`` nodes, each with the slot that is taken. ``bias`` has the log share of the counts per node and slot."""

    keys: np.ndarray
    first: np.ndarray
    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    slot: np.ndarray
    bias: np.ndarray

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key in ``keys``; -1 if it is not there. Keys are hashes, so their first bits say where to look."""
        at, end = self.first[(key >> _SHIFT).astype(np.int64)], self.first[(key >> _SHIFT).astype(np.int64) + 1]
        found, left = np.full(len(key), -1), np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == key[left]
            found[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return found

    def choices(self, found: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token, node and slot of every choice of the tokens, in their order."""
        leaf = np.where(found >= 0, found, len(self.keys) + kind)
        n = self.length[leaf]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[leaf] - ends + n, n)
        return np.repeat(np.arange(len(leaf)), n), self.node[at], self.slot[at]


_PREFIX = 20
_SHIFT = np.uint64(64 - _PREFIX)


def grow_trees(keys: np.ndarray, frequencies: np.ndarray, kinds: np.ndarray, rest: np.ndarray) -> Trees:
    """Huffman trees over the sorted ``keys`` of each class and one leaf for its other words, of mass ``rest``
    per class; the end of a text has no choice."""
    up, slot_of, shares = np.full(len(keys) + CLASSES, -1), np.zeros(len(keys) + CLASSES, np.int64), []
    parents: list[tuple[int, int]] = []  # of every node: the node above (-1: none) and its slot there
    for k in range(1, CLASSES):
        own = np.flatnonzero(kinds == k)
        heap = [(float(w), int(i), True) for w, i in zip(frequencies[own], own, strict=True)] + [(float(rest[k]), len(keys) + k, True)]
        heapify(heap)
        take = (len(heap) - 2) % (BRANCHES - 1) + 2  # the first node may have fewer branches, so that all others are full
        while len(heap) > 1:
            parts, number = [heappop(heap) for _ in range(take)], len(parents)
            for j, (_, i, leaf) in enumerate(parts):
                if leaf:
                    up[i], slot_of[i] = number, j
                else:
                    parents[i] = (number, j)
            parents.append((-1, 0))
            weights = np.array([w for w, *_ in parts])
            shares.append(np.concatenate([np.log(weights / weights.sum()), np.full(BRANCHES - len(parts), -1e9)]))
            heappush(heap, (float(weights.sum()), number, False))
            take = BRANCHES
    above, slot_above = (np.array([p[j] for p in parents], np.int64) for j in (0, 1))
    levels, leaf, at, slot = [], np.flatnonzero(up >= 0), up[up >= 0], slot_of[up >= 0]
    while len(leaf):
        levels.append((leaf, at, slot))
        keep = above[at] >= 0
        leaf, at, slot = leaf[keep], above[at[keep]], slot_above[at[keep]]
    leaves, nodes, slots = (np.concatenate([x[j] for x in levels]) if levels else np.zeros(0, np.int64) for j in range(3))
    order = np.argsort(leaves, kind="stable")
    length = np.bincount(leaves, minlength=len(up))
    first = np.searchsorted(keys >> _SHIFT, np.arange((1 << _PREFIX) + 1, dtype=np.uint64)).astype(np.int32)
    bias = np.array(shares, np.float32).reshape(-1, BRANCHES)
    return Trees(keys, first, np.cumsum(length) - length, length, nodes[order].astype(np.int32), slots[order].astype(np.int8), bias)


def _rows(past: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The feature rows of choices: the history of the token, crossed with the node."""
    mixed = past ^ (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed >>= np.uint64(40)
    mixed &= np.uint64(WORD_BUCKETS - 1)
    return mixed.astype(np.int64)


def _taken(bias: np.ndarray, table: np.ndarray, features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The log probability of the branch that each choice takes."""
    z = _scores(bias, table, features)
    own = z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + y]
    return own - np.log(_totals(np.exp(z, out=z)))


def _long_step(bias: np.ndarray, table: np.ndarray, squares: np.ndarray, f: np.ndarray, y: np.ndarray) -> None:
    """An AdaGrad step that touches most feature rows, so gradients are added up in an array of all of them. Changes table and
    squares."""
    error, gradient = np.empty((table.shape[1], len(y))), np.empty_like(table)
    for i in range(0, len(y), STEP):  # the scores of a part stay in the cache
        z = _scores(bias[i : i + STEP] if bias.ndim > 1 else bias, table, f[i : i + STEP])
        np.exp(z, out=z)
        z /= _totals(z)[:, None]
        z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + y[i : i + STEP]] -= 1
        error[:, i : i + STEP] = z.T
    flat, weights = f.T.ravel(), np.empty((3, len(y)))
    for c, column in enumerate(error):
        weights[:] = column
        gradient[:, c] = np.bincount(flat, weights.reshape(-1), len(table))
    squares += gradient * gradient
    root = squares + np.float32(1)
    np.sqrt(root, out=root)
    gradient *= np.float32(RATE)
    gradient /= root
    table -= gradient


def _step(bias: np.ndarray, table: np.ndarray, squares: np.ndarray, f: np.ndarray, y: np.ndarray) -> None:
    """An AdaGrad step; only the feature rows that occur are touched. Changes table and squares."""
    error = np.exp(_log_softmax(bias, table, f))
    error[np.arange(len(y)), y] -= 1
    flat = f.reshape(-1)
    order = np.argsort(flat.astype(np.uint16), kind="stable")  # 16 bits: a radix sort
    ordered = flat[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    rows, order = ordered[first], order // 3
    gradient = np.empty((len(rows), CLASSES), np.float32)
    for c, column in enumerate(np.ascontiguousarray(error.T)):  # a column stays in the cache
        gradient[:, c] = np.add.reduceat(column[order], first)
    grown = squares[rows] + gradient * gradient
    squares[rows] = grown
    table[rows] -= RATE * gradient / np.sqrt(grown + 1.0)


def learn_chunk(bias: np.ndarray, table: np.ndarray, squares: np.ndarray, texts: list[str], trees: Trees | None = None) -> int:
    """AdaGrad steps over the texts: of their classes alone, ``STEP`` tokens each, or with ``trees`` of the classes and of the choices
    inside them, ``LONG_STEP`` of either at a time. Changes its arrays."""
    key, kind, owner = tokens(texts)
    past = history(key, owner)
    features = _buckets(past)
    if not trees:
        for i in range(0, len(key), STEP):
            _step(bias, table, squares, features[i : i + STEP], kind[i : i + STEP])
    else:
        for i in range(0, len(key), LONG_STEP):
            part = slice(i, i + LONG_STEP)
            _long_step(bias, table[:BUCKETS], squares[:BUCKETS], features[part], kind[part])
        token, node, slot = trees.choices(trees.find(key), kind)
        for i in range(0, len(token), LONG_STEP):
            part = slice(i, i + LONG_STEP)
            _long_step(trees.bias.take(node[part], 0), _of_words(table), _of_words(squares), _rows(past.take(token[part], 0), node[part]), slot[part])
    return len(key)


def _train_pass(docs: DataFrame, bias: np.ndarray, table: np.ndarray, trees: Trees) -> np.ndarray:
    """One pass over all training texts: every task takes gradient steps on its own texts, the tables are averaged with the
    tokens as weights. Blocks of the table are summed in two levels, so no task gets the tables of all others."""
    sent = docs.sparkSession.sparkContext.broadcast((bias, table, trees))

    def run(frames):
        bias, start, trees = sent.value
        table, squares, n = start.copy(), np.zeros_like(start), 0
        for frame in frames:
            for _, texts in chunks(frame):
                n += learn_chunk(bias, table, squares, texts, trees)
        if n:
            part = np.array_split(table.astype(np.float64) * n, BLOCKS)
            salt = TaskContext.get().partitionId() % SALTS
            yield pd.DataFrame({"block": range(BLOCKS), "salt": salt, "n": n, "data": [p.astype(np.float32).tobytes() for p in part]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        data = np.sum([np.frombuffer(x, np.float32).astype(np.float64) for x in frame["data"]], axis=0)
        return pd.DataFrame({"block": frame["block"][:1], "salt": 0, "n": [frame["n"].sum()], "data": [data.astype(np.float32).tobytes()]})

    schema = "block int, salt int, n long, data binary"
    once = docs.select("text").mapInPandas(run, schema).groupBy("block", "salt").applyInPandas(add, schema)
    rows = sorted(once.groupBy("block").applyInPandas(add, schema).collect(), key=lambda r: r["block"])
    sent.unpersist()
    if not rows:
        return table
    return np.concatenate([np.frombuffer(r["data"], np.float32) / r["n"] for r in rows]).reshape(table.shape).astype(np.float32)


def _count(frames):
    for frame in frames:
        for _, texts in chunks(frame):
            key, kind, _ = tokens(texts)
            keys, first, n = np.unique(key, return_index=True, return_counts=True)
            yield pd.DataFrame({"key": keys.view(np.int64), "kind": kind[first], "n": n})


@dataclass
class Model:
    """``counts`` (key, kind, c) stays a stored table; the rest is bounded by classes, buckets and ``FREQUENT``."""

    counts: DataFrame
    total: int
    distinct: int
    rest: np.ndarray
    frequencies: np.ndarray
    trees: Trees
    bias: np.ndarray
    table: np.ndarray


def fit(docs: DataFrame, passes: int = PASSES) -> Model:
    """Count all tokens of the training texts (``text``; null: empty) and train on all of them."""
    counts = stored(docs.select("text").mapInPandas(_count, "key long, kind long, n long").groupBy("key", "kind").agg(F.sum("n").alias("c")), "counts")
    classes = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n = np.array([classes.get(k, (0, 0))[0] for k in range(CLASSES)], float)
    v = np.array([classes.get(k, (0, 0))[1] for k in range(CLASSES)], float)
    top = counts.orderBy(F.desc("c"), "key").select("key", "kind", "c").limit(FREQUENT).toArrow()
    keys, kinds, frequencies = top["key"].to_numpy().astype(np.int64).view(np.uint64), top["kind"].to_numpy().astype(np.int64), top["c"].to_numpy().astype(np.float64)
    order = np.argsort(keys)
    keys, kinds, frequencies = keys[order], kinds[order], frequencies[order]
    rest = n - np.bincount(kinds, frequencies, CLASSES) + SMOOTH * (v - np.bincount(kinds, minlength=CLASSES) + 1)
    trees = grow_trees(keys, frequencies, kinds, rest)
    bias = np.log((n + 1) / (n.sum() + CLASSES)).astype(np.float32)
    docs = docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, int(n.sum()) // TASK_TOKENS))
    table = np.zeros((BUCKETS + WORD_BUCKETS * BRANCHES // CLASSES, CLASSES), np.float32)
    for _ in range(passes):
        table = _train_pass(docs, bias, table, trees)
    return Model(counts, int(n.sum()), int(v.sum()), np.log10(rest), frequencies, trees, bias, table)


def log_probabilities(bias: np.ndarray, table: np.ndarray, trees: Trees, past: np.ndarray, found: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Per token the log probability of its class and of the choices that lead to its leaf, given its history."""
    logs, features = np.empty(len(kind)), _buckets(past)
    for i in range(0, len(kind), STEP):
        logs[i : i + STEP] = _taken(bias, table[:BUCKETS], features[i : i + STEP], kind[i : i + STEP])
    token, node, slot = trees.choices(found, kind)
    for i in range(0, len(token), STEP):
        part = slice(i, i + STEP)
        logs += np.bincount(token[part], _taken(trees.bias.take(node[part], 0), _of_words(table), _rows(past.take(token[part], 0), node[part]), slot[part]), len(logs))
    return logs


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for every row of ``docs`` (``doc_id, text``).

    ``score`` is the log10 probability of the text: of each token's class given its history times the token given its class and
    its history (a softmax per choice). Words beyond the most frequent ones are one leaf of their class, times their share of
    its smoothed counts. ``base_score`` is the smoothed unigram model. Counts and choices of the most frequent words
    travel with the tasks, a bounded table; the other words are joined to the stored counts by key. Partial sums and these words
    are written once with a row number, so repeated and null ids are rows of their own. Null and empty texts are one end
    token. Other columns are ignored; without training tokens every token is unknown.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.frequencies, model.trees, model.rest, model.bias, model.table))

    def run(frames):
        frequencies, trees, rest, bias, table = sent.value
        row = TaskContext.get().partitionId() << 33
        for frame in frames:
            for part, texts in chunks(frame):
                key, kind, owner = tokens(texts)
                past, n = history(key, owner), len(texts)
                at = trees.find(key)
                hit = at >= 0
                logs = log_probabilities(bias, table, trees, past, at, kind) / np.log(10) - np.where(hit, 0.0, rest[kind])
                found = np.ones(len(key))
                found[hit] = frequencies[at[hit]]
                others, of = key[~hit], owner[~hit]
                cuts = np.searchsorted(of, np.arange(n + 1))
                yield pd.DataFrame({
                    "row": np.arange(row, row + n), "doc_id": part["doc_id"].astype("Int64").to_numpy(object),
                    "n_tokens": np.bincount(owner, minlength=n), "known": np.bincount(owner[hit], minlength=n),
                    "logs": np.bincount(owner, np.where(hit, np.log10(found + SMOOTH), 0.0), n),
                    "model": np.bincount(owner, logs, n),
                    "others": [others[a:b].view(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                })
                row += n

    schema = "row long, doc_id long, n_tokens long, known long, logs double, model double, others array<long>"
    rows = stored(docs.select("doc_id", "text").mapInPandas(run, schema), "scores")
    rare = rows.select("row", F.explode("others").alias("key")).join(model.counts.select("key", "c"), "key", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("more"), F.count("c").alias("seen"))
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    base = logs - F.col("n_tokens") * F.log10(F.lit(model.total + SMOOTH * (model.distinct + 1)))
    return rows.drop("others").join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        base.alias("base_score"), (F.coalesce("more", F.lit(0.0)) + F.col("model")).alias("score"),
    )


def op9(spark, folder):
    docs = documents(spark, folder)
    model = fit(docs.where(fold(10) != 0))
    return score(docs, model).select("doc_id", (fold(10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
