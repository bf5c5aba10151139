"""Runs of repeated words: suffix trees of a stretch and of its reversal give constant-time extensions of Lyndon roots."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackmill.llm.common import CHUNK, WORD, documents, id_text, mix64

#: A run repeats its period this often at least and is at least so long.
REPEATS, SHORTEST = 4, 6

#: Bits of the table that counts windows before they are sorted.
CELLS = 20


def suffix_tree(word: list[int]) -> tuple[list[int], list[int], list[dict[int, int]], list[int]]:
    """Ukkonen's construction for a sequence whose last symbol occurs once: of every node the place in ``word`` where its
    edge begins, its depth in symbols, its children by first symbol, and of every leaf the suffix it stands for (-1 inside).

    The place of the next insertion is kept as a node above it and the number of symbols below that node.
    """
    n = len(word)
    begin, end, link, child, suffix = [0], [0], [0], [{}], [-1]
    node = below = made = 0
    for i in range(n):
        symbol, inner = word[i], -1
        while made <= i:
            if below:  # walk down while the symbols below cover a whole edge
                edge = child[node][word[i - below]]
                size = (end[edge] or i) - begin[edge]
                if below >= size:
                    node = edge
                    below -= size
                    continue
                split_at = begin[edge] + below
                if word[split_at] == symbol:
                    if inner >= 0:
                        link[inner] = node
                    below += 1
                    break
                new = len(begin)  # cut the edge
                begin.append(begin[edge])
                end.append(split_at)
                link.append(0)
                suffix.append(-1)
                child.append({word[split_at]: edge, symbol: new + 1})
                child[node][word[begin[edge]]] = new
                begin[edge] = split_at
                if inner >= 0:
                    link[inner] = new
                inner = new
            else:
                if inner >= 0:
                    link[inner] = node
                    inner = -1
                if symbol in child[node]:
                    below = 1
                    break
                child[node][symbol] = len(begin)
            begin.append(i)  # a leaf: its edge ends with the sequence
            end.append(0)
            link.append(0)
            child.append(None)
            suffix.append(made)
            made += 1
            if node:
                node = link[node]
            elif below:
                below -= 1
    return begin, end, child, suffix


class Extensions:
    """Longest common extensions of two suffixes: lowest common ancestors by range minima over the Euler tour.

    The tour lists leaves, and an inner node whenever the walk is back at it between two children; entries and last visits of
    inner nodes lie outside every range between two leaves, so they are left out. Children are walked in the order of their
    symbols only if ``ranked``; then ``first`` ranks the suffixes.
    """

    def __init__(self, word: list[int], ranked: bool = False):
        begin, end, child, suffix = suffix_tree(word)
        n = len(word)
        tour, first = [], [0] * n
        stack, depths = [0], [0]
        while stack:
            node, depth = stack.pop(), depths.pop()
            if node < 0:  # back at an inner node
                tour.append(depth)
                continue
            below = child[node]
            if below is None:
                first[suffix[node]] = len(tour)
                tour.append(n)
                continue
            if node:
                depth += end[node] - begin[node]
            kids = list(below.values()) if not ranked else [below[x] for x in sorted(below, reverse=True)]
            last = kids.pop()
            for kid in kids:
                stack += (kid, -1)
                depths += (depth, depth)
            if child[last] is None:
                first[suffix[last]] = len(tour)
                tour.append(n)
            else:
                stack.append(last)
                depths.append(depth)
        self.first = np.array(first)
        levels = len(tour).bit_length()
        self.table = np.empty((levels, len(tour)), np.int32)
        self.table[0] = tour
        for k in range(1, levels):
            step, last = 1 << (k - 1), self.table[k - 1]
            self.table[k] = last
            np.minimum(last[:-step], last[step:], out=self.table[k, :-step])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of suffixes ``a`` and ``b`` (different ones), for whole arrays."""
        x, y = self.first[a], self.first[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        return np.minimum(self.table[level, low], self.table[level, high + 1 - (1 << level)]).astype(np.int64)


def _lyndon_ends(rank: list[int]) -> tuple[list[int], list[int]]:
    """Of every suffix the next one that is smaller, and the next one that is larger: the ends of the longest Lyndon words
    from there under an order of the symbols and under its reverse."""
    n = len(rank)
    smaller, larger = [n] * n, [n] * n
    down, up = [], []
    for i, r in enumerate(rank):
        while down and rank[down[-1]] > r:
            smaller[down.pop()] = i
        down.append(i)
        while up and rank[up[-1]] < r:
            larger[up.pop()] = i
        up.append(i)
    return smaller, larger


def runs_of(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal repetitions of at least ``REPEATS`` periods and ``SHORTEST`` symbols, sorted.
    Symbols are numbers from 0 below the length.

    Every run holds a Lyndon root, the longest Lyndon word from its place under one of the two orders of the symbols. So the
    2n candidates (place, root length) suffice: each is extended to the right with the tree of the sequence and to the left
    with the tree of its reversal.
    """
    n = len(word)
    if n < SHORTEST:
        return []
    ahead = Extensions([*word, -1], ranked=True)
    ends = np.concatenate([np.array(x[:n]) for x in _lyndon_ends(ahead.first.tolist())])
    i = np.tile(np.arange(n), 2)
    ok = ends < n
    i, q = i[ok], (ends - i)[ok]
    right = ahead(i, i + q)
    del ahead
    near = right >= q * (REPEATS - 2)  # the first root of a run has all but what is left of it behind it
    i, q, right = i[near], q[near], right[near]
    if not len(i):
        return []
    behind = Extensions([*word[::-1], -1])
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    left[inner] = behind(n - i[inner], n - i[inner] - q[inner])
    length = left + q + right
    ok = length >= np.maximum(SHORTEST, REPEATS * q)
    found = set(zip((i - left)[ok].tolist(), length[ok].tolist(), q[ok].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(symbols: np.ndarray, text_of: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the only stretches that can hold a run, for many texts one behind the other.

    Inside a run every window of three words occurs at least three times. So windows that occur less often in their stretch
    end it, until nothing changes; a stretch needs four windows. Windows are compared by a hash, which may only keep more.
    """
    if len(symbols) < SHORTEST:
        return []
    h = symbols.astype(np.uint64)
    key = mix64(mix64(mix64(h[:-2]) + h[1:-1]) + h[2:])
    key ^= mix64(text_of[:-2].astype(np.uint64))
    cell = (key >> np.uint64(64 - CELLS)).astype(np.int64)
    at = np.flatnonzero((np.bincount(cell)[cell] >= REPEATS - 1) & (text_of[:-2] == text_of[2:]))  # few of the other windows pass
    group = text_of[at].astype(np.uint64)
    while len(at):
        _, inverse, times = np.unique(key[at] ^ mix64(group + np.uint64(1)), return_inverse=True, return_counts=True)
        keep = times[inverse] >= REPEATS - 1
        left, owner = at[keep], group[keep]
        cut = np.ones(len(left), bool)
        cut[1:] = (np.diff(left) > 1) | (owner[1:] != owner[:-1])
        named = np.cumsum(cut)
        size = np.bincount(named, minlength=1)
        enough = size[named] >= SHORTEST - 2
        same = bool(keep.all() and enough.all()) and len(np.unique(named)) == len(np.unique(group))
        at, group = left[enough], named[enough].astype(np.uint64)
        if same:
            break
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    last = np.append(first[1:], len(at)) - 1
    return [(int(at[a]), int(at[b]) + 3) for a, b in zip(first, last, strict=True)]


def text_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of every text, given as words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ends = np.cumsum([len(t) for t in texts])
    number: dict[bytes, int] = {}
    symbols = np.fromiter(map(number.setdefault, chain.from_iterable(texts), count()), np.int64, int(ends[-1]) if len(ends) else 0)
    text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for a, b in stretches(symbols, text_of):
        t = int(text_of[a])
        base = a - int(ends[t]) + len(texts[t])
        _, ranks = np.unique(symbols[a:b], return_inverse=True)
        out[t] += [(base + s, n, q) for s, n, q in runs_of(ranks.tolist())]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]], int]]:
    """Cut a batch into pieces of about ``CHUNK`` bytes of text: first row, the words of the rows, end row."""
    held, size, first = [], 0, 0
    for k, t in enumerate(batch.column("text").to_pylist()):
        held.append((t or b"").split())
        size += len(t or b"")
        if size >= CHUNK:
            yield first, held, k + 1
            held, size, first = [], 0, k + 1
    if held:
        yield first, held, batch.num_rows


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs`` (``doc_id, text``; other columns are ignored): the runs
    of words as (start, length, period), ordered by start and period, and the text without the words that only repeat.

    A run is a stretch of words of at least four periods and six words that no neighbour extends. Null and empty texts have
    no words, no runs and an empty text; repeated rows give repeated results; whole texts are read, and the memory of a task
    grows with its longest text only. A map; nothing is shuffled."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUN), ("collapsed", pa.string())])

    def run(batches):
        for batch in batches:
            for first, texts, last in _batches(batch):
                found = text_runs(texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[first:last], pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], _RUN),
                    pa.array([without_repeats(t, r).decode() for t, r in zip(texts, found, strict=True)], pa.string())], schema=schema)

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where a tenth of the texts (crc32 of the id a multiple of ten) repeats a stretch of its words up to
    its end: a known number of planted runs for any corpus."""
    h = F.crc32(id_text())
    g = F.floor(h / 10)
    words = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("__w"), g.alias("__g"))
    n = F.size("__w")
    at = (F.col("__g") % n).cast("int")
    period = (1 + F.floor((n - at) / (3 + F.col("__g") % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("__w", at + 1, period), F.ceil((n - at) / period).cast("int"))), F.lit(1), n - at)
    return words.select("doc_id", F.when(F.col("__w").isNotNull() & (n > 0), F.array_join(F.concat(F.slice("__w", F.lit(1), at), tail), " ")).otherwise(F.col("text")).alias("text"))


def op12(spark, folder):
    found = periodic_runs(repeated_tails(documents(spark, folder)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
