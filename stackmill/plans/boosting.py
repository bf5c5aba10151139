"""Second-order gradient boosting of trees for a binary label.

Features are cut into bins at sketched quantiles, and the rows are packed into blocks, each a row of one stored table. A tree
grows level by level: every block adds up gradients and Hessians per (node, feature, bin), Spark adds the blocks' sums, and one
group per node picks its split. A node whose rows fit into one block leaves the levels: its rows meet in one task, which grows
the rest of its subtree. A table that is one block is such a node from the start, for all trees. Gradients are rounded to
fixed point, so sums do not depend on the order of rows or blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from math import ceil, log
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.session import stored

#: Rows of a block, bins of a feature, and rounds after which the margins of the blocks are written anew.
BLOCK, BINS, REFRESH = 1 << 16, 256, 20

#: Fixed point of gradients and Hessians, and the least gain of a split.
UNIT, LEAST_GAIN = float(1 << 24), 1e-6


@dataclass(frozen=True)
class Rules:
    """``newton``: splits gain by Hessians (else by row counts, as for squared residuals; leaves are Newton steps either way).
    ``prior``: start from the log-odds of the labels instead of 0."""

    trees: int
    depth: int
    step: float
    subsample: float = 1.0
    ridge: float = 1.0
    least_hessian: float = 1.0
    newton: bool = True
    prior: bool = False
    seed: int = 1


@dataclass
class Tree:
    """Nodes as arrays: inner ones send a row to ``left`` if its bin is at most ``cut``, else to ``left + 1``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> int:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        self.feature += [-1, -1]
        self.cut += [0, 0]
        self.left += [0, 0]
        self.value += [0.0, 0.0]
        return self.left[node]

    def graft(self, node: int, other: Tree) -> None:
        """Put another tree in the place of a leaf."""
        at = {0: node}
        for k in range(len(other.feature)):
            self.value[at[k]] = other.value[k]
            if other.feature[k] >= 0:
                first = self.split(at[k], other.feature[k], other.cut[k])
                at[other.left[k]], at[other.left[k] + 1] = first, first + 1

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The node each row of bins ends in."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at = np.zeros(len(bins), np.int64)
        while len(open_rows := np.flatnonzero(feature[at] >= 0)):
            node = at[open_rows]
            at[open_rows] = left[node] + (bins[open_rows, feature[node]] > cut[node])
        return at


def _sums(bins: np.ndarray, g: np.ndarray, h: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
    """(slots, features, bins, 3): sums of gradients, Hessians and rows. Slot -1 is left out; all sums are whole numbers."""
    rows = np.flatnonzero(slot >= 0)
    d = bins.shape[1]
    cell = ((slot[rows, None] * d + np.arange(d)) * BINS + bins[rows]).ravel()
    size = slots * d * BINS
    parts = [np.bincount(cell, np.repeat(v[rows], d), size) for v in (g, h)]
    return np.stack([*parts, np.bincount(cell, minlength=size).astype(float)], -1).reshape(slots, d, BINS, 3)


def best_splits(sums: np.ndarray, rules: Rules) -> list[tuple | None]:
    """Per slot (feature, bin, left sums, right sums) of the best split, the first of equal ones; None where none gains."""
    left = np.cumsum(sums, 2)[:, :, :-1]
    total = sums.sum(2)[:, :1, None]
    right = total - left

    def worth(x):
        weight = x[..., 1] / UNIT if rules.newton else x[..., 2]
        return (x[..., 0] / UNIT) ** 2 / np.maximum(weight + rules.ridge, 1e-16)

    gain = worth(left) + worth(right) - worth(total)
    ok = (left[..., 2] >= 1) & (right[..., 2] >= 1)
    if rules.newton:
        ok &= (left[..., 1] >= rules.least_hessian * UNIT) & (right[..., 1] >= rules.least_hessian * UNIT)
    gain = np.where(ok, gain, -np.inf).reshape(len(sums), -1)
    at = gain.argmax(1)
    out: list[tuple | None] = []
    for s, k in enumerate(at.tolist()):
        f, b = divmod(k, BINS - 1)
        out.append((f, b, left[s, f, b], right[s, f, b]) if gain[s, k] > LEAST_GAIN else None)
    return out


def _value(sums: np.ndarray, rules: Rules) -> float:
    return float(-rules.step * sums[0] / max(sums[1] + rules.ridge * UNIT, 1e-16 * UNIT))


#: Cells of sums that one step works on.
CELLS = 1 << 22


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, rules: Rules, depth: int) -> Tree:
    """A whole tree over the rows of one block."""
    tree = Tree()
    tree.value[0] = _value(np.array([g.sum(), h.sum()]), rules)
    at, frontier = np.zeros(len(bins), np.int64), [0]
    per_step = max(1, CELLS // (bins.shape[1] * BINS)) if bins.shape[1] else 1
    for _ in range(depth if bins.shape[1] else 0):
        following = []
        slot_of = np.full(len(tree.feature), -1)
        for start in range(0, len(frontier), per_step):
            part = frontier[start : start + per_step]
            slot_of[:] = -1
            slot_of[part] = np.arange(len(part))
            for node, found in zip(part, best_splits(_sums(bins, g, h, slot_of[at], len(part)), rules), strict=True):
                if found:
                    first = tree.split(node, found[0], found[1])
                    tree.value[first], tree.value[first + 1] = _value(found[2], rules), _value(found[3], rules)
                    following += [k for k, s in ((first, found[2]), (first + 1, found[3])) if s[2] > 1]
        feature, cut, left = np.array(tree.feature), np.array(tree.cut), np.array(tree.left)
        moved = np.flatnonzero(feature[at] >= 0)
        node = at[moved]
        at[moved] = left[node] + (bins[moved, feature[node]] > cut[node])
        frontier = following
        if not frontier:
            break
    return tree


def gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted log-loss, in fixed point."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint(weight * (p - label) * UNIT), np.rint(weight * np.maximum(p * (1 - p), 1e-16) * UNIT)


def chosen(rules: Rules, tree: int, block: int, rows: int) -> np.ndarray:
    """The rows of a block that a tree learns from."""
    return np.ones(rows, bool) if rules.subsample >= 1 else np.random.default_rng([rules.seed, tree, block]).random(rows) < rules.subsample


def boost_block(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, start: float, rules: Rules, block: int = 0) -> list[Tree]:
    """All trees over the rows of one block."""
    margin, out = np.full(len(bins), start), []
    for t in range(rules.trees):
        g, h = gradients(margin, label, weight)
        use = chosen(rules, t, block, len(bins))
        tree = grow(bins[use], g[use], h[use], rules, rules.depth)
        margin = margin + np.array(tree.value)[tree.leaf(bins)]
        out.append(tree)
    return out


def bin_edges(rows: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the sorted distinct values at up to ``bins - 1`` evenly spaced quantiles (a mergeable sketch, one row per
    feature); a row's bin is the number of edges below its value."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.select(F.posexplode("features").alias("pos", "x")).where("x IS NOT NULL AND NOT isnan(x)").groupBy("pos").agg(F.percentile_approx("x", shares, 20 * bins).alias("edges"))
    by = {r["pos"]: np.unique(r["edges"]) for r in found.toLocalIterator()}
    return [by.get(k, np.zeros(0)) for k in range(max(by, default=-1) + 1)]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of a matrix of rows; what is not a number lies above all edges."""
    return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], 1).astype(np.uint8) if edges else np.zeros((len(x), 0), np.uint8)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), width)


_PARTS = (("label", np.float64), ("weight", np.float64), ("margin", np.float64))


def packed_blocks(rows: DataFrame, width: int, n: int, size: int, encode: Callable[[np.ndarray], bytes], start: float = 0.0) -> DataFrame:
    """The ``n`` rows packed into blocks of at most ``size`` (``block, bins, label, weight, margin``), in the order of their
    values; ``encode`` turns the matrix of a block into the bytes of ``bins``."""

    def pack(batches):
        base, held = TaskContext.get().partitionId() << 32, []

        def block(parts):
            x, y, w = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.lexsort([y, w, *x.T[::-1]])
            cells = [base, encode(x[order]), y[order].tobytes(), w[order].tobytes(), np.full(len(y), start).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], ["block", "bins", "label", "weight", "margin"])

        count = 0
        for b in batches:
            part = (_matrix(b.column(2), width), b.column(0).to_numpy(), b.column(1).to_numpy())
            for a in range(0, b.num_rows, size):
                piece = tuple(v[a : a + size] for v in part)
                if held and count + len(piece[1]) > size:
                    yield block(held)
                    base, held, count = base + 1, [], 0
                held.append(piece)
                count += len(piece[1])
        if held:
            yield block(held)

    ready = rows.select(F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), F.col("features").cast("array<double>").alias("features"))
    return ready.repartition(max(1, ceil(n / size))).mapInArrow(pack, "block long, bins binary, label binary, weight binary, margin binary")


def _read(batches, d: int) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
    for b in batches:
        for r in b.to_pylist():
            yield r["block"], np.frombuffer(r["bins"], np.uint8).reshape(-1, d), {k: np.frombuffer(r[k], t) for k, t in _PARTS}


def _now(bins: np.ndarray, margin: np.ndarray, recent: list[Tree]) -> np.ndarray:
    for tree in recent:
        margin = margin + np.array(tree.value)[tree.leaf(bins)]
    return margin


def _level(blocks: DataFrame, d: int, tree: Tree, nodes: list[int], recent: list[Tree], rules: Rules, t: int) -> dict[int, tuple]:
    """Of every node its sums and its best split: partial sums per block, added per (node, feature, bin), judged per node."""

    def partial(batches):
        slot_of = np.full(len(tree.feature), -1)
        slot_of[nodes] = np.arange(len(nodes))
        for block, bins, r in _read(batches, d):
            g, h = gradients(_now(bins, r["margin"], recent), r["label"], r["weight"])
            slot = np.where(chosen(rules, t, block, len(bins)), slot_of[tree.leaf(bins)], -1)
            for s in np.unique(slot[slot >= 0]):  # a node at a time bounds the memory
                sums = _sums(bins, g, h, np.where(slot == s, 0, -1), 1)[0]
                f, b = np.nonzero(sums[..., 2])
                cells = sums[f, b].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), nodes[s])), pa.array(f), pa.array(b), *(pa.array(c) for c in cells.T)], ["node", "feature", "bin", "g", "h", "n"])

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((1, d, BINS, 3))
        sums[0, frame["feature"], frame["bin"]] = frame[["g", "h", "n"]]
        return pd.DataFrame({"node": frame["node"][:1], "found": [pickle.dumps((sums[0, 0].sum(0), best_splits(sums, rules)[0]))]})

    added = blocks.mapInArrow(partial, "node long, feature long, bin long, g long, h long, n long").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    return {r["node"]: pickle.loads(bytes(r["found"])) for r in added.groupBy("node").applyInPandas(judge, "node long, found binary").toLocalIterator()}


def _finish(blocks: DataFrame, d: int, tree: Tree, depths: dict[int, int], recent: list[Tree], rules: Rules, t: int) -> None:
    """Grow the subtrees of small nodes, each in one task over the rows of the node."""

    def rows_of(batches):
        wanted = np.zeros(len(tree.feature), bool)
        wanted[list(depths)] = True
        for block, bins, r in _read(batches, d):
            g, h = gradients(_now(bins, r["margin"], recent), r["label"], r["weight"])
            node = tree.leaf(bins)
            use = np.flatnonzero(chosen(rules, t, block, len(bins)) & wanted[node])
            yield pa.RecordBatch.from_arrays([pa.array(node[use]), pa.array([b.tobytes() for b in bins[use]], pa.binary()), pa.array(g[use].astype(np.int64)), pa.array(h[use].astype(np.int64))], ["node", "bins", "g", "h"])

    def subtree(frame: pd.DataFrame) -> pd.DataFrame:
        bins = np.frombuffer(b"".join(frame["bins"]), np.uint8).reshape(-1, d)
        grown = grow(bins, frame["g"].to_numpy(float), frame["h"].to_numpy(float), rules, depths[int(frame["node"].iloc[0])])
        return pd.DataFrame({"node": frame["node"][:1], "tree": [pickle.dumps((grown.feature, grown.cut, grown.left, grown.value))]})

    found = blocks.mapInArrow(rows_of, "node long, bins binary, g long, h long").groupBy("node").applyInPandas(subtree, "node long, tree binary")
    for r in sorted(found.toLocalIterator(), key=lambda r: r["node"]):
        tree.graft(r["node"], Tree(*pickle.loads(bytes(r["tree"]))))


def _one_tree(blocks: DataFrame, d: int, recent: list[Tree], rules: Rules, t: int) -> Tree:
    tree, frontier, small = Tree(), [0], {}
    for level in range(rules.depth):
        found = _level(blocks, d, tree, frontier, recent, rules, t)
        following = []
        for node in frontier:
            if node not in found:
                continue
            sums, split = found[node]
            tree.value[node] = _value(sums, rules)
            if split:
                first = tree.split(node, split[0], split[1])
                for k, s in ((first, split[2]), (first + 1, split[3])):
                    tree.value[k] = _value(s, rules)
                    if s[2] > BLOCK:
                        following.append(k)
                    elif s[2] > 1 and level + 1 < rules.depth:
                        small[k] = rules.depth - level - 1
        frontier = following
        if not frontier:
            break
    if small:
        _finish(blocks, d, tree, small, recent, rules, t)
    return tree


def _with_margins(blocks: DataFrame, d: int, recent: list[Tree]) -> DataFrame:
    def run(batches):
        for b in batches:
            margins = [_now(bins, r["margin"], recent).tobytes() for _, bins, r in _read([b], d)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(margins, pa.binary())], ["block", "bins", "label", "weight", "margin"])

    return stored(blocks.mapInArrow(run, blocks.schema), "boosting-blocks")


@dataclass
class Boosted:
    """Trees whose cuts are values again: node arrays of all trees one behind the other, scored in Arrow batches."""

    kind: str
    width: int
    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            while len(rows := np.flatnonzero(self.feature[at] >= 0)):
                node = at[rows]
                at[rows] = self.left[node] + ~(x[rows, self.feature[node]] <= self.threshold[node])
            out += self.value[at]
        return out

    def score(self, df: DataFrame, prob: str = "prob") -> DataFrame:
        """Add the probability of the positive class; null where the vector is null or of another width. A narrow step."""
        sent, width = df.sparkSession.sparkContext.broadcast(self), self.width

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            ok = x.map(lambda v: v is not None and len(v) == width)
            out = pd.Series(np.nan, index=x.index)
            if ok.any():
                out[ok] = 1 / (1 + np.exp(-sent.value.margins(np.array(x[ok].tolist(), float).reshape(-1, width))))
            return out.astype(object).where(ok, None)

        kept = [c for c in df.columns if c != prob]
        return df.withColumn(prob, run(F.col("features").cast("array<double>"))).select(*kept, prob)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        root = np.zeros(len(self.feature), bool)
        root[self.roots] = True
        nodes = pd.DataFrame({"node": np.arange(len(root)), "root": root, "feature": self.feature, "threshold": self.threshold, "left": self.left, "value": self.value})
        spark.createDataFrame(nodes, "node long, root boolean, feature long, threshold double, left long, value double").write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(self.kind, self.width, self.start)], "kind string, width int, start double").write.mode("overwrite").json(f"{path}/boosted")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        row = spark.read.schema("kind string, width int, start double").json(f"{path}/boosted").first()
        n = spark.read.parquet(f"{path}/trees").toPandas().sort_values("node")
        return cls(row["kind"], row["width"], row["start"], np.flatnonzero(n["root"]), *(n[c].to_numpy() for c in ("feature", "threshold", "left", "value")))


def flattened(kind: str, trees: list[Tree], edges: list[np.ndarray], start: float) -> Boosted:
    feature = np.concatenate([np.array(t.feature) for t in trees])
    ends = np.cumsum([0, *(len(t.feature) for t in trees)])
    left = np.concatenate([np.array(t.left) + a for t, a in zip(trees, ends, strict=False)])
    cut = np.concatenate([np.array(t.cut) for t in trees])
    # a cut behind the last edge keeps every number left, and what is no number right
    threshold = np.array([(edges[f][c] if c < len(edges[f]) else np.inf) if f >= 0 else 0.0 for f, c in zip(feature.tolist(), cut.tolist(), strict=True)])
    return Boosted(kind, len(edges), start, ends[:-1], feature, threshold, left, np.concatenate([np.array(t.value) for t in trees]))


def fit_boosted(kind: str, rows: DataFrame, params: Mapping[str, Any], width: int, seed: int = 1) -> Boosted:
    """Fit on ``label, weight, features``; rows whose vector is null or not ``width`` long are left out. ``params``: step, trees,
    depth, and subsample, ridge, least_hessian, newton, prior where they differ from the defaults of ``Rules``."""
    names = ("trees", "depth", "step", "subsample", "ridge", "least_hessian", "newton", "prior")
    rules = replace(Rules(1, 1, 1.0), seed=seed, **{k: params[k] for k in names if k in params})
    usable = rows.where(F.col("features").isNotNull() & (F.size("features") == width) & F.col("label").isNotNull())
    usable = usable.withColumn("features", F.transform(F.col("features").cast("array<double>"), lambda x: F.coalesce(x, F.lit(float("nan")))))
    edges = bin_edges(usable)
    edges += [np.zeros(0)] * (width - len(edges))
    total = usable.agg(F.count("*").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("p"), F.sum("weight").alias("w")).first()
    positive, weight = total["p"] or 0.0, total["w"] or 0.0
    start = log(positive / (weight - positive)) if rules.prior and 0 < positive < weight else 0.0
    if not total["n"]:
        return flattened(kind, [Tree()], edges, start)
    blocks = stored(packed_blocks(usable, width, total["n"], BLOCK, lambda x: binned(x, edges).tobytes(), start), "boosting-blocks")
    if total["n"] <= BLOCK:

        def whole(batches):
            for block, bins, r in _read(batches, width):
                grown = boost_block(bins, r["label"], r["weight"], start, rules, block)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([(t.feature, t.cut, t.left, t.value) for t in grown])], pa.binary())], ["trees"])

        found = blocks.mapInArrow(whole, "trees binary").first()
        return flattened(kind, [Tree(*t) for t in pickle.loads(bytes(found["trees"]))], edges, start)
    trees, recent = [], []
    for t in range(rules.trees):
        recent.append(_one_tree(blocks, width, recent, rules, t))
        trees.append(recent[-1])
        if len(recent) == REFRESH:
            blocks, recent = _with_margins(blocks, width, recent), []
    return flattened(kind, trees, edges, start)
