"""Exact k nearest neighbours as a partitioned join.

Every training row belongs to the cell of its nearest pivot. A query is sent only to the cells that can hold one of its
k nearest rows: the distances to the pivots and the radii of the cells bound the k-th distance from above and every
cell's distance from below (triangle inequality), so nothing is lost. Cells and their queries are cut into blocks of a
fixed size; each block returns at most k rows per query, and a last top-k merges the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackmill.operators.ranks import top_rows
from stackmill.operators.scaling import scale

BLOCK_ROWS = 20_000
PLAIN_BLOCKS = 8  # up to this many training blocks per group, cells cost more than they save
MAX_PIVOTS = 512
PIVOT_BYTES = 64 * 1024 * 1024
PAIR_BATCH = 65_536
TILE_VALUES = 500_000
STRIP = 64  # training rows of which only the nearest counts when the k-th distance of a query is bounded
PATCH = (8, 4096)  # queries and training rows whose Manhattan distances grow together
QUERY_ROWS, ROUTED_ROWS = 1_024, 8_192  # queries judged, and copies of queries sent on, at a time


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list<double> column as a 2-d array."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _pair_distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    gap = a - b
    return np.abs(gap).sum(axis=1) if metric == "manhattan" else np.sqrt((gap * gap).sum(axis=1))


def _tile(x: np.ndarray, t: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances (squared for Euclid) of a tile and, per query, how far they may be off by rounding."""
    if metric == "manhattan":
        out, columns = np.zeros((len(x), len(t))), np.ascontiguousarray(t.T)
        gap = np.empty((PATCH[0], PATCH[1]))
        for a in range(0, len(x), PATCH[0]):  # a patch and its gaps stay in the cache for all features
            for b in range(0, len(t), PATCH[1]):
                part = out[a : a + PATCH[0], b : b + PATCH[1]]
                own = gap[: part.shape[0], : part.shape[1]]
                for j, c in enumerate(columns):
                    np.subtract(x[a : a + PATCH[0], j, None], c[None, b : b + PATCH[1]], out=own)
                    np.abs(own, out=own)
                    part += own
        return out, 1e-9 * (1.0 + out.max(axis=1, initial=0.0))
    xx, tt = (x * x).sum(axis=1), (t * t).sum(axis=1)
    rough = np.c_[-2.0 * x, xx, np.ones(len(x))] @ np.c_[t, np.ones(len(t)), tt].T  # one product, no further pass over the tile
    return rough, 1e-9 * (1e-9 + xx + tt.max(initial=0.0))


def _bound(rough: np.ndarray, k: int) -> np.ndarray:
    """Per query a value that at least k of its distances do not exceed: the k-th distance, or for many rows the k-th of the
    nearest rows of strips, which takes one cheap pass."""
    strips = rough.shape[1] // STRIP
    if strips >= 4 * k:
        nearest = np.fmin.reduce(rough[:, : strips * STRIP].reshape(len(rough), STRIP, strips), axis=1)
        found = np.partition(nearest, k - 1, axis=1)[:, k - 1]
        if not np.isnan(found).any():
            return found
    return np.partition(rough, k - 1, axis=1)[:, k - 1]


def block_top_k(
    x: np.ndarray, t: np.ndarray, t_id: np.ndarray, k: int, metric: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, training row, distance) of the k nearest rows of one block, ties to the smaller id.

    A matrix product finds the candidates; their distances are then computed from the differences.
    """
    k = min(k, len(t))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, TILE_VALUES // max(1, len(t)))
    for start in range(0, len(x), step):
        tile = x[start : start + step]
        rough, slack = _tile(tile, t, metric)
        row, col = np.divmod(np.flatnonzero(rough <= (_bound(rough, k) + slack)[:, None]), len(t))
        exact = np.empty(len(row))
        for s in range(0, len(row), PAIR_BATCH):
            part = slice(s, s + PAIR_BATCH)
            exact[part] = _pair_distance(tile[row[part]], t[col[part]], metric)
        order = np.lexsort((t_id[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        position = np.arange(len(row)) - np.searchsorted(row, row)
        keep = position < k
        found.append((row[keep] + start, col[keep], exact[keep]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _cells_of(x: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows to pivots, computed from the differences (the bounds must hold)."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = _pair_distance(x, p[None, :], metric)
    return out


class _Grouped:
    """Rows of a record batch by group key."""

    def __init__(self, batch: pa.RecordBatch, groups: Sequence[str]):
        self.keys = list(zip(*[batch.column(g).to_pylist() for g in groups], strict=True)) if groups else [()] * len(batch)

    def items(self) -> Iterator[tuple[tuple, np.ndarray]]:
        order: dict[tuple, list[int]] = {}
        for i, key in enumerate(self.keys):
            order.setdefault(key, []).append(i)
        for key, rows in order.items():
            yield key, np.asarray(rows)


def _assign(pivots: Broadcast, groups: Sequence[str], features: str, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(features))
            cell, gap = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for key, rows in _Grouped(batch, groups).items():
                d = _cells_of(x[rows], pivots.value[key], metric)
                cell[rows] = d.argmin(axis=1)
                gap[rows] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(gap)], names=[*batch.schema.names, "cell", "gap"]
            )

    return run


def _route(pivots: Broadcast, cells: Broadcast, groups: Sequence[str], features: str, metric: str, k: int):
    def needed(d: np.ndarray, key: tuple) -> np.ndarray:
        rows, near, far = cells.value[key]  # per pivot: rows, smallest and largest distance to the pivot
        reach = np.where(rows > 0, d + far, np.inf)
        order = np.argsort(reach, axis=1)
        enough = np.cumsum(rows[order], axis=1) >= min(k, rows.sum())
        kth = np.take_along_axis(np.take_along_axis(reach, order, 1), enough.argmax(axis=1)[:, None], 1)
        floor = np.maximum(np.maximum(d - far, near - d), 0.0)
        return (rows > 0) & (floor <= kth * (1 + 1e-9) + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(features))
            for key, rows in _Grouped(batch, groups).items():
                if key not in cells.value:
                    continue
                parts = [np.nonzero(needed(_cells_of(x[rows[a : a + QUERY_ROWS]], pivots.value[key], metric), key)) for a in range(0, len(rows), QUERY_ROWS)]
                row = np.concatenate([p[0] + k * QUERY_ROWS for k, p in enumerate(parts)])
                cell = np.concatenate([p[1] for p in parts])
                for at in range(0, len(row), ROUTED_ROWS):  # a query may go to many cells: its copies leave in pieces
                    picked = batch.take(pa.array(rows[row[at : at + ROUTED_ROWS]]))
                    yield pa.RecordBatch.from_arrays(
                        [*picked.columns, pa.array(cell[at : at + ROUTED_ROWS].astype(np.int32))], names=[*picked.schema.names, "cell"]
                    )

    return run


def _keyed(rows: list, groups: Sequence[str]) -> dict[tuple, list]:
    out: dict[tuple, list] = {}
    for r in rows:
        out.setdefault(tuple(r[g] for g in groups), []).append(r)
    return out


def _one_cell_each(queries: DataFrame, train: DataFrame) -> tuple[DataFrame, DataFrame]:
    return queries.withColumn("cell", F.lit(0)), train.withColumn("cell", F.lit(0))


def _affordable(train: DataFrame, n_groups: int) -> int:
    """How many pivots per group keep all pivots together below the broadcast limit."""
    first = train.select(F.size("features").alias("d")).first()
    return max(2, PIVOT_BYTES // (8 * max(1, first["d"]) * max(1, n_groups)))


def _pivot_cells(
    queries: DataFrame, train: DataFrame, k: int, groups: Sequence[str], metric: str, n_pivots: int
) -> tuple[DataFrame, DataFrame]:
    # Of identical rows only the k smallest ids can ever be neighbours, so copies leave before any shuffle.
    train = top_rows(train, [*groups, "features"], ["id"], k, rank="__copy").drop("__copy")
    context = train.sparkSession.sparkContext
    sample = top_rows(train, list(groups), [F.xxhash64("id"), "id"], n_pivots).select(*groups, "features").collect()
    pivots = {key: np.array([r["features"] for r in rows]) for key, rows in _keyed(sample, groups).items()}
    shared = context.broadcast(pivots)

    placed_schema = T.StructType(
        [*train.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())]
    )
    placed = train.mapInArrow(_assign(shared, groups, "features", metric), placed_schema)
    radii = placed.groupBy(*groups, "cell").agg(F.count("*").alias("n"), F.min("gap").alias("near"), F.max("gap").alias("far"))
    cells = {}
    for key, rows in _keyed(radii.collect(), groups).items():
        n, near, far = (np.zeros(len(pivots[key])) for _ in range(3))
        for r in rows:
            n[r["cell"]], near[r["cell"]], far[r["cell"]] = r["n"], r["near"], r["far"]
        cells[key] = (n, near, far)

    routed_schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType())])
    routed = queries.mapInArrow(_route(shared, context.broadcast(cells), groups, "features", metric, k), routed_schema)
    return routed, placed.drop("gap")


def _counted(df: DataFrame, keys: Sequence[str], block_rows: int, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(out))


def _blocks(
    queries: DataFrame, train: DataFrame, keys: Sequence[str], sizes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Give both sides a block number; each side is copied to the blocks of the other side of its cell."""
    sizes = F.broadcast(sizes)  # at most groups x pivots rows of a few integers

    def own(blocks: str):
        return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")

    def all_of(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    q = queries.join(sizes, keys).withColumn("q_block", own("q_blocks")).withColumn("t_block", all_of("t_blocks"))
    t = train.join(sizes, keys).withColumn("t_block", own("t_blocks")).withColumn("q_block", all_of("q_blocks"))
    return q.drop("q_blocks", "t_blocks"), t.drop("q_blocks", "t_blocks")


def knn_join(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    groups: Sequence[str] = (),
    metric: str = "euclidean",
    n_pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
    scaler: DataFrame | None = None,
    min_pivots: int = 1,
) -> DataFrame:
    """The k nearest training rows of every query within its group, nearest first, ties to the smaller id.

    ``queries``: groups, id, features. ``train``: groups, id, features, label. Returns groups, id, neighbour,
    distance, label, rank. ``groups`` are splits (a bounded number); ``n_pivots`` None picks a number from the largest
    group's row count (at least ``min_pivots``), and 1 means no cells. ``scaler`` has the fitted min-max statistics of every group and is applied
    to both sides after their rows were counted.
    """
    groups = list(groups)
    queries = queries.select(*groups, F.col("id").cast("bigint").alias("id"), F.col("features").cast("array<double>").alias("features"))
    train = train.select(
        *groups,
        F.col("id").cast("bigint").alias("id"),
        F.col("features").cast("array<double>").alias("features"),
        F.col("label").cast("double").alias("label"),
    )
    keys = [*groups, "cell"]
    sizes = None
    if n_pivots is None or n_pivots == 1:
        q0, t0 = _one_cell_each(queries, train)
        counted = _counted(t0, keys, block_rows, "t_blocks").join(_counted(q0, keys, block_rows, "q_blocks"), keys)
        rows = counted.collect()  # one row per group
        largest = max((r["t_blocks"] for r in rows), default=0)
        if n_pivots is None:
            n_pivots = 1 if largest <= PLAIN_BLOCKS else min(MAX_PIVOTS, largest * 4, _affordable(train, len(rows)))
            n_pivots = max(n_pivots, min_pivots)
        sizes = queries.sparkSession.createDataFrame(rows, counted.schema)
    if scaler is not None:
        queries, train = scale(queries, scaler, groups), scale(train, scaler, groups)
    if n_pivots == 1:
        q, t = _one_cell_each(queries, train)
    else:
        q, t = _pivot_cells(queries, train, k, groups, metric, n_pivots)
        sizes = _counted(t, keys, block_rows, "t_blocks").join(_counted(q, keys, block_rows, "q_blocks"), keys)
    q, t = _blocks(q, t, keys, sizes)

    out_schema = T.StructType(
        [
            *[queries.schema[g] for g in groups],
            T.StructField("id", T.LongType()),
            T.StructField("neighbour", T.LongType()),
            T.StructField("distance", T.DoubleType()),
            T.StructField("label", T.DoubleType()),
        ]
    )
    names = out_schema.names

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            empty = left.slice(0, 0)
            return pa.table(
                [*[empty.column(g) for g in groups], empty.column("id"), empty.column("id"),
                 pa.array([], pa.float64()), pa.array([], pa.float64())], names=names,
            )
        t_id = right.column("id").to_numpy()
        row, col, gap = block_top_k(_matrix(left.column("features")), _matrix(right.column("features")), t_id, k, metric)
        picked = left.take(pa.array(row))
        return pa.table(
            [*[picked.column(g) for g in groups], picked.column("id"), pa.array(t_id[col]), pa.array(gap),
             pa.array(right.column("label").to_numpy()[col])], names=names,
        )

    block = [*groups, "cell", "q_block", "t_block"]
    t = t.toDF(*[f"t_{c}" if c in block else c for c in t.columns])  # both sides may come from one table
    found = q.groupBy(*block).cogroup(t.groupBy(*[f"t_{c}" for c in block])).applyInArrow(nearest, out_schema)
    return top_rows(found, [*groups, "id"], ["distance", "neighbour"], k, rank="rank")


def vote(neighbours: DataFrame, groups: Sequence[str] = (), weights: str = "uniform", k: int | None = None) -> DataFrame:
    """Probability of the positive class: the share of positive neighbours, or their share of the weight 1/distance
    (rows at distance 0 take all of it)."""
    rows = neighbours if k is None else neighbours.filter(F.col("rank") <= k)
    if weights == "uniform":
        prob = F.avg("label")
    else:
        weight = F.try_divide(F.lit(1.0), F.col("distance"))
        exact = F.sum(F.when(F.col("distance") == 0.0, 1.0).otherwise(0.0))
        prob = F.when(
            exact > 0, F.try_divide(F.sum(F.when(F.col("distance") == 0.0, F.col("label")).otherwise(0.0)), exact)
        ).otherwise(F.try_divide(F.sum(weight * F.col("label")), F.sum(weight)))
    return rows.groupBy(*groups, "id").agg(prob.alias("prob"))


def vote_grid(neighbours: DataFrame, ks: Sequence[int], groups: Sequence[str] = ()) -> DataFrame:
    """Uniform votes for several k from one join, one row per (row, k)."""
    votes = neighbours.groupBy(*groups, "id").agg(
        *[F.avg(F.when(F.col("rank") <= k, F.col("label"))).alias(str(k)) for k in ks]
    )
    long = votes.unpivot([*groups, "id"], [str(k) for k in ks], "k", "prob")
    return long.withColumn("k", F.col("k").cast("int"))
