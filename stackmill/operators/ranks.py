"""Exact ranks and running values over groups of any size.

A window partitioned by a label or a run puts the whole group into one task. Here the order of a group is cut into
buckets first: the window runs per (group, bucket), and a second, small window over one row per (group, bucket) supplies
what came before. The result equals the plain window's. Group and bucket travel as one struct: null keys are equal to
themselves, and the window's partitioning serves the join that brings the offsets in.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_row(df: DataFrame, one: DataFrame, name: str) -> DataFrame:
    """Add the single row of ``one`` to every row as a struct column: a scalar subquery, evaluated once, no join."""
    return df.withColumn(name, one.select(F.struct(*one.columns).alias("row")).scalar())


@dataclass(frozen=True)
class Running:
    """``fold(value)`` over all earlier rows of the group (the current row excluded); null for the first row.

    ``merge`` joins two folded values and must skip nulls, as ``greatest`` does.
    """

    value: str
    fold: Callable[[Column], Column] = F.max
    merge: Callable[[Column, Column], Column] = F.greatest


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[Column | str],
    rank: str | None = None,
    size: str | None = None,
    values: Mapping[str, Running] | None = None,
    late: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rank, group size and running values in the order (bucket, order) of each group, from one shuffle of the rows.

    ``bucket`` must not contradict the order: rows of a smaller bucket come first. ``late`` columns are made behind the
    shuffle, for the order alone; of the keys and the bucket only the struct is shuffled then.
    """
    values = values or {}
    placed = df.withColumn("__k", F.struct(*keys, bucket))
    shuffled = placed
    if late:
        packed = [*keys, bucket]
        shuffled = placed.drop(*packed).repartition("__k").withColumns({c: F.col("__k")[c] for c in packed}).withColumns(dict(late))
    ordered = Window.partitionBy("__k").orderBy(*order)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    local = shuffled.withColumns(
        {
            "__rank": F.row_number().over(ordered).cast("bigint"),
            **{f"__v_{name}": r.fold(F.col(r.value)).over(earlier) for name, r in values.items()},
        }
    )
    parts = placed.groupBy("__k").agg(
        F.count(F.lit(1)).alias("__n"), *[r.fold(F.col(r.value)).alias(f"__p_{name}") for name, r in values.items()]
    )
    group = Window.partitionBy(*[F.col("__k")[k] for k in keys])
    before = group.orderBy(F.col("__k")[bucket]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "__k",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(group).alias("__size"),
        *[r.fold(F.col(f"__p_{name}")).over(before).alias(f"__b_{name}") for name, r in values.items()],
    )
    joined = local.join(offsets, "__k")
    out = {name: r.merge(F.col(f"__v_{name}"), F.col(f"__b_{name}")) for name, r in values.items()}
    if rank:
        out[rank] = F.col("__rank") + F.col("__before")
    if size:
        out[size] = F.col("__size")
    own = [c for c in df.columns if c not in out]
    return joined.select(*own, *[c.alias(name) for name, c in out.items()])


def ranked(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column | str], rank: str = "rn", size: str | None = None,
    late: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``row_number() over (partition by keys order by bucket, order)`` and, optionally, the size of the group."""
    return prefix(df, keys, bucket, order, rank, size, late=late)


def running(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column | str], value: str, out: str
) -> DataFrame:
    """The largest earlier ``value`` of the group."""
    return prefix(df, keys, bucket, order, values={out: Running(value)})


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of every group. Each task keeps ``n`` rows per group before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
    return kept.withColumn(rank, F.col(rank).cast("bigint"))
