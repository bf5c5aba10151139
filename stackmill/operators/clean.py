"""Labels, column selection, required columns, ids."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackmill.session import cut

# Concern categories and column aliases of the input files.
CONCERN_LABELS = {"most-dili-concern": 1, "less-dili-concern": 1, "no-dili-concern": 0, "ambiguous-dili-concern": None}
NAME_ALIASES = ("CompoundName", "Name", "Compound", "name", "compound_name")
STRUCTURE_ALIASES = ("SMILES", "smiles", "Smiles", "canonical_smiles")


def concern_key(category: Column) -> Column:
    """Lower case without the optional leading 'v' ('vMost-...' and 'Most-...' are the same category)."""
    return F.regexp_replace(F.lower(F.trim(category)), "^v", "")


def map_labels(
    df: DataFrame, category: Column, mapping: Mapping[str, int | None] = CONCERN_LABELS, label: str = "label"
) -> DataFrame:
    """Binary label of a category; rows whose category is excluded or unknown are dropped."""
    value = F.lit(None).cast("int")
    for target in (0, 1):
        names = [k for k, v in mapping.items() if v == target]
        value = F.when(category.isin(names), F.lit(target)).otherwise(value)
    return df.withColumn(label, value).filter(F.col(label).isNotNull())


def unmapped(df: DataFrame, category: Column, mapping: Mapping[str, int | None] = CONCERN_LABELS) -> DataFrame:
    """How many rows each unknown category holds (the ones a plain mapping loses without a message)."""
    known = category.isin(list(mapping))
    return df.filter(~F.coalesce(known, F.lit(False))).groupBy(category.alias("category")).agg(F.count("*").alias("n"))


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.match(pattern, c)]


def select_prefixed(df: DataFrame, prefixes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The kept columns, then those of each prefix in turn."""
    picked = [c for p in prefixes for c in df.columns if c.startswith(p)]
    return df.select(*keep, *picked)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns in schema order, without the excluded ones."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def require_columns(df: DataFrame, required: Sequence[str], show: int = 5) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing {len(missing)} columns: {missing[:show]}")
    return df


def first_alias(columns: Sequence[str], aliases: Sequence[str], contains: Sequence[str] = ()) -> str | None:
    for alias in aliases:
        if alias in columns:
            return alias
    return next((c for c in columns if any(part in c.lower() for part in contains)), None)


def canonical_columns(df: DataFrame, name: str = "CompoundName", structure: str = "SMILES") -> DataFrame:
    """Rename the id and the structure column, found by alias, to their canonical names."""
    for target, found in (
        (name, first_alias(df.columns, NAME_ALIASES)),
        (structure, first_alias(df.columns, STRUCTURE_ALIASES, contains=("smiles", "smi"))),
    ):
        if found and found != target:
            df = df.withColumnRenamed(found, target)
    return df


def with_row_ids(df: DataFrame, order: Sequence[str], out: str = "row_id", prefix: str | None = None) -> DataFrame:
    """0-based row numbers in the order of a unique key, without a one-task window.

    Rows are range-partitioned and sorted; the number of a row is its place in the partition plus the rows of all
    earlier partitions. The placed rows are materialised, so that counts and places come from the same partitioning.
    """
    placed = cut(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("__m", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("__part", F.shiftrightunsigned("__m", 33))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    number = F.col("__m").bitwiseAND((1 << 33) - 1) + F.col("__start")
    value = number if prefix is None else F.concat(F.lit(prefix), number.cast("string"))
    return placed.join(offsets, "__part").withColumn(out, value).drop("__m", "__part", "__start")


def drop_ranked(ranks: DataFrame, n: int) -> DataFrame:
    """The features of an importance order that remain after its first ``n`` are dropped."""
    return ranks.filter(F.col("rank") > n)
