"""Deterministic splits by hash rank: the same rows on every run, cluster size and SQL engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackmill.functions.hashing import key_hash
from stackmill.operators.ranks import ranked

HASH_PREFIX = 3  # hex digits: 4096 buckets per (seed, label)
AUDIT_BITS = 60  # folds that an audit counts in one number


def year_split(df: DataFrame, year: str, first_test_year: int = 1997, role: str = "role") -> DataFrame:
    """'train' before the given year, 'test' from it on; rows without a year are left out of both."""
    return df.filter(F.col(year).isNotNull()).withColumn(
        role, F.when(F.col(year) < first_test_year, F.lit("train")).otherwise(F.lit("test"))
    )


def usage_split(df: DataFrame, usage: str, roles: dict[str, str], role: str = "role") -> DataFrame:
    """Keep the rows whose usage marker is listed and name their role."""
    named = F.lit(None).cast("string")
    for marker, name in roles.items():
        named = F.when(F.col(usage) == marker, F.lit(name)).otherwise(named)
    return df.withColumn(role, named).filter(F.col(usage).isin(list(roles)))


def _hash_ranked(df: DataFrame, id_col: str, label: str) -> DataFrame:
    """Ranks by hash. A row is shuffled without its hash, which is taken again behind the shuffle."""
    hashed = key_hash(F.col(id_col), F.col("seed"))
    placed = df.withColumn("__b", F.substring(hashed, 1, HASH_PREFIX))
    out = ranked(placed, ["seed", label], "__b", ["__h", id_col], rank="__rn", size="__n_class", late={"__h": hashed})
    return out.drop("__b")


def stratified_holdout(
    df: DataFrame, id_col: str, label: str, seed: int = 7, fraction: float = 0.2, flag: str = "is_holdout"
) -> DataFrame:
    """Mark ``round(fraction * n)`` rows of every class, those with the smallest hashes."""
    out = _hash_ranked(df.withColumn("seed", F.lit(seed)), id_col, label)
    held = F.col("__rn") <= F.round(F.lit(fraction) * F.col("__n_class")).cast("bigint")
    return out.withColumn(flag, held.cast("int")).drop("seed", "__rn", "__n_class")


def stratified_folds(
    df: DataFrame, id_col: str, label: str, seeds: Sequence[int] = tuple(range(20)), folds: int = 5
) -> DataFrame:
    """One row per (row, seed) with the fold in which the row is validated; class sizes differ by at most one."""
    each = df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    out = _hash_ranked(each, id_col, label)
    return out.withColumn("fold", ((F.col("__rn") - 1) % folds).cast("int")).drop("__rn", "__n_class")


def fold_members(folds: DataFrame, n_folds: int) -> DataFrame:
    """Expand (row, seed, fold) to one row per split: role 'train' in every other fold, 'validation' in its own."""
    split = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
    return (
        folds.withColumnRenamed("fold", "__own")
        .withColumn("fold", split)
        .withColumn("role", F.when(F.col("fold") == F.col("__own"), F.lit("validation")).otherwise(F.lit("train")))
        .drop("__own")
    )


def splits_from_wide(df: DataFrame, id_col: str, pattern: str = r"^\d+_skf_\d+$") -> DataFrame:
    """0/1 membership columns named ``<seed>_skf_<fold>`` to one row per (row, seed, fold)."""
    import re

    columns = [c for c in df.columns if re.match(pattern, c)]
    long = df.select(id_col, *columns).unpivot([id_col], columns, "split", "member")
    return long.select(
        id_col,
        F.split_part("split", F.lit("_skf_"), F.lit(1)).cast("int").alias("seed"),
        F.split_part("split", F.lit("_skf_"), F.lit(2)).cast("int").alias("fold"),
        F.when(F.col("member") == 1, F.lit("train")).otherwise(F.lit("validation")).alias("role"),
    )


def splits_from_status(df: DataFrame, pattern: str = r"^\d+_skf_\d+$") -> DataFrame:
    """Column pairs ``<split>`` (a row id) and ``<split>_status`` (its role) to one row per (row, seed, fold)."""
    import re

    names = [c for c in df.columns if re.match(pattern, c)]
    entry = [
        F.struct(
            F.lit(n).alias("split"), F.col(n).cast("bigint").alias("id"), F.col(f"{n}_status").alias("role")
        )
        for n in names
    ]
    long = df.select(F.explode(F.array(*entry)).alias("e")).select("e.*").filter(F.col("id").isNotNull())
    return long.select(
        "id",
        F.split_part("split", F.lit("_skf_"), F.lit(1)).cast("int").alias("seed"),
        F.split_part("split", F.lit("_skf_"), F.lit(2)).cast("int").alias("fold"),
        "role",
    )


def audit(members: DataFrame, id_col: str = "id") -> DataFrame:
    """Per seed: rows, rows validated other than once, and rows that are both train and validation in one split. Any number
    of folds. Members that lie together by seed and id are not shuffled again."""
    chunk = members.withColumn("__c", F.floor(F.col("fold") / AUDIT_BITS))  # the folds of a chunk are the bits of one number
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("fold"), F.lit(AUDIT_BITS)).cast("int"))
    per_chunk = chunk.groupBy("seed", id_col, "__c").agg(
        F.count_if(F.col("role") == "validation").alias("validated"),
        (F.count(F.lit(1)) - F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(1))).alias("double"),  # all rows without a fold are one
    )
    per_row = per_chunk.groupBy("seed", id_col).agg(F.sum("validated").alias("times_validated"), F.sum("double").alias("double_roles"))
    return per_row.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("times_validated") != 1).alias("n_not_once"),
        F.count_if(F.col("double_roles") != 0).alias("n_leaked"),
    )
