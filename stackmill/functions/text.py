"""Descriptors of strings, and the small text formats of the run tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackmill.functions.arrays import finite_or_zero
from stackmill.functions.hashing import hash_ints

# Substructure patterns whose presence sets one bit each, in bit order.
STRUCTURE_PATTERNS = (
    "Cl", "Br", "F", "I", "S", "P", "O=", "=O", "N", "n",
    "c1", "C=C", "#", "[(]", "[)]", r"\[", r"\]", "@", "[+]", "-",
    "[0-9]", "OC", "CN", "NC", "CC", "ss", "[.]", "%", "[A-Z][A-Z]", "[a-z][0-9]",
)

# Metric order of a performance list.
PERFORMANCE_FIELDS = (
    "tn", "fp", "fn", "tp", "accuracy", "auc", "sensitivity", "specificity", "ppv", "npv", "f1", "mcc",
    "balanced_accuracy",
)

RUN_NAME = r"^(?:prob_|class_)?([a-z]+)_seed_([0-9]+)_skf_([0-9]+)(?:_paras_(.*))?$"


def tokens(text: Column) -> Column:
    """Words between blanks, tabs and line ends."""
    return F.filter(F.split(text, "[ \t\r\n]+"), lambda t: t != "")


def _gram_bits(words: pa.Array, counts: np.ndarray, n_bits: int, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """The set bits of texts given by their words one behind the other, in order, and how many each text has."""
    size = np.diff(np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b" ")[0].as_buffer()
    start = np.cumsum(size + 1) - size - 1  # with a blank between words, a gram is a stretch of bytes
    owner = np.repeat(np.arange(len(counts)), counts)
    keys = []
    for n in range(1, max_n + 1):
        first = np.flatnonzero(owner[: max(len(owner) - n + 1, 0)] == owner[n - 1 :])
        last = first + n - 1
        keys.append(owner[first] * n_bits + hash_ints(joined, start[first], start[last] + size[last] - start[first]) % n_bits)
    found = np.unique(np.concatenate(keys))
    return found % n_bits, np.bincount(found // n_bits, minlength=len(counts))


#: Words whose grams are hashed in one step; a longer text is a step of its own.
GRAM_STEP = 1 << 17


def hashed_bits(words: Column, n_bits: int = 1024, max_n: int = 3) -> Column:
    """Set bits of a hashed fingerprint: every run of 1..max_n words turns on one of ``n_bits`` positions.

    The bit is the first seven hex digits of the gram's md5, as ``hash_int``. Grams are hashed together in Arrow batches: inside
    a lambda Spark interprets every step of every gram. A null word is an error; ``tokens`` gives none.
    """

    @F.arrow_udf("array<int>")
    def run(lists: pa.Array) -> pa.Array:
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = lists.flatten().cast(pa.binary()), np.cumsum(counts)
        bits, sizes, row, at = [], [], 0, 0
        while row < len(counts):
            stop = max(row + 1, int(np.searchsorted(ends, at + GRAM_STEP, side="right")))
            found, per_row = _gram_bits(flat[at : ends[stop - 1]], counts[row:stop], n_bits, max_n)
            bits.append(found.astype(np.int32))
            sizes.append(per_row)
            row, at = stop, int(ends[stop - 1])
        offsets = np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes])).astype(np.int32)
        values = pa.array(np.concatenate([np.zeros(0, np.int32), *bits]))
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=lists.is_null())

    return run(words)


REGEX_SIGNS = set(r"[](){}.*+?^$|" + "\\")


def _holds(text: Column, pattern: str) -> Column:
    return text.rlike(pattern) if REGEX_SIGNS & set(pattern) else text.contains(pattern)


def key_bits(text: Column, patterns: Sequence[str] = STRUCTURE_PATTERNS) -> Column:
    """0/1 per pattern, in the order of the list."""
    return F.array(*[F.coalesce(_holds(text, p), F.lit(False)).cast("int") for p in patterns])


DESCRIPTOR_NAMES = (
    "n_chars", "n_letters", "n_upper", "n_digits", "n_branches", "n_double", "n_triple", "n_lines", "n_words",
    "letter_share", "upper_share", "digit_share", "other_share", "distinct_word_share", "mean_word",
)
# What each count leaves out of the text before its length is taken.
OUTSIDE = {
    "n_letters": "[^A-Za-z]+", "n_upper": "[^A-Z]+", "n_digits": "[^0-9]+", "n_branches": "[^()]+", "n_double": "[^=]+",
    "n_triple": "[^#]+", "n_lines": "[^\n]+", "__solid": "[ \t\r\n]+",
}


def lexical_descriptors(df: DataFrame, text: str, words: str) -> DataFrame:
    """Add the columns DESCRIPTOR_NAMES: counts of the string first, then the shares that are made of them."""
    counts = {name: F.length(F.regexp_replace(text, outside, "")).cast("double") for name, outside in OUTSIDE.items()}
    counts["n_chars"] = F.length(text).cast("double")
    counts["n_words"] = F.size(words).cast("double")
    counts["__distinct"] = F.size(F.array_distinct(words)).cast("double")
    share = lambda part, whole: F.coalesce(F.try_divide(part, F.col(whole)), F.lit(0.0))
    shares = {
        "letter_share": share(F.col("n_letters"), "n_chars"),
        "upper_share": share(F.col("n_upper"), "n_chars"),
        "digit_share": share(F.col("n_digits"), "n_chars"),
        "other_share": share(
            F.col("n_chars") - F.col("n_letters") - F.col("n_digits") - (F.col("n_chars") - F.col("__solid")), "n_chars"
        ),
        "distinct_word_share": share(F.col("__distinct"), "n_words"),
        "mean_word": share(F.col("__solid"), "n_words"),
    }
    return df.withColumns(counts).withColumns(shares).drop("__solid", "__distinct")


def describe(df: DataFrame, text: str, keep: Sequence[str], n_bits: int = 1024) -> DataFrame:
    """Id columns, validity, lexical descriptors, fingerprint bits and key bits of a text column in one narrow pass.

    A string is valid when it holds at least one word; an invalid one gets zero descriptors and no bits.
    """
    base = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__words", tokens(F.col("__text")))
    return lexical_descriptors(base, "__text", "__words").select(
        *keep,
        (F.size("__words") > 0).alias("valid"),
        F.transform(F.array(*DESCRIPTOR_NAMES), finite_or_zero).alias("descriptors"),
        hashed_bits(F.col("__words"), n_bits).alias("bits"),
        key_bits(F.col("__text")).alias("keys"),
    )


def bits_to_columns(df: DataFrame, bits: str, n_bits: int, prefix: str, keep: Sequence[str]) -> DataFrame:
    """Set-bit positions to 0/1 columns ``<prefix>0 .. <prefix>{n-1}``."""
    return df.select(
        *keep, *[F.array_contains(F.col(bits), F.lit(j)).cast("int").alias(f"{prefix}{j}") for j in range(n_bits)]
    )


def side_by_side(df: DataFrame, numbers: str, bits: str, n_bits: int, keep: Sequence[str]) -> DataFrame:
    """The vector of ``numbers`` and then ``n_bits`` cells that are 1 at the set bits: its length ``n`` and its entries that are
    not 0 (``pos, x``). The cells that are 0 are never made."""
    entry = lambda pos, x: F.struct(pos.alias("pos"), x.alias("x"))
    first = F.filter(F.transform(numbers, lambda x, i: entry(i, x)), lambda e: e["x"] != 0)
    rest = F.transform(bits, lambda b: entry(F.size(numbers) + b, F.lit(1.0)))
    rows = df.select(*keep, (F.size(numbers) + n_bits).alias("n"), F.explode(F.concat(first, rest)).alias("e"))
    return rows.select(*keep, "n", "e.pos", "e.x")


def parse_performance(value: Column, fields: Sequence[str] = PERFORMANCE_FIELDS) -> dict[str, Column]:
    """'[tn, fp, ...]' to typed columns: the four counts as integers, the other values rounded to 3 places."""
    parts = F.split(F.translate(value, "[] ", ""), ",")
    out = {}
    for i, name in enumerate(fields):
        item = F.get(parts, F.lit(i))
        out[name] = item.try_cast("bigint") if i < 4 else F.round(item.try_cast("double"), 3)
    return out


def format_performance(fields: Sequence[Column]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *[f.cast("string") for f in fields]), F.lit("]"))


def parse_run_name(name: Column) -> dict[str, Column]:
    """'knn_seed_3_skf_2_paras_x_K_7' to model, seed, fold and tag."""
    part = lambda i: F.regexp_extract(name, RUN_NAME, i)
    return {
        "model": part(1),
        "seed": part(2).try_cast("int"),
        "fold": part(3).try_cast("int"),
        "tag": part(4),
    }


def clip_text(text: Column, n: int = 500) -> Column:
    return F.substring(text, 1, n)


def number_text(value: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", value)


def percent_text(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100)


def report_lines(columns: Mapping[str, Column]) -> Column:
    """'name: 0.123' parts joined by commas."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), number_text(v)) for k, v in columns.items()])
