"""Mixing sources to target weights: a repetition rate per source, and whole copies plus one seeded draw per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackmill.llm.common import id_text, n_words, unit
from stackmill.session import stored

SEED = "mix-1"
WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, source_size, target, rate`` from one row per document with ``source, size``.

    Sources by code point, null last, take the weights in turn. All targets together are all words. A target stops at
    ``most`` times its source's size; what is cut goes to the others by weight until none is above. That fixpoint is read
    off in one step: with sources by size over weight, the sources that stop are the first ones, and the level of the rest
    is (all words - the stopped targets) / (the other weights). Windows run over one row per source, never over documents.
    Sources without a word get target 0 and rate 0. An empty table gives an empty table.
    """
    every = Window.partitionBy()
    shares = F.array(*[F.lit(float(w)) for w in weights])
    rows = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(shares, F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1))
        .withColumn("cap", most * F.col("source_size"))
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    rows = rows.withColumn("at", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(every)["level"])
    target = F.least(F.coalesce(F.col("at") * F.col("weight"), F.col("cap")), F.col("cap"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(most))).otherwise(0.0)
    return rows.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, rate, copies``.

    A document is taken floor(rate) times, and once more if a number drawn from the hash of the seed and its id is below
    the fraction. Sizes are written once to the shared folder, because totals and documents both need them. Null and empty
    texts have size 0 and are still taken by their source's rate; rows with equal ids share the draw; a null id draws as
    the empty text. Other columns of the input are not read. The join to the sources is null-safe and left to Spark,
    which splits a hot source or broadcasts the small side by its measured size.
    """
    sizes = stored(docs.select("doc_id", "source", n_words("text").alias("size")), "mix-sizes")
    rates = source_targets(sizes, weights, most).withColumnRenamed("source", "of")
    joined = sizes.join(rates, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    extra = unit(seed, id_text()) < F.col("rate") - F.floor("rate")
    return joined.withColumn("copies", F.floor("rate") + extra.cast("bigint"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every column of ``docs`` and ``copy_no`` (from 1), one row per copy taken.

    The draw and the rate are functions of the row, so the documents need no join by id (repeated ids stay right); the
    rates come from the sources. A document of a source without words is dropped (rate 0). A column ``copy_no`` of the
    input is replaced.
    """
    sizes = docs.select("source", n_words("text").alias("size"))
    rates = source_targets(sizes, settings.get("weights", WEIGHTS), settings.get("most", MOST))
    rates = rates.select(F.col("source").alias("__of"), F.col("rate").alias("__rate"))
    extra = unit(settings.get("seed", SEED), id_text()) < F.col("__rate") - F.floor("__rate")
    times = (F.floor("__rate") + extra.cast("bigint")).cast("int")
    joined = docs.drop("copy_no").join(rates, docs["source"].eqNullSafe(F.col("__of"))).withColumn("__n", times).where("__n > 0")
    return joined.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__of", "__rate", "__n")


def rates_sql(docs: str) -> str:
    """DuckDB text of common table expressions ``sized`` (documents with sizes) and ``rated`` (sources with rates)."""
    return f"""sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
capped AS (SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM by_source),
levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
level AS (SELECT level AS lambda_level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, place LIMIT 1),
targets AS (SELECT source, source_size, least(coalesce((SELECT lambda_level FROM level) * weight, cap), cap) AS target FROM levels),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM targets)"""


#: 1 if the seeded draw of a document is below the fraction of its rate; DuckDB text.
DRAW_SQL = f"""(('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < rate - floor(rate))::BIGINT"""

SQL = f"""WITH {rates_sql("documents")}
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + {DRAW_SQL}))::BIGINT AS taken
FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source"""


def op6(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
