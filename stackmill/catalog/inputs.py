"""Tables the queries start from, derived from the test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.functions import text
from stackmill.functions.arrays import doubles
from stackmill.functions.hashing import hash_int
from stackmill.functions.scores import threshold_class
from stackmill.operators import ledger as L
from stackmill.session import spread
from stackmill.sources.readers import table

MODELS = ("knn", "lr", "svm", "rf", "xgboost")
SIGNAL = {"knn": 0.10, "lr": 0.22, "svm": 0.16, "rf": 0.12, "xgboost": 0.14}
SEEDS = (0, 1)
RUN_NAMES = tuple(f"{m}_{s}" for m in MODELS for s in SEEDS)


def sql_hash(text_sql: str) -> str:
    return f"('0x' || substr(md5({text_sql}), 1, 7))::BIGINT"


# -- predictions of ten runs for every order -------------------------------------------------------------------------


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """id, model, seed, fold, role, y_true, prob, cls: noisy scores of five models with two seeds for every order."""
    runs = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed"), F.lit(SIGNAL[m]).alias("signal"))
            for m in MODELS
            for s in SEEDS
        ]
    )
    columns = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    orders = spread(columns, "o_orderkey").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y_true"),
        F.year("o_orderdate").alias("year"),
    )
    text_id = F.col("id").cast("string")
    role = (
        F.when(F.col("year") >= 1997, "test").when(hash_int(text_id) % 5 == 0, "holdout").otherwise("fold_val")
    )
    rows = orders.withColumn("role", role).select("id", "y_true", "role", F.explode(runs).alias("r"))
    noise = hash_int(F.concat_ws("|", text_id, "r.model", F.col("r.seed").cast("string"))) % 10007
    prob = F.round(F.lit(0.1) + F.lit(0.55) * (noise / F.lit(10007.0)) + F.col("r.signal") * F.col("y_true"), 6)
    return rows.select(
        "id",
        "r.model",
        "r.seed",
        (hash_int(F.concat_ws("#", text_id, F.col("r.seed").cast("string"))) % 5).cast("int").alias("fold"),
        "role",
        "y_true",
        prob.alias("prob"),
    ).withColumn("cls", threshold_class(F.col("prob")))


PRED = f"""
runs AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {s}, {SIGNAL[m]}e0)" for m in MODELS for s in SEEDS)}) t(model, seed, signal)),
pred0 AS (
  SELECT o_orderkey AS id, model, seed,
         ({sql_hash("o_orderkey || '#' || seed")} % 5)::INT AS fold,
         CASE WHEN year(o_orderdate) >= 1997 THEN 'test'
              WHEN {sql_hash("o_orderkey::VARCHAR")} % 5 = 0 THEN 'holdout' ELSE 'fold_val' END AS role,
         (o_orderstatus = 'F')::INT AS y_true,
         round(0.1e0 + 0.55e0 * (({sql_hash("o_orderkey || '|' || model || '|' || seed")} % 10007) / 10007.0e0)
               + signal * (o_orderstatus = 'F')::INT, 6) AS prob
  FROM orders, runs),
pred AS (SELECT *, (prob > 0.5e0)::INT AS cls FROM pred0)"""


def sql_metrics(source: str, keys: str, extra: str = "") -> str:
    """CTEs ``m`` with counts, AUC and all metrics of a prediction table per run."""
    k = f"{keys}," if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    on = " AND ".join(f"c.{c.strip()} = a.{c.strip()}" for c in keys.split(",")) if keys else "TRUE"
    cols = "".join(f"c.{c.strip()}, " for c in keys.split(",")) if keys else ""
    return f"""
ranked AS (
  SELECT {k} y_true, rank() OVER ({part} ORDER BY prob) + (count(*) OVER ({part + ',' if part else 'PARTITION BY'} prob) - 1) / 2.0e0 AS r
  FROM {source}),
aucs AS (
  SELECT {k} CASE WHEN sum(y_true) = 0 OR sum(1 - y_true) = 0 THEN 0.5e0 ELSE
    (sum(CASE WHEN y_true = 1 THEN r ELSE 0 END) - sum(y_true)::DOUBLE * (sum(y_true) + 1) / 2)
    / (sum(y_true)::DOUBLE * sum(1 - y_true)) END AS auc
  FROM ranked {group}),
counts AS (
  SELECT {k} count(*) FILTER (y_true = 0 AND cls = 0)::BIGINT AS tn, count(*) FILTER (y_true = 0 AND cls = 1)::BIGINT AS fp,
         count(*) FILTER (y_true = 1 AND cls = 0)::BIGINT AS fn, count(*) FILTER (y_true = 1 AND cls = 1)::BIGINT AS tp
  FROM {source} {group}),
m AS (
  SELECT {cols} c.tn, c.fp, c.fn, c.tp, a.auc,
    (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy,
    CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS sensitivity,
    CASE WHEN tn + fp = 0 THEN NULL ELSE tn::DOUBLE / (tn + fp) END AS specificity,
    CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS ppv,
    CASE WHEN tn + fn = 0 THEN NULL ELSE tn::DOUBLE / (tn + fn) END AS npv,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0e0 * tp / (2 * tp + fp + fn) END AS f1,
    CASE WHEN (tp + fp) * (tp + fn) * (tn + fp)::HUGEINT * (tn + fn) = 0 THEN 0 ELSE
      (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc,
    (CASE WHEN tp + fn = 0 THEN tn::DOUBLE / (tn + fp) WHEN tn + fp = 0 THEN tp::DOUBLE / (tp + fn)
      ELSE (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 END) AS balanced_accuracy
  FROM counts c JOIN aucs a ON {on}){extra}"""


METRIC_COLUMNS = (
    "auc", "accuracy", "sensitivity", "specificity", "ppv", "npv", "f1", "mcc", "balanced_accuracy",
)


def sql_rounded(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


# -- vectors with a binary label -------------------------------------------------------------------------------------


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """id, label, features: the embedding table with label >= 5 as the positive class."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("label"), doubles(F.col("embedding")).alias("features")
    )


VECTORS = """
vectors AS (SELECT vec_id AS id, (label >= 5)::INT AS label, embedding::DOUBLE[] AS features FROM embeddings)"""

LONG = """
long AS (
  SELECT id, label, i - 1 AS pos, features[i] AS x FROM vectors, range(1, 65) t(i))"""


def sql_folds(source: str, seeds: str, folds: int = 5) -> str:
    """CTE ``folds`` with the stratified fold of every row and seed."""
    return f"""
folds AS (
  SELECT id, label, seed,
    ((row_number() OVER (PARTITION BY seed, label ORDER BY md5(id || '|' || seed), id) - 1) % {folds})::INT AS fold
  FROM {source}, (SELECT unnest([{seeds}]) AS seed))"""


# -- labelled documents and their descriptors -------------------------------------------------------------------------


def described(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id with the lexical descriptors of every document as ``features``."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    words = docs.withColumn("words", text.tokens(F.col("text")))
    named = text.lexical_descriptors(words, "text", "words")
    return named.select("doc_id", F.array(*text.DESCRIPTOR_NAMES).alias("features"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """id, label, features: labelled documents, positive when the quality is 1."""
    marks = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return described(spark, folder).join(marks, "doc_id").select(F.col("doc_id").alias("id"), "label", "features")


def _sql_kept(outside: str) -> str:
    return f"length(regexp_replace(text, '{outside}', '', 'g'))::DOUBLE"


DESCRIPTORS = f"""
words AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda t: t <> '') AS w FROM documents),
parts AS (
  SELECT doc_id, length(text)::DOUBLE AS n_chars, {_sql_kept('[^A-Za-z]+')} AS n_letters, {_sql_kept('[^A-Z]+')} AS n_upper,
    {_sql_kept('[^0-9]+')} AS n_digits, {_sql_kept('[^()]+')} AS n_branches, {_sql_kept('[^=]+')} AS n_double,
    {_sql_kept('[^#]+')} AS n_triple, {_sql_kept('[^' + chr(92) + 'n]+')} AS n_lines, len(w)::DOUBLE AS n_words,
    length(text) - {_sql_kept('[ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n]+')} AS blanks,
    len(list_distinct(w))::DOUBLE AS n_distinct
  FROM words),
descriptors AS (
  SELECT doc_id, n_chars, n_letters, n_upper, n_digits, n_branches, n_double, n_triple, n_lines, n_words,
    coalesce(n_letters / nullif(n_chars, 0), 0) AS letter_share, coalesce(n_upper / nullif(n_chars, 0), 0) AS upper_share,
    coalesce(n_digits / nullif(n_chars, 0), 0) AS digit_share,
    coalesce((n_chars - n_letters - n_digits - blanks) / nullif(n_chars, 0), 0) AS other_share,
    coalesce(n_distinct / nullif(n_words, 0), 0) AS distinct_word_share,
    coalesce((n_chars - blanks) / nullif(n_words, 0), 0) AS mean_word
  FROM parts)"""


# -- mechanistic columns of orders ------------------------------------------------------------------------------------

MECH = ("bsep", "cyto")
CYP = ("cyp_a", "cyp_b", "cyp_c")


def mechanistic(spark: SparkSession, folder: str) -> DataFrame:
    """id, year, bsep, cyto, cyp_a, cyp_b, cyp_c: line averages of every order; null for an order without lines."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.avg("l_quantity").alias("bsep"),
        F.avg("l_extendedprice").alias("cyto"),
        F.avg("l_discount").alias("cyp_a"),
        F.avg("l_tax").alias("cyp_b"),
        F.max("l_linenumber").cast("double").alias("cyp_c"),
    )
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))
    return orders.join(lines, "id", "left")


MECHANISTIC = """
lines AS (
  SELECT l_orderkey AS id, avg(l_quantity) AS bsep, avg(l_extendedprice) AS cyto, avg(l_discount) AS cyp_a, avg(l_tax) AS cyp_b,
         max(l_linenumber)::DOUBLE AS cyp_c FROM lineitem GROUP BY 1),
mech AS (
  SELECT o_orderkey AS id, year(o_orderdate)::INT AS year, bsep, cyto, cyp_a, cyp_b, cyp_c
  FROM orders LEFT JOIN lines ON o_orderkey = lines.id)"""


# -- the run ledger ---------------------------------------------------------------------------------------------------


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """run, event_id, ts, action, score, props: the events of every user, not yet numbered."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run"),
        "event_id",
        "ts",
        F.col("event_type").alias("action"),
        (F.col("value") / 500.0).alias("score"),
        "props",
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The actions numbered in the order of time, with their success."""
    return L.numbered(actions(spark, folder), "run", "ts", "event_id", F.date_trunc("hour", "ts")).withColumn(
        "success", L.success(F.col("action"))
    )


LEDGER = """
ledger AS (
  SELECT user_id AS run, event_id, ts, event_type AS action, value / 500.0e0 AS score, props,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration, event_type <> 'error' AS success
  FROM events)"""
