"""Labels, selections, cleaning, ids and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackmill.catalog.inputs import DESCRIPTORS, PRED, VECTORS, predictions, vectors
from stackmill.catalog.registry import query
from stackmill.functions import arrays, text
from stackmill.operators import clean as X
from stackmill.operators import selection as S
from stackmill.operators import splits as P
from stackmill.sources.readers import table

# -- labels ------------------------------------------------------------------------------------------------------------

_CATEGORY = """CASE o_orderpriority WHEN '1-URGENT' THEN 'vMost-DILI-concern' WHEN '2-HIGH' THEN 'Less-DILI-Concern'
  WHEN '3-MEDIUM' THEN 'Ambiguous-DILI-concern' WHEN '5-LOW' THEN 'vNo-DILI-Concern' ELSE 'not listed' END"""


def _categories(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", F.expr(_CATEGORY).alias("concern"))


@query("label_map", f"""WITH c AS (SELECT o_orderkey, lower({_CATEGORY}) AS concern FROM orders)
SELECT o_orderkey, (concern NOT LIKE '%no-%')::INT AS label FROM c WHERE concern LIKE '%most-%' OR concern LIKE '%less-%' OR concern LIKE '%no-%'""")
def label_map(spark, folder):
    """Concern categories to 0/1 labels; ambiguous and unknown categories are dropped."""
    return X.map_labels(_categories(spark, folder), X.concern_key(F.col("concern"))).select("o_orderkey", "label")


@query("label_unmapped", f"""SELECT 'not listed' AS category, count(*) AS n FROM orders WHERE {_CATEGORY} = 'not listed'""")
def label_unmapped(spark, folder):
    """Rows lost to categories the mapping does not know."""
    return X.unmapped(_categories(spark, folder), X.concern_key(F.col("concern")))


@query("year_split", "SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1997 THEN 'train' ELSE 'test' END AS role FROM orders")
def year_split(spark, folder):
    """Training rows before 1997, test rows from then on."""
    rows = table(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return P.year_split(rows, "year").select("o_orderkey", "role")


@query("usage_split", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'validation' END AS role FROM orders WHERE o_orderstatus IN ('F', 'O')")
def usage_split(spark, folder):
    """Roles from a usage marker."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return P.usage_split(rows, "o_orderstatus", {"F": "train", "O": "validation"}).select("o_orderkey", "role")


@query("in_train_flag", """WITH y AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE year(o_orderdate) END AS year FROM orders)
SELECT o_orderkey, CASE WHEN year < 1997 THEN 1 ELSE 0 END AS in_train FROM y""")
def in_train_flag(spark, folder):
    """1 for a known year before 1997, 0 otherwise (also for a missing year)."""
    year = F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.year("o_orderdate"))
    rows = table(spark, folder, "orders").select("o_orderkey", year.alias("year"))
    return rows.select("o_orderkey", F.when(F.col("year") < 1997, 1).otherwise(0).alias("in_train"))


@query("threshold_class", f"WITH {PRED} SELECT id, sum((prob > 0.5e0)::INT)::BIGINT AS n_positive FROM pred GROUP BY id")
def threshold_class(spark, folder):
    """Class by the strict threshold 0.5, summed over a row's runs."""
    return predictions(spark, folder).groupBy("id").agg(F.sum("cls").alias("n_positive"))


# -- columns -----------------------------------------------------------------------------------------------------------


def _wide_vectors(spark, folder):
    """vec_id and the vector elements as columns D001, D002, ... beside E_0, E_1, ..."""
    rows = vectors(spark, folder)
    names = [(f"D{i + 1:03d}" if i < 32 else f"E_{i}", i) for i in range(64)]
    return rows.select("id", "label", *[F.round(F.get("features", F.lit(i)), 6).alias(n) for n, i in names])


@query("select_by_prefix", f"WITH {VECTORS} SELECT id, {', '.join(f'round(features[{i + 1}], 6) AS E_{i}' for i in range(32, 64))} FROM vectors")
def select_by_prefix(spark, folder):
    """Columns by prefix."""
    return X.select_prefixed(_wide_vectors(spark, folder), ["E_"], keep=["id"])


@query("select_by_pattern", f"WITH {VECTORS} SELECT id, {', '.join(f'round(features[{i + 1}], 6) AS D{i + 1:03d}' for i in range(32))} FROM vectors")
def select_by_pattern(spark, folder):
    """Descriptor columns by the pattern D and digits."""
    wide = _wide_vectors(spark, folder)
    return wide.select("id", *X.columns_like(wide, "^D[0-9]+$"))


@query("select_by_pos", "SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer")
def select_by_pos(spark, folder):
    """All columns from the third on."""
    rows = table(spark, folder, "customer")
    return rows.select(*rows.columns[2:])


@query("numeric_features", "SELECT p_size, p_retailprice FROM part")
def numeric_features(spark, folder):
    """Numeric columns except the excluded key."""
    rows = table(spark, folder, "part")
    return rows.select(*X.numeric_columns(rows, exclude=["p_partkey"]))


@query("require_columns", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def require_columns(spark, folder):
    """Counts after the required columns were found."""
    rows = X.require_columns(table(spark, folder, "orders"), ["o_orderkey", "o_orderstatus"])
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("canonical_columns", "SELECT doc_id AS CompoundName, md5(text) AS SMILES FROM documents")
def canonical_columns(spark, folder):
    """Id and structure columns found by alias and renamed."""
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").alias("compound_name"), F.col("text").alias("canonical_smiles")
    )
    return X.canonical_columns(rows).withColumn("SMILES", F.md5("SMILES"))


_ORDER = """rank AS (SELECT pos, row_number() OVER (ORDER BY round(var_pop(x), 9) DESC, pos) AS rank FROM long GROUP BY pos)"""


@query("drop_ranked_features", f"""WITH {VECTORS}, long AS (SELECT id, i - 1 AS pos, features[i] AS x FROM vectors, range(1, 65) t(i)), {_ORDER}
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY pos) - 1)::INT AS place, round(x, 6) AS x FROM long JOIN rank USING (pos) WHERE rank > 24""")
def drop_ranked_features(spark, folder):
    """Vectors without the first 24 features of the variance order."""
    rows = vectors(spark, folder)
    width = rows.select(F.max(F.size("features"))).first()[0] or 0
    order = S.top_features(S.feature_variance(rows), width, digits=9)
    kept = sorted(r["pos"] for r in X.drop_ranked(order, 24).collect())  # one row per feature
    picked = rows.select("id", arrays.keep_positions(F.col("features"), kept).alias("features"))
    return picked.select("id", F.posexplode_outer("features").alias("place", "x")).withColumn("x", F.round("x", 6))


@query("clean_features", f"""WITH {VECTORS}, d AS (SELECT id, i, CASE WHEN (id + i) % 17 = 0 OR (id + i) % 19 = 0 OR (id + i) % 23 = 0 THEN 0 ELSE features[i] END AS x
  FROM vectors, range(1, 65) t(i)) SELECT id, round(sum(x), 6) AS total, count(*) FILTER (x = 0) AS n_zero FROM d GROUP BY id""")
def clean_features(spark, folder):
    """NaN, infinite and missing values to 0."""

    def spoil(x, i):
        n = F.col("id") + i + 1
        return (
            F.when(n % 17 == 0, F.lit(float("nan"))).when(n % 19 == 0, F.lit(float("-inf")))
            .when(n % 23 == 0, F.lit(None)).otherwise(x)
        )

    spoiled = vectors(spark, folder).withColumn("features", F.transform("features", spoil))
    cleaned = spoiled.select("id", arrays.clean(F.col("features")).alias("x"))
    zeros = F.size(F.filter("x", lambda v: v == 0.0)).cast("bigint")
    return cleaned.select("id", F.round(arrays.total(F.col("x")), 6).alias("total"), zeros.alias("n_zero"))


_MIXED = """CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderkey * 0.25 AS {s}) WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE substr(o_orderpriority, 1, 1) END"""


@query("coerce_numeric", f"SELECT o_orderkey, coalesce(try_cast({_MIXED.format(s='VARCHAR')} AS DOUBLE), 0) AS value FROM orders")
def coerce_numeric(spark, folder):
    """Text to numbers, 0 where it does not parse."""
    rows = table(spark, folder, "orders").select("o_orderkey", F.expr(_MIXED.format(s="STRING")).alias("raw"))
    return rows.select("o_orderkey", arrays.numeric_or_zero(F.col("raw")).alias("value"))


@query("valid_rows", "SELECT d.doc_id, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE length(trim(text)) > 0")
def valid_rows(spark, folder):
    """Documents with text and a label."""
    docs = table(spark, folder, "documents").select("doc_id", (F.length(F.trim("text")) > 0).alias("valid"))
    marks = table(spark, folder, "labels").select("doc_id", "quality")
    joined = docs.join(marks, "doc_id", "left")
    return joined.filter(F.col("valid") & F.col("quality").isNotNull()).select("doc_id", "quality")


@query("make_ids", "SELECT doc_id, 'Compound_' || (row_number() OVER (ORDER BY source, doc_id) - 1) AS name FROM documents")
def make_ids(spark, folder):
    """Generated names numbered in the order of a key."""
    rows = table(spark, folder, "documents").select("source", "doc_id")
    return X.with_row_ids(rows, ["source", "doc_id"], "name", prefix="Compound_").select("doc_id", "name")


@query("dedupe_map", "SELECT DISTINCT source, lang FROM documents")
def dedupe_map(spark, folder):
    """Distinct pairs of a mapping."""
    return table(spark, folder, "documents").select("source", "lang").dropDuplicates()


@query("preview", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 5")
def preview(spark, folder):
    """The first five rows."""
    return table(spark, folder, "documents").select("doc_id", "lang", "source").orderBy("doc_id").limit(5)


# -- joins -------------------------------------------------------------------------------------------------------------


@query("enrich_left", "SELECT d.doc_id, d.lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def enrich_left(spark, folder):
    """Every document with its label, null without one."""
    marks = table(spark, folder, "labels").dropDuplicates(["doc_id"])
    return table(spark, folder, "documents").select("doc_id", "lang").join(marks, "doc_id", "left")


@query("join_labels", f"WITH {DESCRIPTORS} SELECT doc_id, quality, n_chars, n_words FROM descriptors JOIN labels USING (doc_id)")
def join_labels(spark, folder):
    """Descriptors of the labelled documents."""
    docs = table(spark, folder, "documents").select(
        "doc_id",
        F.length("text").cast("double").alias("n_chars"),
        F.size(text.tokens(F.col("text"))).cast("double").alias("n_words"),
    )
    return docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")


_ASSEMBLE = """SELECT o.o_orderkey AS cid, c.c_name AS name, n.n_name AS origin, (o.o_orderstatus = 'F')::INT AS label,
  o.o_orderpriority AS concern, p.prob, p.cls
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT id, prob, cls FROM pred WHERE model = 'lr' AND seed = 0) p ON o.o_orderkey = p.id
WHERE (CASE WHEN year(o.o_orderdate) < 1997 THEN 1 ELSE 0 END) = 0"""


@query("assemble_eval", f"WITH {PRED} {_ASSEMBLE}")
def assemble_eval(spark, folder):
    """Evaluation table: three left joins, rows outside the training years, seven columns."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey")
    )
    nations = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("origin"))
    scores = predictions(spark, folder).filter("model = 'lr' AND seed = 0").select(
        F.col("id").alias("o_orderkey"), "prob", "cls"
    )
    joined = (
        orders.withColumn("in_train", F.when(F.year("o_orderdate") < 1997, 1).otherwise(0))
        .filter("in_train = 0")
        .join(customers, "o_custkey", "left")
        .join(nations, "n_nationkey", "left")
        .join(scores, "o_orderkey", "left")
    )
    return joined.select(
        F.col("o_orderkey").alias("cid"), "name", "origin", (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.col("o_orderpriority").alias("concern"), "prob", "cls",
    )


@query("lost_records", "SELECT d.doc_id, left(d.text, 50) AS text FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id ORDER BY d.doc_id LIMIT 10")
def lost_records(spark, folder):
    """The first ten documents without a label, with the start of their text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    lost = docs.join(table(spark, folder, "labels"), "doc_id", "left_anti")
    return lost.orderBy("doc_id").limit(10).select("doc_id", F.substring("text", 1, 50).alias("text"))


@query("append_pred", f"WITH {PRED} SELECT o.o_orderkey, o.o_totalprice, p.prob, p.cls FROM orders o LEFT JOIN pred p ON o.o_orderkey = p.id AND model = 'svm' AND seed = 1")
def append_pred(spark, folder):
    """Predictions appended to the input rows by key."""
    pred = predictions(spark, folder).filter("model = 'svm' AND seed = 1").select(F.col("id").alias("o_orderkey"), "prob", "cls")
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").join(pred, "o_orderkey", "left")
