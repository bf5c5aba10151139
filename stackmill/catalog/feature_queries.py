"""String descriptors, feature profiles and feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackmill.catalog.inputs import DESCRIPTORS, LONG, VECTORS, described, labelled, sql_hash, vectors
from stackmill.catalog.metrics_queries import rounded
from stackmill.catalog.registry import query
from stackmill.functions import text as X
from stackmill.operators import quality as Q
from stackmill.operators import selection as S
from stackmill.session import dealt, spread, stored
from stackmill.sources.readers import table

_BITS = f"""
grams AS (SELECT doc_id, list_distinct(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM words),
bits AS (SELECT DISTINCT doc_id, ({sql_hash('gram')} % 1024)::INT AS bit FROM (SELECT doc_id, unnest(g) AS gram FROM grams))"""


def _words(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return docs.withColumn("words", X.tokens(F.col("text")))


@query("hashed_fingerprint", f"WITH {DESCRIPTORS}, {_BITS} SELECT doc_id, bit FROM bits")
def hashed_fingerprint(spark, folder):
    """Set bits of the hashed n-gram fingerprint of every document."""
    rows = _words(spark, folder).select("doc_id", X.hashed_bits(F.col("words"), 1024).alias("bits"))
    return rows.select("doc_id", F.explode_outer("bits").alias("bit")).filter(F.col("bit").isNotNull())


_KEYS = ", ".join(f"regexp_matches(text, '{p}')::INT AS MACCS_{i}" for i, p in enumerate(X.STRUCTURE_PATTERNS))


@query("pattern_keys", f"SELECT doc_id, {_KEYS} FROM documents")
def pattern_keys(spark, folder):
    """One 0/1 column per structural pattern."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    rows = docs.select("doc_id", X.key_bits(F.col("text")).alias("keys"))
    return rows.select(
        "doc_id", *[F.get("keys", F.lit(i)).alias(f"MACCS_{i}") for i in range(len(X.STRUCTURE_PATTERNS))]
    )


@query("lexical_descriptors", f"WITH {DESCRIPTORS} SELECT doc_id, {', '.join(f'round({n}, 6) AS {n}' for n in X.DESCRIPTOR_NAMES)} FROM descriptors")
def lexical_descriptors(spark, folder):
    """Counts and shares of every document."""
    rows = X.lexical_descriptors(_words(spark, folder), "text", "words")
    return rows.select("doc_id", *[F.round(n, 6).alias(n) for n in X.DESCRIPTOR_NAMES])


@query("generate_descriptors", f"""WITH {DESCRIPTORS}, {_BITS}, b AS (SELECT doc_id, count(*) AS n_bits, sum(bit)::BIGINT AS bit_sum FROM bits GROUP BY 1)
SELECT doc_id, n_words > 0 AS valid, round({' + '.join(X.DESCRIPTOR_NAMES)}, 6) AS total, coalesce(n_bits, 0)::BIGINT AS n_bits, coalesce(bit_sum, 0)::BIGINT AS bit_sum,
  ({' + '.join(f"regexp_matches(text, '{p}')::INT" for p in X.STRUCTURE_PATTERNS)})::BIGINT AS n_keys
FROM descriptors LEFT JOIN b USING (doc_id) JOIN (SELECT doc_id, text FROM documents) d USING (doc_id)""")
def generate_descriptors(spark, folder):
    """The descriptor job: validity, descriptors, fingerprint and keys of every document in one projection."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    rows = X.describe(docs, "text", ["doc_id"])
    add = lambda c, zero: F.aggregate(c, zero, lambda acc, v: acc + v)
    big = F.lit(0).cast("bigint")
    return rows.select(
        "doc_id",
        "valid",
        F.round(add("descriptors", F.lit(0.0)), 6).alias("total"),
        F.size("bits").cast("bigint").alias("n_bits"),
        add("bits", big).alias("bit_sum"),
        add("keys", big).alias("n_keys"),
    )


_N_BITS = 1024
_PART = "part_text AS (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS s FROM part)"
_PART_BITS = f"""pw AS (SELECT p_partkey, list_filter(string_split_regex(s, '[ \\t\\r\\n]+'), lambda t: t <> '') AS w FROM part_text),
pb AS (SELECT p_partkey, list_transform(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), lambda g: {sql_hash('g')} % {_N_BITS}) AS b FROM pw)"""


def _part_bits(spark, folder):
    rows = dealt(table(spark, folder, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("s")))
    words = rows.withColumn("words", X.tokens(F.col("s")))
    return words.select("p_partkey", X.hashed_bits(F.col("words"), _N_BITS).alias("bits"))


@query("bits_to_columns", f"WITH {_PART}, {_PART_BITS} SELECT p_partkey, {', '.join(f'list_contains(b, {j})::INT AS Morgan_{j}' for j in range(_N_BITS))} FROM pb")
def bits_to_columns(spark, folder):
    """Fingerprint bits as 0/1 columns."""
    return X.bits_to_columns(_part_bits(spark, folder), "bits", _N_BITS, "Morgan_", ["p_partkey"])


@query("combine_features", f"""WITH {_PART}, {_PART_BITS}, f AS (SELECT p_partkey, list_concat([p_size::DOUBLE, p_retailprice], list_transform(range(0, {_N_BITS}), lambda j: list_contains(b, j)::DOUBLE)) AS f
  FROM part JOIN pb USING (p_partkey)) SELECT p_partkey, len(f)::INT AS n, i::INT - 1 AS pos, f[i] AS x FROM f, range(1, {_N_BITS + 3}) t(i) WHERE f[i] <> 0""")
def combine_features(spark, folder):
    """Two feature sets side by side in one vector: its length, and its entries that are not 0."""
    numbers = table(spark, folder, "part").select(
        "p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("a")
    )
    both = numbers.join(_part_bits(spark, folder), "p_partkey")  # the bits are hashed before the join, once a row
    return X.side_by_side(both, "a", "bits", _N_BITS, ["p_partkey"])


# -- profiles ----------------------------------------------------------------------------------------------------------


@query("class_balance", """WITH c AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1)
SELECT label, n, sum(n) OVER ()::BIGINT AS n_rows, round(n / sum(n) OVER (), 6) AS share, round(min(n) OVER () / max(n) OVER (), 6) AS class_ratio,
  min(n) OVER () / max(n) OVER () < 0.2 AS imbalanced FROM c""")
def class_balance(spark, folder):
    """Rows per class, ratio and imbalance warning."""
    return rounded(Q.class_balance(table(spark, folder, "labels"), "quality"), ["share", "class_ratio"])


@query("class_weights", """WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
SELECT doc_id, quality, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM labels JOIN c USING (quality)""")
def class_weights(spark, folder):
    """Balanced class weight of every labelled row."""
    marks = table(spark, folder, "labels").select("doc_id", "quality")
    return rounded(Q.class_weights(marks, "quality"), ["weight"]).select("doc_id", "quality", "weight")


_LABELLED = f"WITH {DESCRIPTORS}, labelled AS (SELECT d.*, quality AS label FROM descriptors d JOIN labels USING (doc_id))"


@query("data_quality", f"""{_LABELLED}, c AS (SELECT label, count(*) AS n FROM labelled GROUP BY 1), p AS (
  SELECT (SELECT count(*) FROM labelled) AS n_samples, {len(X.DESCRIPTOR_NAMES)} AS n_features, (SELECT count(*) FROM c) AS n_classes,
    (SELECT min(n) / max(n) FROM c) AS class_ratio,
    (SELECT {' + '.join(f'(max({n}) = min({n}))::BIGINT' for n in X.DESCRIPTOR_NAMES)} FROM labelled) AS n_constant)
SELECT n_samples, n_features, n_classes, round(class_ratio, 6) AS class_ratio, 0::BIGINT AS n_nan, 0::BIGINT AS n_inf, n_constant,
  concat_ws('; ', CASE WHEN n_samples < 100 THEN 'Sample size (' || n_samples || ') below minimum (100)' END) AS issues,
  concat_ws('; ', CASE WHEN class_ratio < 0.2 THEN printf('Imbalanced classes: ratio = %.2f', class_ratio) END,
    CASE WHEN n_constant > 0 THEN 'Constant features: ' || n_constant END) AS warnings, n_samples >= 100 AS is_valid FROM p""")
def data_quality(spark, folder):
    """Profile of the labelled descriptor table."""
    out = Q.data_quality(labelled(spark, folder))
    return rounded(out, ["class_ratio"]).withColumns(
        {c: F.array_join(c, "; ") for c in ("issues", "warnings")}
    )


_PAIRS = ", ".join(
    f"{{'a': {i}, 'b': {j}, 'r': corr({a}, {b})}}"
    for i, a in enumerate(X.DESCRIPTOR_NAMES)
    for j, b in enumerate(X.DESCRIPTOR_NAMES)
    if i < j
)
_CORR = f"""WITH {DESCRIPTORS}, r AS (SELECT unnest([{_PAIRS}]) AS s FROM descriptors),
pairs AS (SELECT s.a AS a, s.b AS b, s.r AS r FROM r WHERE NOT isnan(s.r))"""


def _stored_descriptors(spark, folder):
    """The descriptor table, written once: a correlation reads it several times."""
    return stored(described(spark, folder), "descriptors")


@query("high_corr_pairs", f"{_CORR} SELECT a, b, round(r, 6) AS r FROM pairs WHERE abs(r) > 0.95")
def high_corr_pairs(spark, folder):
    """Descriptor pairs with an absolute correlation above 0.95."""
    return rounded(Q.high_correlation(Q.feature_correlations(_stored_descriptors(spark, folder))), ["r"])


@query("pearson_filter", f"{_CORR} SELECT DISTINCT b AS pos FROM pairs WHERE abs(r) > 0.9")
def pearson_filter(spark, folder):
    """Descriptors with an earlier partner above 0.9."""
    return Q.redundant_features(Q.feature_correlations(_stored_descriptors(spark, folder)))


@query("corr_filter", f"WITH {VECTORS}, {LONG}, c AS (SELECT pos::INT AS pos, corr(x, label) AS score FROM long GROUP BY pos) SELECT pos, round(score, 6) AS score FROM c WHERE score > 0.02")
def corr_filter(spark, folder):
    """Features whose correlation with the label exceeds a threshold."""
    scores = S.feature_label_correlation(vectors(spark, folder))
    return rounded(scores.filter(F.col("score") > 0.02), ["score"])


@query("variance_topn", f"""WITH {VECTORS}, {LONG}, s AS (SELECT pos::INT AS pos, round(var_pop(x), 9) AS score FROM long GROUP BY pos)
SELECT pos, score, row_number() OVER (ORDER BY score DESC, pos) AS rank FROM s QUALIFY rank <= 20""")
def variance_topn(spark, folder):
    """The 20 features with the largest variance."""
    return S.top_features(S.feature_variance(vectors(spark, folder)), 20, digits=9)


_MI = f"""WITH {VECTORS}, {LONG}, rg AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM long GROUP BY pos),
binned AS (SELECT pos::INT AS pos, label, least(15, floor(16e0 * (x - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END))::INT AS bin FROM long JOIN rg USING (pos)),
cells AS (SELECT pos, bin, label, count(*)::DOUBLE AS n FROM binned GROUP BY ALL),
j AS (SELECT pos, n, sum(n) OVER (PARTITION BY pos) AS t, sum(n) OVER (PARTITION BY pos, bin) AS b, sum(n) OVER (PARTITION BY pos, label) AS c FROM cells),
mi AS (SELECT pos, round(sum(n / t * ln(n * t / (b * c))), 9) AS score FROM j GROUP BY pos)"""


@query("mi_scores", f"{_MI} SELECT pos, score FROM mi")
def mi_scores(spark, folder):
    """Binned mutual information of every feature with the label."""
    return rounded(S.mutual_information(vectors(spark, folder)), ["score"], 9)


@query("topn_features", f"{_MI} SELECT pos, score, row_number() OVER (ORDER BY score DESC, pos) AS rank FROM mi QUALIFY rank <= 10")
def topn_features(spark, folder):
    """The ten features with the largest mutual information."""
    return S.top_features(S.mutual_information(vectors(spark, folder)), 10, digits=9)
