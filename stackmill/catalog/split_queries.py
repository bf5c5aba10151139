"""Splits, scaling and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackmill.catalog.inputs import (
    CYP,
    LONG,
    MECH,
    MECHANISTIC,
    METRIC_COLUMNS,
    MODELS,
    PRED,
    VECTORS,
    mechanistic,
    predictions,
    sql_folds,
    sql_metrics,
    sql_rounded,
    vectors,
)
from stackmill.catalog.metrics_queries import rounded
from stackmill.catalog.registry import query
from stackmill.functions.hashing import hash_int
from stackmill.operators import metrics as M
from stackmill.operators import neighbors as N
from stackmill.operators import scaling as C
from stackmill.operators import splits as P
from stackmill.operators import stacking as K
from stackmill.session import cut, stored
from stackmill.sources.readers import table

# -- splits ------------------------------------------------------------------------------------------------------------

_LABELLED = "labelled AS (SELECT o_orderkey AS id, (o_orderstatus = 'F')::INT AS label FROM orders)"


def _labelled(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("label")
    )


@query("strat_holdout", f"""WITH {_LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(id || '|' || 7), id) AS rn,
  count(*) OVER (PARTITION BY label) AS n FROM labelled) SELECT id, label, (rn <= round(0.2e0 * n)::BIGINT)::INT AS is_holdout FROM r""")
def strat_holdout(spark, folder):
    """Stratified 80/20 hold-out with seed 7."""
    return P.stratified_holdout(_labelled(spark, folder), "id", "label", seed=7)


_SEEDS = tuple(range(20))
_SEEDS_SQL = ", ".join(map(str, _SEEDS))


@query("strat_kfold", f"WITH {_LABELLED}, {sql_folds('labelled', _SEEDS_SQL)} SELECT id, label, seed, fold FROM folds")
def strat_kfold(spark, folder):
    """Repeated stratified folds: every row is validated once per seed."""
    return P.stratified_folds(_labelled(spark, folder), "id", "label", seeds=_SEEDS)


_WIDE_SPLIT = f"""{sql_folds('labelled', '0, 1')}, wide AS (
  SELECT id, {', '.join(f"max((fold <> {f})::INT) FILTER (seed = {s}) AS c{s}{f}" for s in (0, 1) for f in range(5))} FROM folds GROUP BY id)"""


def _wide_split(spark, folder):
    folds = P.stratified_folds(_labelled(spark, folder), "id", "label", seeds=(0, 1))
    return folds.groupBy("id").agg(
        *[
            F.max(F.when(F.col("seed") == s, (F.col("fold") != f).cast("int"))).alias(f"{s}_skf_{f}")
            for s in (0, 1)
            for f in range(5)
        ]
    )


@query("split_long", f"""WITH {_LABELLED}, {_WIDE_SPLIT}
{' UNION ALL '.join(f"SELECT id, {s} AS seed, {f} AS fold, CASE WHEN c{s}{f} = 1 THEN 'train' ELSE 'validation' END AS role FROM wide" for s in (0, 1) for f in range(5))}""")
def split_long(spark, folder):
    """Stored 0/1 membership columns to one row per (row, seed, fold)."""
    return P.splits_from_wide(_wide_split(spark, folder), "id")


@query("split_audit", f"""WITH {_LABELLED}, {sql_folds('labelled', _SEEDS_SQL)}, members AS (
  SELECT id, seed, s.fold, CASE WHEN s.fold = folds.fold THEN 'validation' ELSE 'train' END AS role FROM folds, (SELECT unnest(range(5)) AS fold) s),
r AS (SELECT seed, id, count(*) FILTER (role = 'validation') AS v, count(*) - count(DISTINCT fold) AS d FROM members GROUP BY 1, 2)
SELECT seed, count(*) AS n_rows, count(*) FILTER (v <> 1) AS n_not_once, count(*) FILTER (d <> 0) AS n_leaked FROM r GROUP BY seed""")
def split_audit(spark, folder):
    """Coverage and leakage of repeated folds."""
    folds = P.stratified_folds(_labelled(spark, folder), "id", "label", seeds=_SEEDS)
    return P.audit(P.fold_members(folds.repartition("seed", "id"), 5))  # one row a seed is shuffled, not one a split


@query("split_semi", f"""WITH {_LABELLED}, {sql_folds('labelled', '0')}
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders SEMI JOIN (SELECT id FROM folds WHERE fold <> 2) t ON o_orderkey = t.id""")
def split_semi(spark, folder):
    """Rows whose id is in the training side of a split."""
    folds = P.stratified_folds(_labelled(spark, folder), "id", "label", seeds=(0,)).filter(F.col("fold") != 2)
    orders = table(spark, folder, "orders").select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))
    return orders.join(folds, F.col("o_orderkey") == F.col("id"), "left_semi")


# -- scaling -----------------------------------------------------------------------------------------------------------

_SPLIT = f"WITH {VECTORS}, {sql_folds('vectors', '1')}, {LONG}"
_FITTED = """
stat AS (SELECT o.f AS fold, l.pos, min(x) AS lo, max(x) AS hi, avg(x) AS mu, stddev_pop(x) AS sd
  FROM (SELECT unnest(range(5)) AS f) o, long l JOIN folds USING (id) WHERE folds.fold <> o.f GROUP BY 1, 2)"""


def folded_vectors(spark, folder, seeds=(1,)):
    """Vectors with their fold: only ids and labels go through the ranking; the stored split is joined once."""
    rows = vectors(spark, folder)
    folds = cut(P.stratified_folds(rows.select("id", "label"), "id", "label", seeds=seeds))
    return rows.join(folds.drop("label"), "id")


def _scaled_summary(spark, folder, kind):
    own = folded_vectors(spark, folder)
    rows = C.scale(own, C.train_stats(own), ["seed", "fold"], kind)
    return rows.select("id", "fold", F.posexplode_outer("features").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("minmax_apply", f"{_SPLIT}, {_FITTED} SELECT long.id, folds.fold, pos::INT AS pos, round((x - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS x FROM long JOIN folds USING (id) JOIN stat USING (fold, pos)")
def minmax_apply(spark, folder):
    """Min-max scaling fitted on the training side, applied to the validation rows."""
    return _scaled_summary(spark, folder, "minmax")


@query("standardize_apply", f"{_SPLIT}, {_FITTED} SELECT long.id, folds.fold, pos::INT AS pos, round((x - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS x FROM long JOIN folds USING (id) JOIN stat USING (fold, pos)")
def standardize_apply(spark, folder):
    """Standardisation with the population deviation of the training side."""
    return _scaled_summary(spark, folder, "standard")


_IMPUTED_COLUMNS = [*MECH, *CYP]
_IMPUTED = f"""means AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in _IMPUTED_COLUMNS)} FROM mech WHERE year < 1997),
imputed AS (SELECT id, year, {', '.join(f'coalesce({c}, m_{c}) AS {c}, ({c} IS NULL)::INT AS {c}_imputed' for c in _IMPUTED_COLUMNS)} FROM mech, means)"""


def _imputed(spark, folder):
    rows = stored(mechanistic(spark, folder), "mechanistic")  # one aggregation of the lines for all later passes
    return C.impute_with_flag(rows, _IMPUTED_COLUMNS, fit_on=F.col("year") < 1997)


@query("impute_flag", f"WITH {MECHANISTIC}, {_IMPUTED} SELECT id, {', '.join(f'round({c}, 6) AS {c}, {c}_imputed' for c in _IMPUTED_COLUMNS)} FROM imputed")
def impute_flag(spark, folder):
    """Missing mechanistic values filled with the training mean, with a flag."""
    return rounded(_imputed(spark, folder).drop("year"), _IMPUTED_COLUMNS)


_FLAGS = ["bsep_imputed", "cyto_imputed"]
_BLOCK_COLUMNS = [*MECH, *CYP, *_FLAGS]
_SCALED = f"""fit AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _BLOCK_COLUMNS)} FROM imputed WHERE year < 1997),
scaled AS (SELECT id, {', '.join(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS z_{c}' for c in _BLOCK_COLUMNS)} FROM imputed, fit)"""
_BLOCKS = {"mech": MECH, "cyp": CYP, "flags": _FLAGS}


def _blocks(spark, folder):
    return C.scale_blocks(_imputed(spark, folder), _BLOCKS, F.col("year") < 1997, ["id"])


@query("block_scale", f"WITH {MECHANISTIC}, {_IMPUTED}, {_SCALED} SELECT id, {', '.join(f'round(z_{c}, 6) AS {c}' for c in _BLOCK_COLUMNS)} FROM scaled")
def block_scale(spark, folder):
    """Every block of columns standardised by its own scaler."""
    out = _blocks(spark, folder)
    return out.select(
        "id",
        *[F.round(F.get(b, F.lit(i)), 6).alias(c) for b, names in _BLOCKS.items() for i, c in enumerate(names)],
    )


@query("cyp_interaction", f"WITH {MECHANISTIC}, {_IMPUTED}, {_SCALED} SELECT id, round(z_cyto * (z_cyp_a + z_cyp_b + z_cyp_c), 6) AS interaction FROM scaled")
def cyp_interaction(spark, folder):
    """Scaled cytotoxicity times the sum of the scaled enzyme columns."""
    return _blocks(spark, folder).select(
        "id", F.round(K.cyp_interaction(F.get("mech", F.lit(1)), F.col("cyp")), 6).alias("interaction")
    )


def _probs(spark, folder):
    mean = K.wide(predictions(spark, folder), ["id"], F.col("model"), MODELS, how=F.avg)
    return mean.select("id", F.array(*MODELS).alias("probs"))


_PROBS = f"probs AS (SELECT id, {', '.join(f'avg(prob) FILTER (model = {chr(39)}{m}{chr(39)}) AS p_{m}' for m in MODELS)} FROM pred GROUP BY id)"


def _sql_vector(parts) -> str:
    return f"WITH {PRED}, {MECHANISTIC}, {_IMPUTED}, {_SCALED}, {_PROBS}, v AS (SELECT id, [{', '.join(parts)}] AS f FROM scaled JOIN probs USING (id)) SELECT id, i::INT - 1 AS pos, round(f[i], 7) AS x FROM v, range(1, {len(parts)} + 1) t(i)"


_P = [f"p_{m}" for m in MODELS]


def _exploded(df, vector):
    return df.select("id", F.posexplode_outer(vector).alias("pos", "x")).withColumn("x", F.round("x", 7))


@query("v2_vector", _sql_vector([*_P, *[f"z_{c}" for c in (*MECH, *_FLAGS)]]))
def v2_vector(spark, folder):
    """Meta vector: base probabilities and scaled mechanistic columns."""
    rows = _blocks(spark, folder).join(_probs(spark, folder), "id")
    return _exploded(rows, K.meta_vector_v2(F.col("probs"), F.concat("mech", "flags")))


@query("v3_vector", _sql_vector([*_P, *[f"z_{c}" for c in (*MECH, *CYP, *_FLAGS)], "z_cyto * (z_cyp_a + z_cyp_b + z_cyp_c)"]))
def v3_vector(spark, folder):
    """Meta vector with enzyme columns, flags and the interaction."""
    rows = _blocks(spark, folder).join(_probs(spark, folder), "id")
    return _exploded(rows, K.meta_vector_v3(F.col("probs"), F.col("mech"), F.col("cyp"), F.col("flags")))


# -- nearest neighbours ------------------------------------------------------------------------------------------------

_SCALED_LONG = """
sc AS (SELECT long.id, long.label, o.f AS fold, CASE WHEN folds.fold = o.f THEN 'validation' ELSE 'train' END AS role, long.pos,
    (x - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS x
  FROM long JOIN folds USING (id), (SELECT unnest(range(5)) AS f) o, stat WHERE stat.fold = o.f AND stat.pos = long.pos),
vec AS (SELECT id, label, fold, role, list(x ORDER BY pos) AS v FROM sc GROUP BY ALL)"""


def _sql_neighbours(k: int, metric: str = "euclidean", source: str = "vec", group: str = "fold") -> str:
    dist = (
        "list_distance(q.v, t.v)" if metric == "euclidean"
        else "list_sum(list_transform(range(1, len(q.v) + 1), lambda i: abs(q.v[i] - t.v[i])))"
    )
    return f"""
dist AS (SELECT q.{group}, q.id, q.label AS y_true, t.id AS neighbour, t.label, {dist} AS distance
  FROM {source} q JOIN {source} t ON q.{group} = t.{group} AND q.role = 'validation' AND t.role = 'train'),
nn AS (SELECT *, row_number() OVER (PARTITION BY {group}, id ORDER BY distance, neighbour) AS rank FROM dist QUALIFY rank <= {k})"""


def _fold_neighbours(spark, folder, k, metric="euclidean"):
    own = folded_vectors(spark, folder).drop("seed")
    stats = cut(C.train_stats(own, keys=[]))  # one row per split
    rows = P.fold_members(own, 5)
    queries, train = rows.filter("role = 'validation'"), rows.filter("role = 'train'")
    return N.knn_join(queries, train, k, groups=["fold"], metric=metric, scaler=stats)


def _sql_knn(k: int, metric: str = "euclidean") -> str:
    return f"{_SPLIT}, {_FITTED}, {_SCALED_LONG}, {_sql_neighbours(k, metric)}"


@query("knn_fold_mcc", f"""{_sql_knn(7)}, vote AS (SELECT fold, id, any_value(y_true) AS y_true, avg(label) AS prob, (avg(label) > 0.5e0)::INT AS cls FROM nn GROUP BY 1, 2),
{sql_metrics('vote', 'fold')} SELECT fold::INT AS fold, tn, fp, fn, tp, {sql_rounded(METRIC_COLUMNS)} FROM m""")
def knn_fold_mcc(spark, folder):
    """Metrics of the 7-nearest-neighbour base classifier on every fold."""
    votes = N.vote(_fold_neighbours(spark, folder, 7), ["fold"])
    truth = vectors(spark, folder).select("id", F.col("label").alias("y_true"))
    return rounded(M.run_metrics(votes.join(truth, "id"), ["fold"]), METRIC_COLUMNS)


@query("knn_vote", f"{_sql_knn(7)} SELECT fold::INT AS fold, id, round(avg(label), 6) AS prob FROM nn GROUP BY 1, 2")
def knn_vote(spark, folder):
    """Share of positives among the 7 nearest training rows of every validation row."""
    return rounded(N.vote(_fold_neighbours(spark, folder, 7), ["fold"]), ["prob"])


@query("knn_weighted", f"""{_sql_knn(7)} SELECT fold::INT AS fold, id, round(CASE WHEN count(*) FILTER (distance = 0) > 0
  THEN avg(label) FILTER (distance = 0) ELSE sum(label / distance) FILTER (distance > 0) / sum(1 / distance) FILTER (distance > 0) END, 6) AS prob FROM nn GROUP BY 1, 2""")
def knn_weighted(spark, folder):
    """Votes weighted by 1/distance."""
    return rounded(N.vote(_fold_neighbours(spark, folder, 7), ["fold"], weights="distance"), ["prob"])


@query("knn_manhattan", f"{_sql_knn(7, 'manhattan')} SELECT fold::INT AS fold, id, round(avg(label), 6) AS prob FROM nn GROUP BY 1, 2")
def knn_manhattan(spark, folder):
    """Votes of the 7 nearest rows by the Manhattan metric."""
    return rounded(N.vote(_fold_neighbours(spark, folder, 7, "manhattan"), ["fold"]), ["prob"])


@query("knn_k_grid", f"""{_sql_knn(11)}, ks AS (SELECT unnest([3, 5, 7, 11]) AS k)
SELECT fold::INT AS fold, id, k, round(avg(label), 6) AS prob FROM nn JOIN ks ON rank <= k GROUP BY ALL""")
def knn_k_grid(spark, folder):
    """Votes for k = 3, 5, 7 and 11 from one join."""
    return rounded(N.vote_grid(_fold_neighbours(spark, folder, 11), (3, 5, 7, 11), ["fold"]), ["prob"])


_LARGE = f"""WITH {VECTORS}, vec AS (SELECT 0 AS part, id, label, features AS v, CASE WHEN {"('0x' || substr(md5(id::VARCHAR), 1, 7))::BIGINT"} % 5 = 0 THEN 'validation' ELSE 'train' END AS role FROM vectors),
{_sql_neighbours(11, group='part')}"""


@query("knn_large", f"{_LARGE} SELECT id, neighbour, rank::BIGINT AS rank, round(distance, 6) AS distance FROM nn")
def knn_large(spark, folder):
    """The 11 nearest rows by the pivot-cell join that a large training side takes."""
    rows = vectors(spark, folder).withColumn("held", hash_int(F.col("id").cast("string")) % 5 == 0)
    found = N.knn_join(rows.filter("held"), rows.filter("NOT held"), 11, min_pivots=16)
    return found.select("id", "neighbour", "rank", F.round("distance", 6).alias("distance"))

