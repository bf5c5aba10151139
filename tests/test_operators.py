"""Operators against plain computations on small fixtures, with hot keys, ties, copies and missing values."""

import json
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from stackmill.functions import arrays, scores, text
from stackmill.catalog import feature_queries
from stackmill.operators import clean, metrics, neighbors, quality, scaling, selection, splits, stacking
from stackmill.operators.ranks import ranked, running
from stackmill.sources import readers, writers


def skewed(n=600, seed=3):
    """A third of the rows share one key."""
    draw = random.Random(seed)
    return [
        Row(id=i, key="hot" if draw.random() < 0.34 else f"k{draw.randrange(5)}", t=draw.randrange(200), v=draw.random())
        for i in range(n)
    ]


def test_ranked_equals_window(spark):
    df = spark.createDataFrame(skewed()).withColumn("b", F.floor(F.col("t") / 20))
    got = ranked(df, ["key"], "b", ["t", "id"], rank="rn", size="n")
    plain = Window.partitionBy("key").orderBy("t", "id")
    want = df.withColumn("rn", F.row_number().over(plain).cast("bigint")).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    assert sorted(got.select("id", "rn", "n").collect()) == sorted(want.select("id", "rn", "n").collect())


def test_ranked_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, None, 0), (2, None, 1), (3, "a", 0)], "id long, key string, b long")
    assert sorted(ranked(df, ["key"], "b", ["id"]).select("id", "rn").collect()) == [(1, 1), (2, 2), (3, 1)]


def test_running_equals_window(spark):
    df = spark.createDataFrame(skewed()).withColumn("b", F.floor(F.col("t") / 20))
    got = running(df, ["key"], "b", ["t", "id"], "v", "best")
    before = Window.partitionBy("key").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("best", F.max("v").over(before))
    assert sorted(map(str, got.select("id", "best").collect())) == sorted(map(str, want.select("id", "best").collect()))


def test_folds_partition_rows_evenly(spark):
    rows = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(301)], "id long, label int")
    folds = splits.stratified_folds(rows, "id", "label", seeds=(0, 1), folds=5)
    counts = {(r["seed"], r["label"], r["fold"]): r["count"] for r in folds.groupBy("seed", "label", "fold").count().collect()}
    for seed in (0, 1):
        for label in (0, 1):
            sizes = [counts[seed, label, f] for f in range(5)]
            assert max(sizes) - min(sizes) <= 1
    assert folds.count() == 602 and folds.select("id", "seed").distinct().count() == 602
    audit = splits.audit(splits.fold_members(folds, 5)).collect()
    assert all(r["n_not_once"] == 0 and r["n_leaked"] == 0 for r in audit)
    other = rows.orderBy(F.desc("id")).repartition(7)
    assert sorted(splits.stratified_folds(other, "id", "label", (0, 1), 5).collect()) == sorted(folds.select(*other.columns, "seed", "fold").collect())


def test_audit_finds_leaks(spark):
    bad = spark.createDataFrame([(1, 0, 0, "train"), (1, 0, 0, "validation"), (2, 0, 0, "train")], "id long, seed int, fold int, role string")
    row = splits.audit(bad).first()
    assert (row["n_not_once"], row["n_leaked"]) == (1, 1)


def test_split_from_status_columns(spark):
    wide = spark.createDataFrame([(4, "train", 5, "train"), (5, "validation", None, None)], "`0_skf_0` int, `0_skf_0_status` string, `0_skf_1` int, `0_skf_1_status` string")
    got = {tuple(r) for r in splits.splits_from_status(wide).collect()}
    assert got == {(4, 0, 0, "train"), (5, 0, 0, "validation"), (5, 0, 1, "train")}


def plain_auc(y, p):
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("shape", ["ties", "tiny", "extremes"])
def test_auc(spark, shape):
    draw = random.Random(5)
    p = {
        "ties": [draw.randrange(8) / 7 for _ in range(400)],
        "tiny": [draw.random() * 1e-9 for _ in range(400)],
        "extremes": [draw.choice([0.0, 1.0, 1 - 1e-16, 1e-300, draw.random()]) for _ in range(400)],
    }[shape]
    y = [int(draw.random() < 0.3 + 0.3 * (x > 0.5)) for x in p]
    df = spark.createDataFrame(list(zip(y, p)), "y_true int, prob double")
    got = metrics.auc(df).first()["auc"]
    assert got == pytest.approx(plain_auc(y, p), abs=1e-12)
    flipped = df.withColumn("y_true", 1 - F.col("y_true"))
    assert metrics.auc(flipped).first()["auc"] == pytest.approx(1 - got, abs=1e-12)


def test_one_class_gives_half(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.9), ("b", 0, 0.2), ("b", 1, 0.9)], "run string, y_true int, prob double")
    rows = {r["run"]: r for r in metrics.run_metrics(df, ["run"]).collect()}
    assert rows["a"]["auc"] == 0.5 and rows["a"]["mcc"] == 0.0 and rows["a"]["specificity"] is None
    assert rows["b"]["auc"] == 1.0 and rows["b"]["mcc"] == 1.0


def test_threshold_is_strict(spark):
    assert spark.range(1).select(scores.threshold_class(F.lit(0.5))).first()[0] == 0


def test_mcc_is_symmetric_and_survives_large_counts(spark):
    big = 3_000_000_000
    df = spark.createDataFrame([(big, 2 * big, big, 5 * big), (5 * big, big, 2 * big, big)], "tn long, fp long, fn long, tp long")
    a, b = (r[0] for r in df.select(scores.mcc()).collect())
    assert a == pytest.approx(b) and a == pytest.approx((5 - 2) / math.sqrt(7 * 6 * 3 * 2))


def matrix_rows(n, d, seed, copies=0.0):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, d)) * np.arange(1, d + 1)
    x[: int(copies * n)] = x[0]
    return x


def as_table(spark, x, labels, start=0, **extra):
    rows = [(start + i, [float(v) for v in r], float(y)) for i, (r, y) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "id long, features array<double>, label double").withColumns({k: F.lit(v) for k, v in extra.items()})


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("pivots", [1, 9])
def test_knn_is_exact_with_a_hot_group_of_copies(spark, metric, pivots):
    train, query = matrix_rows(300, 6, 1, copies=0.34), matrix_rows(80, 6, 2)
    query[:30] = train[0]
    y = np.arange(300) % 2
    t, q = as_table(spark, train, y), as_table(spark, query, np.zeros(80), start=1000).drop("label")
    found = neighbors.knn_join(q, t, 7, metric=metric, n_pivots=pivots, block_rows=40).collect()
    got = {}
    for r in found:
        got.setdefault(r["id"], {})[r["rank"]] = (r["neighbour"], r["distance"])
    for i in range(80):
        gap = np.abs(train - query[i]).sum(1) if metric == "manhattan" else np.sqrt(((train - query[i]) ** 2).sum(1))
        order = np.lexsort((np.arange(300), gap))[:7]
        assert [got[1000 + i][k + 1][0] for k in range(7)] == list(order)
        assert [got[1000 + i][k + 1][1] for k in range(7)] == pytest.approx(gap[order])


def test_knn_with_fewer_rows_than_k_and_groups(spark):
    t = as_table(spark, matrix_rows(3, 2, 1), [1, 0, 1], fold=0).unionByName(as_table(spark, matrix_rows(9, 2, 3), [0] * 9, fold=1))
    q = as_table(spark, matrix_rows(4, 2, 2), [0] * 4, fold=0).unionByName(as_table(spark, matrix_rows(4, 2, 2), [0] * 4, fold=1)).drop("label")
    for pivots in (1, 3):
        found = neighbors.knn_join(q, t, 5, groups=["fold"], n_pivots=pivots, block_rows=2)
        sizes = {(r["fold"], r["id"]): r["count"] for r in found.groupBy("fold", "id").count().collect()}
        assert sizes == {**{(0, i): 3 for i in range(4)}, **{(1, i): 5 for i in range(4)}}


def test_distance_votes(spark):
    rows = [(1, 0.0, 1.0, 1), (1, 2.0, 0.0, 2), (2, 1.0, 1.0, 1), (2, 2.0, 0.0, 2)]
    df = spark.createDataFrame(rows, "id long, distance double, label double, rank long")
    got = dict(map(tuple, neighbors.vote(df, weights="distance").collect()))
    assert got[1] == 1.0 and got[2] == pytest.approx(1 / 1.5)


def test_train_stats_equal_direct_fit(spark):
    x = matrix_rows(60, 4, 7)
    x[:, 2] = 5.0
    df = as_table(spark, x, np.zeros(60)).withColumn("fold", (F.col("id") % 3).cast("int")).withColumn("seed", F.lit(0))
    for r in scaling.train_stats(df).collect():
        rest = x[np.arange(60) % 3 != r["fold"]]
        assert r["n"] == len(rest) and r["std"][2] == 0.0
        for name, want in (("low", rest.min(0)), ("high", rest.max(0)), ("mean", rest.mean(0)), ("std", rest.std(0))):
            assert r[name] == pytest.approx(list(want), abs=1e-9)


def test_scaled_train_rows_lie_in_unit_range_and_constants_shift(spark):
    x = matrix_rows(50, 3, 4)
    x[:, 1] = 2.5
    df = as_table(spark, x, np.zeros(50))
    stats = scaling.feature_stats(df)
    got = np.array([r[0] for r in scaling.scale(df, stats).select("features").collect()])
    assert got.min() >= 0 and got.max() <= 1 and (got[:, 1] == 0).all()
    z = np.array([r[0] for r in scaling.scale(df, stats, kind="standard").select("features").collect()])
    assert z.mean(0) == pytest.approx([0, 0, 0], abs=1e-9) and z.std(0)[[0, 2]] == pytest.approx([1, 1])


def test_clean_and_coerce(spark):
    df = spark.createDataFrame([([float("nan"), float("inf"), None, -1.5],)], "x array<double>")
    assert df.select(arrays.clean(F.col("x"))).first()[0] == [0.0, 0.0, 0.0, -1.5]
    words = spark.createDataFrame([("1.5",), ("abc",), (None,), ("NaN",)], "s string")
    assert [r[0] for r in words.select(arrays.numeric_or_zero(F.col("s"))).collect()] == [1.5, 0.0, 0.0, 0.0]


def test_row_ids_are_dense_and_ordered(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    got = sorted(clean.with_row_ids(df, ["k"], "n").collect())
    assert got == [(i, i) for i in range(1000)]
    assert clean.with_row_ids(df.filter("k < 0"), ["k"], "n").count() == 0


def test_label_spellings(spark):
    df = spark.createDataFrame([("vMOST-DILI-concern",), ("Less-DILI-Concern",), ("vNo-DILI-Concern",), ("Ambiguous-DILI-concern",), ("other",)], "c string")
    got = sorted(map(tuple, clean.map_labels(df, clean.concern_key(F.col("c"))).collect()))
    assert got == [("Less-DILI-Concern", 1), ("vMOST-DILI-concern", 1), ("vNo-DILI-Concern", 0)]
    assert [tuple(r) for r in clean.unmapped(df, clean.concern_key(F.col("c"))).collect()] == [("other", 1)]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="missing 2 columns"):
        clean.require_columns(spark.range(1), ["id", "a", "b"])


def test_data_quality_reports(spark):
    rows = [(i, [1.0, float("nan") if i == 0 else 2.0 * i, float("inf") if i == 1 else 0.5 * i], int(i < 3)) for i in range(50)]
    row = quality.data_quality(spark.createDataFrame(rows, "id long, features array<double>, label int")).first()
    assert (row["n_samples"], row["n_nan"], row["n_inf"], row["n_constant"], row["is_valid"]) == (50, 1, 1, 1, False)
    assert row["issues"] == ["Sample size (50) below minimum (100)", "NaN values found: 1", "Inf values found: 1"]
    assert row["warnings"] == ["Imbalanced classes: ratio = 0.06", "Constant features: 1"]


def test_stability_of_zero_mean_and_equal_scores(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", -0.5), ("b", 0.4), ("b", 0.4)], "model string, mcc double")
    rows = {r["model"]: r for r in quality.stability(df, ["model"], F.col("mcc")).collect()}
    assert math.isinf(rows["a"]["cv_coefficient"]) and not rows["a"]["is_stable"]
    assert rows["a"]["warnings"][-1] == "Negative mcc in some folds"
    assert rows["b"]["is_stable"] and rows["b"]["warnings"] == []


def test_top_fraction_keeps_at_least_one_and_the_later_tie(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.2), ("b", 2, 0.2)], "model string, run int, mcc double")
    got = {(r["model"], r["run"]) for r in selection.top_fraction(df, "model", "mcc", ["run"]).collect()}
    assert got == {("a", 1), ("b", 2)}


def test_wide_has_one_column_per_run(spark):
    rows = [(i, m, i / 10 + j) for i in range(4) for j, m in enumerate("abc") if (i, m) != (2, "b")]
    df = spark.createDataFrame(rows, "id long, model string, prob double")
    got = sorted(map(tuple, stacking.wide(df, ["id"], F.col("model"), list("abc")).collect()))
    have = {(i, m): p for i, m, p in rows}
    assert got == [(i, *[have.get((i, m)) for m in "abc"]) for i in range(4)] and got[2] == (2, 0.2, None, 2.2)
    many = [f"r{j}" for j in range(150)]
    wide = spark.range(3).select("id", F.explode(F.array(*map(F.lit, many))).alias("model"), F.lit(0.5).alias("prob"))
    out = stacking.wide(wide, ["id"], F.col("model"), many)
    assert out.columns == ["id", *many] and [r[150] for r in out.collect()] == [0.5] * 3


def test_fingerprint_of_short_and_empty_texts(spark):
    df = spark.createDataFrame([("",), ("one",), ("one two",)], "s string")
    got = [r[0] for r in df.select(text.hashed_bits(text.tokens(F.col("s")), 64)).collect()]
    assert [len(b) for b in got] == [0, 1, 3] and set(got[1]) <= set(got[2])


def test_run_names_and_performance_lists(spark):
    df = spark.createDataFrame([("knn_seed_3_skf_12_paras_x_K_7", "[1, 2, 3, 4, 0.12349, 0.5]"), ("bad", "[]")], "n string, v string")
    name = text.parse_run_name(F.col("n"))
    perf = text.parse_performance(F.col("v"), ("tn", "fp", "fn", "tp", "accuracy", "auc"))
    got = df.select(*[c.alias(k) for k, c in {**name, **perf}.items()]).collect()
    assert tuple(got[0]) == ("knn", 3, 12, "x_K_7", 1, 2, 3, 4, 0.123, 0.5)
    assert got[1]["seed"] is None and got[1]["tn"] is None


def test_state_documents(spark, tmp_path):
    state = {"iteration": 2, "current_best": {"model": None, "mcc": 0.0}, "history": [{"iteration": 1, "action": "a", "success": True}]}
    (tmp_path / "state.json").write_text(json.dumps(state, indent=2))
    row = readers.read_ledger(spark, str(tmp_path)).first()
    assert (row["last_iteration"], row["action"], row["success"]) == (2, "a", True)


def test_records_without_extra_line_stay(spark, tmp_path):
    plain = "name\nprog\n  1  0  V2000\natom\nM  END\n>  <Name>  (1) \nname\n\n"
    extra = plain.replace("prog\n", "prog\n\n")
    df = spark.createDataFrame([(plain,), (extra,)], "record string")
    writers.write_records(df, str(tmp_path / "out"))
    back = readers.scan_sdf(spark, str(tmp_path / "out")).collect()
    assert [r["record"] for r in back] == [plain, plain]
    assert back[0]["properties"] == {"Name": "name"} and back[0]["n_atoms"] == 1


def test_partition_folders_prune(spark, tmp_path):
    df = spark.createDataFrame([(i, "m" + str(i % 2), "test") for i in range(10)], "id long, model string, role string")
    path = writers.write_partitioned(df, str(tmp_path / "p"))
    kept = spark.read.parquet(path).filter("model = 'm1'")
    assert kept.count() == 5 and kept.select(F.input_file_name()).filter("input_file_name() not like '%model=m1%'").count() == 0
    assert "PartitionFilters: [isnotnull(model" in kept._jdf.queryExecution().executedPlan().toString()


def test_audit_has_no_limit_of_folds(spark):
    rows = [(i, 0, f, "validation" if i % 70 == f else "train") for i in range(140) for f in range(70)]
    members = spark.createDataFrame(rows, "id long, seed int, fold int, role string")
    assert splits.audit(members).collect() == [Row(seed=0, n_rows=140, n_not_once=0, n_leaked=0)]
    twice = members.unionByName(spark.createDataFrame([(3, 0, 5, "validation")], members.schema))
    assert splits.audit(twice).collect() == [Row(seed=0, n_rows=140, n_not_once=1, n_leaked=1)]


def test_correlations_have_no_limit_of_features(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(60, 1500))
    x[:, 1400] = 2 * x[:, 3] + 1e-3 * x[:, 9]
    x[:, 700] = 4.0
    df = spark.createDataFrame([(row.tolist(),) for row in x] + [(None,)], "features array<double>")
    pairs = quality.feature_correlations(df)
    got = {(r["a"], r["b"]): r["r"] for r in quality.high_correlation(pairs, 0.9).collect()}
    assert list(got) == [(3, 1400)] and abs(got[3, 1400] - np.corrcoef(x[:, 3], x[:, 1400])[0, 1]) < 1e-12
    assert pairs.filter("a = 700 OR b = 700").count() == 0 and pairs.count() == 1499 * 1498 // 2
    assert quality.feature_correlations(df.limit(0)).count() == 0


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_with_long_values_and_both_line_ends(spark, tmp_path, end):
    first = ["", "prog", "  2  1  V2000", "atom", "M  END", ">  <Name>  (1) ", "line one", "line two", "", ">  <Empty>", "", ">  <Name>", "again", ""]
    second = ["b", "prog", "  1  0  V2000", "atom", "M  END", ">  <Cost>", "5 $$$$ or less", ""]
    text_ = "".join(end.join(r) + end + "$$$$" + end for r in (first, second, ["c", "prog", "  3  0  V2000", "M  END"]))
    (tmp_path / "r.sdf").write_bytes(text_.encode())
    got = sorted((r["title"], r["n_atoms"], r["properties"]) for r in readers.scan_sdf(spark, str(tmp_path)).collect())
    assert got == [("", 2, {"Name": "line one\nline two\nagain", "Empty": ""}), ("b", 1, {"Cost": "5 $$$$ or less"}), ("c", 3, {})]


def test_titled_lists_follow_csv(spark, tmp_path):
    head = 'A list, with a "title"\n"a,b",c\n'
    (tmp_path / "1.csv").write_text(head + '"x\ny",1\n"say ""so""",2\n"a,b",c\nplain,\n')
    (tmp_path / "2.csv").write_text(head + "second,3\n")
    (tmp_path / "3.csv").write_text("bare,4\n")
    rows = readers.scan_titled_csv(spark, str(tmp_path))
    assert rows.columns == ["a,b", "c"]
    want = [("x\ny", "1"), ('say "so"', "2"), ("a,b", "c"), ("plain", None), ("second", "3"), ("bare", "4")]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(want, key=str)


def test_folders_get_few_files(spark, tmp_path):
    df = spark.range(0, 4000, 1, 40).select("id", F.concat(F.lit("m"), F.col("id") % 3).alias("model"), F.lit("test").alias("role"))
    path = writers.write_partitioned(df, str(tmp_path / "p"))
    files = list((tmp_path / "p").rglob("*.parquet"))
    assert spark.read.parquet(path).count() == 4000 and len(files) <= 9


def test_folds_shuffle_no_hash_and_audits_shuffle_rows_once(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(50)], "id long, label int")
    folds = splits.stratified_folds(rows, "id", "label", (0, 1, 2), 5)
    plan = folds._jdf.queryExecution().executedPlan().toString()
    sent = [line.split("+-")[-1] for line in plan.splitlines()]
    at = next(k for k, line in enumerate(sent) if "Exchange" in line and "__k" in line)
    assert "__h" not in sent[at + 1]  # what the exchange reads
    audited = splits.audit(splits.fold_members(folds.repartition("seed", "id"), 5))
    text = audited._jdf.queryExecution().executedPlan().toString()
    before = splits.audit(splits.fold_members(folds, 5))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(seed") < before.count("Exchange hashpartitioning(seed")


def test_audit_counts_rows_without_a_fold(spark):
    table = [(0, 1, None, "train"), (0, 1, None, "train"), (0, 1, 2, "validation"), (0, 2, 2, "validation"), (0, 2, 200, "train")]
    members = spark.createDataFrame(table, "seed int, id long, fold int, role string")
    assert splits.audit(members).collect() == [Row(seed=0, n_rows=2, n_not_once=0, n_leaked=1)]


def test_side_by_side_lists_what_is_not_zero(spark):
    rows = spark.createDataFrame([(1, [0.0, 2.5], [0, 3]), (2, [None, float("nan")], []), (3, [1.0, 0.0], [7])], "k int, a array<double>, bits array<int>")
    got = text.side_by_side(rows, "a", "bits", 8, ["k"])
    assert got.columns == ["k", "n", "pos", "x"]
    assert sorted((r.k, r.n, r.pos, str(r.x)) for r in got.collect()) == [
        (1, 10, 1, "2.5"), (1, 10, 2, "1.0"), (1, 10, 5, "1.0"), (2, 10, 1, "nan"), (3, 10, 0, "1.0"), (3, 10, 9, "1.0"),
    ]


def test_part_bits_are_made_on_all_cores(spark, data):
    parts = feature_queries._part_bits(spark, data)
    assert parts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_routed_queries_leave_in_pieces():
    n, cells = 300, 64
    draw = np.random.default_rng(5)
    pivots = draw.normal(size=(cells, 4))

    class Sent:
        def __init__(self, value):
            self.value = value

    x = draw.normal(size=(n, 4))
    batch = pa.RecordBatch.from_pydict({"id": list(range(n)), "features": [list(map(float, r)) for r in x]})
    radii = (np.full(cells, 10.0), np.zeros(cells), np.full(cells, 100.0))  # no cell can be ruled out
    out = list(neighbors._route(Sent({(): pivots}), Sent({(): radii}), [], "features", "euclidean", 3)(iter([batch])))
    assert max(b.num_rows for b in out) <= neighbors.ROUTED_ROWS
    assert sorted(zip(*[c for b in [pa.Table.from_batches(out)] for c in (b["id"].to_pylist(), b["cell"].to_pylist())], strict=True)) == [
        (i, c) for i in range(n) for c in range(cells)
    ]


def test_a_folder_of_many_rows_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "ROWS_A_FILE", 100)
    df = spark.range(0, 1000, 1, 1).select("id", F.lit("m").alias("model"), F.lit("r").alias("role"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = writers.write_partitioned(df, str(tmp_path / "p"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(path).count() == 1000
    assert len(list((tmp_path / "p" / "model=m" / "role=r").glob("*.parquet"))) > 1


def test_manhattan_tile_needs_no_second_tile():
    draw = np.random.default_rng(9)
    x, t = draw.normal(size=(130, 7)), draw.normal(size=(9001, 7))
    tracemalloc.start()
    rough, _ = neighbors._tile(x, t, "manhattan")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    plain = np.zeros((130, 9001))
    for j in range(7):
        plain += np.abs(x[:, j, None] - t[None, :, j])
    assert (rough == plain).all() and peak < 1.5 * rough.nbytes


def test_the_bound_of_strips_loses_no_neighbour():
    draw = np.random.default_rng(5)
    t = draw.normal(size=(3000, 5))
    t[500:900] = t[:400]
    x, ids = np.r_[draw.normal(size=(30, 5)), t[:20]], draw.permutation(3000)
    for metric, k in (("euclidean", 7), ("manhattan", 3), ("euclidean", 300)):
        rough, _ = neighbors._tile(x, t, metric)
        assert (neighbors._bound(rough, k) >= np.partition(rough, k - 1, axis=1)[:, k - 1]).all()
        row, col, gap = neighbors.block_top_k(x, t, ids, k, metric)
        for q in range(len(x)):
            d = np.abs(x[q] - t).sum(1) if metric == "manhattan" else np.sqrt(((x[q] - t) ** 2).sum(1))
            want = np.lexsort((ids, d))[:k]
            assert col[row == q].tolist() == want.tolist() and np.allclose(gap[row == q], d[want])


def test_fingerprint_bits_of_odd_texts(spark):
    """Grams of any length hash as ``hash_int``: empty, null, longer than one md5 block, beyond ASCII, and texts of many steps."""
    import hashlib

    long = " ".join(f"w{i}" * (1 + i % 40) for i in range(70))
    texts = ["", None, "a", "a  b\tb a b", "ä 日本 😀 ß", long, None, "x" * 55 + " " + "y" * 56, " \n"] + [f"{i} {i + 1} {i * i}" for i in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").coalesce(1)
    for max_n in (1, 3):
        got = {r[0]: r[1] for r in df.select("i", text.hashed_bits(text.tokens(F.col("s")), 97, max_n)).collect()}
        for i, t in enumerate(texts):
            w = (t or "").split()
            grams = [" ".join(w[k : k + n]) for n in range(1, max_n + 1) for k in range(len(w) - n + 1)]
            want = sorted({int(hashlib.md5(g.encode()).hexdigest()[:7], 16) % 97 for g in grams})
            assert got[i] == (None if t is None else want)


def test_fingerprints_are_not_interpreted_gram_by_gram(spark):
    """Hashing every gram inside a lambda took two thirds of generate_descriptors."""
    plan = spark.range(1).select(text.hashed_bits(F.split(F.col("id").cast("string"), " ")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "md5" not in plan
