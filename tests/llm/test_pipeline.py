"""Near copies, one row per class and the whole pipeline on small tables."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stackmill.llm import dartminhash, decontamination

DOCS = "doc_id long, text string, h string, r string, __n long, n_chars int, lang string, source string"


def draws(seed=11):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8))) for _ in range(3000)]
    return draw, lambda n: " ".join(draw.choice(words) for _ in range(n))


def row(i, t, source="a"):
    return (i, t, "clash", "clash", 1, len(t or ""), "en", source)


def weighted_jaccard(a, b):
    def bag(t):
        w = t.split()
        return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_weighted_classes_equal_plain(spark):
    draw, prose = draws()
    base = [prose(draw.randint(30, 90)) for _ in range(12)]
    texts = list(base)
    for t in base[:8]:
        for _ in range(2):
            w = t.split()
            w[draw.randrange(len(w))] = "other"
            texts.append(" ".join(w))
    line = prose(8)
    texts += [" ".join([line] * n) for n in (4, 5, 6, 40)]  # the same set of windows, other counts
    docs = spark.createDataFrame([row(k, t) for k, t in enumerate(texts)], DOCS)
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if weighted_jaccard(texts[a], texts[b]) >= 0.8:
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    got = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(docs).collect()}
    assert got == dict(enumerate(group))
    n = len(base) + 16
    assert len({group[k] for k in range(n, n + 4)}) > 1
    plain = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(docs, weighted=False).collect()}
    assert len({plain[k] for k in range(n, n + 4)}) == 1


def test_components_in_steps(spark):
    draw = random.Random(5)
    links = [(draw.randrange(120), draw.randrange(120)) for _ in range(70)]
    name = {x: x for ab in links for x in ab}
    for a, b in links:
        low, high = sorted((name[a], name[b]))
        name = {k: low if v == high else v for k, v in name.items()}
    frame = spark.createDataFrame(links, "a long, b long")
    want = {k: v for k, v in name.items() if any(k in ab and ab[0] != ab[1] for ab in links)}
    assert {r.id: r.component for r in dartminhash.components(frame).collect()} == want
    first = dartminhash.components(spark.createDataFrame(links[:40], "a long, b long"))
    assert {r.id: r.component for r in dartminhash.merged(first, spark.createDataFrame(links[40:], "a long, b long")).collect()} == want
    assert dartminhash.merged(first, frame.limit(0)).count() == first.count()


def test_one_per_class(spark):
    _, prose = draws(3)
    t = prose(60)
    rows = [row(1, t), row(2, t), row(3, None), row(4, ""), row(5, prose(50)), row(5, "another text"), row(None, t), row(None, None)]
    kept = dartminhash.one_per_class(spark.createDataFrame(rows, DOCS))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 3, 4, 5]
    assert dartminhash.one_per_class(spark.createDataFrame([], DOCS)).count() == 0


def tables(spark, folder, documents, items, labels):
    spark.createDataFrame(documents, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("full", [True, False])
def test_pipeline(spark, tmp_path, full):
    draw, prose = draws(8)
    if not full:
        folder = tables(spark, tmp_path, [], [], [])
        assert corpus_pipeline.run(spark, folder).count() == 0
        return
    clean = {k: prose(draw.randint(40, 80)) for k in range(60)}
    toxic = {k: "you idiot you are a worthless moron, you pathetic loser. " + prose(12) for k in range(100, 110)}
    item = prose(30)
    rows = [row(k, t, "abc"[k % 3]) for k, t in (clean | toxic).items()]
    rows += [row(200, clean[7]), row(201, prose(10) + " " + item + " " + prose(10)), row(202, prose(40) + " mail me: jo.doe@example.org now"), row(203, None), row(204, ""), row(205, "word " * 30000)]
    folder = tables(spark, tmp_path, rows, [(1, item), (2, None), (3, "")], [(k, 1, int(k >= 100)) for k in [*clean, *toxic]] + [(1, None, None)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, columns = set(range(60)) | set(range(100, 110)) | set(range(200, 206)), set(docs.columns)
    gone = [set(toxic), {200}, {201}, set(), set()]
    for (name, stage), lost in zip(corpus_pipeline.STAGES[:-1], gone, strict=False):
        docs = stage(spark, docs, folder)
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept -= lost
        assert ({r.doc_id for r in docs.collect()}, set(docs.columns)) == (kept, columns), name
    text = {r.doc_id: r.text for r in docs.collect()}
    assert "jo.doe" not in text[202] and all(text[k] == clean[k] for k in clean)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= kept and max(times.values()) <= 3


@pytest.fixture(scope="module")
def passages(spark):
    """Documents and items of every length: whole, substituted and cut passages, repeated ids and rows, nulls."""
    draw, prose = draws(21)
    items = [(k, prose(n)) for k, n in enumerate([1, 2, 4, 5, 7, 10, 11, 13, 20, 60])]
    items += [(20, items[8][1]), (21, None), (22, " . "), (None, prose(15)), (5, items[5][1])]
    texts = [prose(30)] + [f"{prose(9)} {t}, {prose(6)}" for _, t in items if t]
    for _, t in items:
        w = (t or "").split()
        for places in ((0,), (1, 3), (len(w) // 2, len(w) // 2 + 4), (0, 1, 2, 3)):
            texts.append(prose(5) + " " + " ".join(prose(1) if k in places else x for k, x in enumerate(w)))
    texts += [items[k][1].upper() for k in range(10)] + [items[9][1][:200], None, "", " ".join([items[4][1]] * 3000)]
    rows = [row(k, t) for k, t in enumerate(texts)] + [row(3, texts[3]), row(None, texts[10])]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most", [decontamination.MOST_BROADCAST, 0])
def test_overlaps_equal_brute_force(passages, most):
    """Both plans: items of every length, long texts, repeated rows and ids."""
    docs, items = passages
    tables = {"documents": docs.select("doc_id", "text").distinct().toPandas(), "benchmark": items.distinct().toPandas()}
    db = duckdb.connect()
    for name, frame in tables.items():
        db.register(name, frame.astype({frame.columns[0]: "Int64"}))
    want = sorted(map(str, db.sql(decontamination.overlaps_sql("documents")).fetchall()))
    names = ["doc_id", "item_id", "equal_words", "overlap_words", "item_words", "doc_start"]
    got = sorted(str(tuple(r)) for r in decontamination.overlaps(docs, items, most, least=1).select(names).collect())
    assert got == want
    assert {n for *_, n, _ in map(eval, got)} >= {1, 2, 4, 5, 7, 10, 11, 13, 20, 60}
    assert decontamination.overlaps(docs, items, most).where("item_words < 5").count() == 0
    assert decontamination.overlaps(docs.limit(0), items, most).count() == decontamination.overlaps(docs, items.limit(0), most).count() == 0


def test_short_items_remove_whole_documents_only(spark):
    items = spark.createDataFrame([(1, "the"), (2, "one two three four five"), (3, "a b")], "item_id long, text string")
    rows = [(1, "the cat sat", 0), (2, "The.", 0), (3, "say one two three four five now", 0), (4, "one two three five", 0), (5, None, 0), (6, "", 0), (7, "a b", 0), (8, "b a b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __hit int")
    kept = decontamination.without_overlap(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 8]


def test_large_benchmarks_of_op10_are_never_sent(spark, passages):
    """Spark took the seeds of a large benchmark for as small as its file and broadcast them; all seeds of all documents were
    shuffled; and items of equal words counted once each."""
    docs, items = passages
    joins = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    large = joins(decontamination.overlaps(docs, items, 0))
    assert "BroadcastHashJoin" not in large and "SortMergeJoin" in large
    one = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(20))) for k in range(50)], "item_id long, text string")
    assert "BroadcastHashJoin" in joins(decontamination.overlaps(docs, one, 20)) and "BroadcastHashJoin" not in joins(decontamination.overlaps(docs, one, 19))
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    test = decontamination._filter(keys, 20_000)
    assert keys.where(test(F.col("key"))).count() == 20_000
    assert spark.range(20_000, 120_000).select(F.xxhash64("id").alias("key")).where(test(F.col("key"))).count() < 5_000
