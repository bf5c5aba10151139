"""Whitening, runs and compression against plain versions: nulls, empty and long rows, ties, copies, extra columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from stackmill.llm import compression, langid, periodic, whitening
from stackmill.llm.common import labelled_sample


def vectors(seed=3, n=300):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 6)) @ draw.normal(size=(6, 6)) + draw.normal(size=6)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(n, None, 1), (n + 1, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (n + 2, [math.nan] * 6, 1), (n + 3, [math.inf] + [0.0] * 5, 1)]
    rows += [(5, rows[5][1], 1), (n + 4, rows[7][1], 1), (None, rows[9][1], 1), (n + 5, [-0.0] * 6, 1), (n + 6, [1e3, -7.5, 0.1, 0.0, 3.0, 2.0], 1)]
    return rows


VECTORS = "vec_id long, embedding array<double>, n long"


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")


def test_scatter_is_exact():
    draw = np.random.default_rng(1)
    for rows, width, top in ((1, 3, 5), (130, 5, 300), (70, 4, 1 << 40), (65, 2, (1 << 62) - 1)):
        x = draw.integers(-top, top, (rows, width))
        x[:, 0] = 7
        sums, cross = whitening.scatter(x)
        o = x.astype(object)
        want = o.T @ o
        assert sums == [int(v) for v in o.sum(0)]
        assert all(cross[i][j] == want[i, j] for i in range(width) for j in range(i, width))
        for v in (*sums, *(c for row in cross for c in row)):
            assert sum(p << (whitening.LIMB * k) for k, p in enumerate(whitening._limbs(v))) == v


def test_whitening_equals_plain(spark, tmp_path):
    rows = vectors()
    write(spark, tmp_path, "embeddings", rows, VECTORS)
    got = whitening.op11(spark, str(tmp_path)).collect()
    usable = [(i, [math.floor(256 * c) for c in v]) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    assert len(got) == 4 * len(usable)
    distinct = {tuple(v) for _, v in usable}
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    x = np.array(sorted(distinct), float)
    x -= np.array(sums) / n
    v = x.T @ x / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    by = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-9)
        by.setdefault((r.vec_id, r.component), []).append(r)
    for i, w in usable:
        assert by[i, 1][0].deviation == sum((n * c - s) ** 2 for c, s in zip(w, sums, strict=True))
    for k in range(1, 5):
        plain = np.array([(np.array(w) - np.array(sums) / n) @ q[:, k - 1] / math.sqrt(e[k - 1]) for _, w in usable])
        mine = np.array([by[i, k][0].whitened for i, _ in usable])
        assert min(np.abs(mine - plain).max(), np.abs(mine + plain).max()) < 1e-6
    seen = {}
    for i, w in usable:
        seen.setdefault(tuple(w), i)
    z = np.array([[by[i, k][0].whitened for k in range(1, 5)] for i in seen.values()])
    assert np.abs(z.T @ z / n - np.eye(4)).max() < 1e-9


def test_whitening_of_odd_tables(spark, tmp_path):
    write(spark, tmp_path, "embeddings", [], VECTORS)
    assert whitening.op11(spark, str(tmp_path)).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)
    model = whitening.fit(one)
    assert (model.n, model.sums) == (1, [256, 512])
    assert [r.whitened for r in whitening.whiten(one, model).collect()] == [[None, None]] * 2
    ragged = spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 3.0], 0), (3, [], 0)], VECTORS)
    model = whitening.fit(ragged)
    assert (model.n, model.sums) == (3, [512, 768])
    assert whitening.whiten(ragged, model).count() == 3
    huge = spark.createDataFrame([(1, [1e300, 1.0], 0), (2, [-1e300, 2.0], 0)], VECTORS)
    assert [r.deviation for r in whitening.whiten(huge, whitening.fit(huge)).collect()] == [None, None]


def plain_runs(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            x = w[i : j + q]
            if j > i and len(x) >= max(6, 4 * q) and all(x[r:] != x[:-r] for r in range(1, q)):
                out.add((i, len(x), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_plain():
    draw = random.Random(4)
    found = 0
    for _ in range(500):
        texts = []
        for _ in range(3):
            n, letters = draw.randint(0, 70), "abcdefgh"[: draw.choice([1, 2, 2, 3, 6, 8])]
            w = [draw.choice(letters).encode() for _ in range(n)]
            if n and draw.random() < 0.6:
                a, p = draw.randrange(n), draw.randint(1, 9)
                w = w[:a] + [w[min(a + j % p, n - 1)] for j in range(n - a)]
            texts.append(w)
        want = [plain_runs(w) for w in texts]
        assert periodic.text_runs(texts) == want
        for w, r in zip(texts, want, strict=True):  # also without the windows that rule stretches out
            number = {x: k for k, x in enumerate(sorted(set(w)))}
            assert periodic.runs_of([number[x] for x in w]) == r
        found += sum(map(len, want))
    assert found > 500


def test_extensions_equal_plain():
    draw = random.Random(6)
    for _ in range(200):
        w = [draw.randrange(draw.choice([1, 2, 4])) for _ in range(draw.randint(2, 40))]
        lce = periodic.Extensions([*w, -1], ranked=True)
        pairs = [(a, b) for a in range(len(w)) for b in range(len(w)) if a != b]
        got = lce(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
        for (a, b), n in zip(pairs, got.tolist(), strict=True):
            assert w[a : a + n] == w[b : b + n] and (max(a, b) + n == len(w) or w[a + n] != w[b + n])
        assert sorted(range(len(w) + 1), key=lambda k: [*w, -1][k:]) == np.argsort(lce.first).tolist()


TEXTS = "doc_id long, text string, runs string, __w string, __g long"


def test_run_digests(spark, tmp_path):
    draw = random.Random(9)
    words = [f"w{k}é" for k in range(40)]
    texts = [None, "", " \n\t ", "one", "a a a a a", "a a a a a a", "x\x0by\x0cz q " * 9]
    texts += [" ".join(draw.choice(words) for _ in range(draw.randint(1, 300))) for _ in range(260)]
    texts += [" ".join(["once", *(["again", "and"] * 6000), "end", *(["again", "and"] * 6000)]), "ab\n" * 500]
    rows = [(k, t, "clash", "clash", 1) for k, t in enumerate(texts)] + [(None, texts[-1], "", "", 0), (8, texts[8], "", "", 0)]
    write(spark, tmp_path, "documents", rows, TEXTS)
    got = {}
    for r in periodic.op12(spark, str(tmp_path)).collect():
        assert got.setdefault(r.doc_id, r) == r  # repeated rows, repeated results
    total = 0
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        h = zlib.crc32(b"" if i is None else str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        runs = periodic.text_runs([w])[0] if n > 2000 else plain_runs(w)
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
        total += len(runs)
    assert total > 20
    assert periodic.periodic_runs(spark.createDataFrame([], TEXTS)).count() == 0


def judged(seed=2, n=240):
    draw = random.Random(seed)
    words = ["".join(draw.choice("etaoinsr") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    rows = []
    for k in range(n):
        w = [draw.choice(words) for _ in range(draw.randint(5, 250))]
        rows.append((k, " | ".join(w).upper() + "!!" if k % 4 == 0 else " ".join(w) + ".", "x", 1.0, int(k % 4 != 0)))
    return rows


LABELLED = "doc_id long, text string, score string, difference double, y int"


def test_compression_classifier(spark, tmp_path):
    rows = judged()
    docs = spark.createDataFrame([*rows, (900, None, "", 0.0, 0), (901, "", "", 0.0, 0), (902, "long " * 100000, "", 0.0, 0), (3, rows[3][1], "", 0.0, 0), (None, "no id", "", 0.0, 0)], LABELLED)
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows] + [(5, None), (None, 1), (900, 0)], "doc_id long, quality int").where("doc_id % 3 <> 0")
    model = compression.fit(docs, labels)
    got = [(r.doc_id, r.score) for r in compression.score(docs, model).collect()]
    assert len(got) == len(rows) + 5 and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    right = sum((by[r[0]] >= 0.7) == r[4] for r in rows if r[0] % 3 == 0)
    assert right >= 0.95 * sum(r[0] % 3 == 0 for r in rows)
    assert by[900] == by[901]
    sizes = compression.Sizes(model.good, model.bad)  # the score comes from the sizes of whole texts
    raw = rows[6][1].encode()
    parts = [raw[k * len(raw) // n : (k + 1) * len(raw) // n] for n in [max(1, round(len(raw) / compression.PIECE))] for k in range(n)]
    assert b"".join(parts) == raw and parts == compression.pieces(raw)
    good, bad = (sum(len(c.compress(p)) for p in parts) for c in sizes.coders)
    assert sizes.differences(raw)[0] == (bad - good) / (bad + good)
    for few in ([], rows[:1], rows[1:3]):
        m = compression.fit(spark.createDataFrame(few, LABELLED), labels)
        assert all(0 <= r.score <= 1 for r in compression.score(docs.limit(5), m).collect())
    assert compression.score(spark.createDataFrame([], LABELLED), model).count() == 0


def test_sample_does_not_follow_the_order_of_files(spark):
    rows = [(k, "x" * (900 if k == 11 else 10 + k), "", 0.0, k % 2) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, label int")
    one = labelled_sample(spark.createDataFrame([*rows, rows[0]], LABELLED), labels, 40, 500).orderBy("place").collect()
    two = labelled_sample(spark.createDataFrame(rows[::-1], LABELLED).repartition(5), labels, 40, 500).orderBy("place").collect()
    assert one == two and 450 < sum(len(r.text) for r in one) <= 500 and len(one) > 5
    assert labelled_sample(spark.createDataFrame([], LABELLED), labels, 40, 500).collect() == []


def test_every_language_is_learned(spark):
    rows = [(k, " ".join([f"q{k}zx{j}w" for j in range(30)]), f"l{k:03}") for k in range(530)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="512"):
        langid.fit(docs)
    few = docs.where("doc_id < 6")
    assert len(langid.fit(docs.where("doc_id < 40"), languages=40).languages) == 40
    long = spark.createDataFrame([(1000 + k, f"{'very' * 3} long " * 20000, "l900") for k in range(3)], docs.schema)
    model = langid.fit(few.unionByName(long), characters=6000)
    assert model.languages == [f"l{k:03}" for k in range(6)] + ["l900"]
    assert langid.fit(docs.limit(0)) is None
