"""Corpus operators against plain versions on small fixtures: nulls, empty and long texts, ties, copies, extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stackmill.llm import dartminhash, decontamination, fertility, langid, maxent, mixing, pii, separators, suffix_groups, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string"


def corpus(seed=5):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(2, 6))) for _ in range(300)]
    base = [" ".join(draw.choice(words) for _ in range(draw.randint(40, 160))) for _ in range(24)]
    texts = [None, "", " \n\t ", "one", base[0], base[0], base[1], *base, base[2] + " x y", ("ab " * 900).strip(), "a" * 3000]
    for t in base[:6]:
        w = t.split()
        w[draw.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [base[7][:260] + "\n" + base[8], "mail a.b@c.de, +1 (555) 123-4567, 4111 1111 1111 1111, 10.0.0.256 and 10.0.0.7", "ÀÉ ñandú 日本語 текст"]
    return [(i, t, "xy"[i % 2] if i % 7 else None, "hot" if i % 3 == 0 else (None if i % 5 == 0 else f"s{i % 4}"), 0, "clash", "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_fertility_counts(docs, rows, empty):
    got = by_id(fertility.fertility(docs))
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + j for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), len(hit))
        assert got[i].base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert fertility.fertility(empty).count() == 0


def test_suffix_arrays_equal_sorting():
    draw = random.Random(2)
    for trial in range(60):
        lanes = [bytes(draw.choice(b"ab" if trial % 2 else b"abc") for _ in range(draw.randint(1, 40))) + b"\0" for _ in range(4)] + [b"aaaa\0aa\0", b"\0"]
        data = np.frombuffer(b"".join(lanes), np.uint8).astype(np.int16)
        starts = np.cumsum([0, *map(len, lanes[:-1])])
        order = suffix_groups.suffix_arrays(data, starts)
        for lane, s in zip(lanes, starts, strict=True):
            assert (order[s : s + len(lane)] - s).tolist() == sorted(range(len(lane)), key=lambda i, x=lane: x[i:])


def test_repeats_equal_brute_force(docs, rows, empty):
    got = by_id(suffix_groups.remove_repeats(docs))
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    count = Counter(t[k : k + 200] for t in raw.values() for k in range(len(t) - 199))
    for i, t in raw.items():
        gone = {p for k in range(len(t) - 199) if count[t[k : k + 200]] > 1 for p in range(k, k + 200)}
        kept = bytes(c for p, c in enumerate(t) if p not in gone)
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(t), len(gone), hashlib.sha256(kept).hexdigest())
    assert suffix_groups.remove_repeats(empty).count() == 0


def test_only_repeated_stretches_are_sorted(monkeypatch):
    rng, sorted_bytes, plain = random.Random(5), [], suffix_groups.suffix_arrays
    monkeypatch.setattr(suffix_groups, "suffix_arrays", lambda data, starts: sorted_bytes.append(len(data)) or plain(data, starts))
    letters = lambda n: bytes(rng.choices(range(97, 123), k=n))
    same, other = letters(260), b"ab" * 150
    contexts = [(1, letters(2000) + same + letters(3000), 1, b"a"), (1, letters(500) + same, 1, b"b"), (1, letters(4000), 2, b"c"),
                (2, letters(900), 1, b"d"), (2, letters(901), 1, b"e"), (3, other, 1, b"f"), (3, letters(300), 1, b"g"), (4, same, 1, b"h")]
    frame = suffix_groups.pd.DataFrame(contexts, columns=["key", "context", "m", "name"])
    got = sorted((bytes(n), int(a), int(b)) for found in suffix_groups._resolve(iter([frame])) for n, a, b in found.itertuples(index=False))
    want = []
    for key in {c[0] for c in contexts}:
        group = [c for c in contexts if c[0] == key]
        seen = Counter(s for _, c, m, _ in group for i in range(len(c) - 199) for s in [c[i : i + 200]] * m)
        for _, c, _, name in group:
            flags = np.array([seen[c[i : i + 200]] > 1 for i in range(len(c) - 199)])
            want += [(name, int(a), int(b)) for a, b in zip(*suffix_groups._runs(flags), strict=True)]
    assert got == sorted(want) and len(got) == 4
    assert sum(sorted_bytes) < 5000  # of 12,421 bytes


def test_separators_round_trip(spark, docs, rows, tmp_path):
    folder = f"file://{tmp_path}/flat"
    listed = separators.stored(separators.write_token_files(docs.coalesce(2), folder), "list").collect()
    found = {(r.file.split("/")[-1], r.position): r for r in separators.scan(separators.file_sizes(spark, folder), block=64).collect()}
    assert len(found) == len(rows) == len(listed)
    for r in listed:
        assert found[r.file.split("/")[-1], r.position].ended
    (tmp_path / "flat" / "open.bin").write_bytes(np.array([1, 2, 50256, 50256, 3], "<u2").tobytes())
    own = separators.scan(separators.file_sizes(spark, folder).where("file like '%open.bin'"), block=2).orderBy("position").collect()
    assert [(r.start, r.n_tokens, r.ended) for r in own] == [(0, 2, True), (3, 0, True), (4, 1, False)]


def test_toxicity_learns_and_discounts(spark):
    texts = [(i, f"plain words number {i} here. " + ("you zorgling fool." if i % 4 == 0 else "nice day."), i % 4 == 0) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in texts] + [(3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = by_id(toxicity.score(docs, model))
    assert all((got[i].score >= 0.5) == x for i, _, x in texts) and got[900].score < 0.5 and got[901].score < 0.5
    grammar = toxicity.Grammar()
    plain, negated, reported = (grammar.clauses(t)[0][0][2] for t in ("you are an idiot", "you are not an idiot", "someone said you idiot"))
    assert negated < plain and reported < plain
    assert toxicity.clean(docs, model).count() == 152


def test_toxicity_threats_in_both_orders():
    def weight(text):
        found = toxicity.Grammar().clauses(text)[0]
        return found[0][2] if found else None

    assert weight("you i will kill") == weight("i will kill you") == weight("we will hurt them") == weight("je vais tuer ces gens") == 5.0
    assert weight("you i will kill and burn") == weight("i will kill and burn you") == 9.0
    assert weight("idiot i will kill") == weight("i will kill idiot") == 8.0
    assert weight("i will not kill you") == 3.0 and weight("someone said kill you") == 3.0
    assert weight("kill the process") is None and weight("kill the process. you are welcome") is None


def test_near_duplicates_equal_brute_force(docs, rows, empty):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = by_id(dartminhash.near_duplicates(docs))
    assert {i: r.class_id for i, r in got.items()} == {i: find(i) for i in sets}
    assert dartminhash.near_duplicates(empty).count() == 0


def test_signatures_estimate_weighted_jaccard():
    draw = np.random.default_rng(3)
    a, b = draw.uniform(0, 4, 200), draw.uniform(0, 4, 200)
    elements = np.arange(200, dtype=np.uint64)
    s = dartminhash.signatures(np.tile(elements, 2), np.concatenate([a, b]), np.repeat([0, 1], 200), 2, 1024)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.06


def test_mixing_totals(docs, rows, empty):
    got = mixing.copies(docs).collect()
    assert len(got) == len(rows)
    targets = {r.source: (r.source_size, r.target) for r in got}
    assert math.isclose(sum(t for _, t in targets.values()), sum(s for s, _ in targets.values()))
    assert all(t <= 3 * s + 1e-9 for s, t in targets.values()) and all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in got)
    assert mixing.mixed(docs).count() == sum(r.copies for r in got) and mixing.copies(empty).count() == 0


def test_language_model_of_languages(spark):
    draw = random.Random(1)
    make = {"a": "bado kenu rima ", "b": "xyst qwrt zplk ", "c": "ooéa eeui aaio "}
    rows = [(i, "".join(draw.choice(make[x].split()) + " " for _ in range(30)), x) for i in range(120) for x in ["abc"[i % 3]]]
    docs = spark.createDataFrame([*rows, (500, None, "a"), (501, "123 !", "b"), (502, rows[0][1], None)], "doc_id long, text string, lang string")
    got = by_id(langid.identify(docs, langid.fit(docs)))
    assert all(got[i].lang_pred == x for i, _, x in rows) and got[500].lang_pred == got[501].lang_pred == "und"
    assert langid.identify(docs, None).where("lang_pred <> 'und'").count() == 0


def test_pii_base_equals_regex(docs, rows, empty):
    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    got = by_id(pii.find(docs))
    for i, t, *_ in rows:
        want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t or "")]
        want += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+){3}", t or "") if max(map(int, m.group().split("."))) < 256]
        want += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t or "") if 13 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d)]
        want += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t or "") if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        assert [(s.kind, s.start, s.end) for s in got[i].base] == want
    masked = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert "<email>" in masked[max(masked) - 1] and masked[0] is None and pii.find(empty).count() == 0


def test_pii_secrets_of_every_writing(spark):
    draw = random.Random(4)

    def run(letters, n):
        return "".join(draw.choice(letters) for _ in range(n - 4)) + "a1b2"

    low, mixed = "0123456789abcdef", "0123456789abcdefghijkABCDEFGHIJK"
    make = [
        lambda: f'token = "{run(low, 40)}"', lambda: f"AWS_SECRET_ACCESS_KEY={run(mixed, 40)}", lambda: f"db-password : '{run(mixed, 20)}'",
        lambda: f"token: {run(mixed, 60)}.{run(mixed, 90)}.{run(mixed, 43)}", lambda: f'{{"api_key":"{run(mixed, 24)}"}}', lambda: run(low, 64), lambda: run(mixed, 24).upper(),
    ]
    planted = [make[i % len(make)]() for i in range(70)]
    texts = [f"plain words stand here, {p} and more of them." for p in planted] + [f"note: Donaudampfschifffahrtsgesellschaft {i}" for i in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    masked = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    for i, p in enumerate(planted):
        assert not any(x in masked[i] for x in re.findall("[A-Za-z0-9]{16,}", p)), (p, masked[i])
    assert all(masked[i] == texts[i] for i in range(70, 570))
    long = spark.createDataFrame([(0, "a" * 300_000), (1, "abc " + " " * 300_000 + "x"), (2, 'abc="' * 60_000)], "doc_id long, text string")
    assert pii.candidates(long).count() == 3


def test_maxent_base_score(docs, rows, empty):
    train = docs.where(maxent.fold(10) != 0)
    got = by_id(maxent.score(docs, maxent.fit(train)))
    words = {r[0]: [*(r[1] or "").encode().lower().split(), None] for r in rows}
    c = Counter(w for i, x in words.items() if zlib.crc32(str(i).encode()) % 10 for w in x)
    n, v = sum(c.values()), len(c)
    for i, x in words.items():
        assert got[i].n_tokens == len(x) and got[i].n_known == sum(c[w] > 0 for w in x)
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), rel_tol=1e-9)
    assert maxent.score(empty, maxent.fit(empty)).count() == 0


def test_decontamination_tolerates_two_substitutions(spark):
    item = [f"w{i}" for i in range(20)]
    changed = [x if i not in (4, 15) else "zz" for i, x in enumerate(item)]
    three = [x if i % 4 else "zz" for i, x in enumerate(item)]
    rows = [(1, "front " + " ".join(item) + " end"), (2, "A b " + " ".join(changed).upper() + "!"), (3, " ".join(three)), (4, None), (5, ""), (None, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "w1 w2")], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.equal_words) for r in decontamination.overlaps(docs, items).collect()}
    assert got == {1: (7, 20), 2: (7, 18), None: (7, 20)}
    assert [r.doc_id for r in decontamination.without_overlap(docs, items).orderBy("doc_id").collect()] == [3, 4, 5]
    assert decontamination.overlaps(docs, items.limit(0)).count() == 0


def test_steps_of_op9_sort_buckets_as_16_bits(monkeypatch):
    """A step sorted 64-bit numbers and added up rows of 16 classes; sums per class give the same tables bit by bit."""
    import numpy as np

    from stackmill.llm import maxent

    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in draw.zipf(1.5, 400) % 500) for _ in range(20)] + ["", "one"]
    kept = [np.zeros(maxent.CLASSES, np.float32), np.zeros((maxent.BUCKETS, maxent.CLASSES), np.float32), np.zeros((maxent.BUCKETS, maxent.CLASSES), np.float32)]
    bias, table, squares = (x.copy() for x in kept)
    sort, sorted_as = np.argsort, []
    monkeypatch.setattr(maxent.np, "argsort", lambda a, **more: (sorted_as.append(a.dtype), sort(a, **more))[1])
    maxent.learn_chunk(bias, table, squares, texts)
    monkeypatch.undo()
    assert sorted_as == [np.uint16]
    key, kind, owner = maxent.tokens(texts)
    f = maxent.context(key, owner)
    error = np.exp(maxent._log_softmax(*kept[:2], f))
    error[np.arange(len(kind)), kind] -= 1
    order = np.argsort(f.reshape(-1), kind="stable")
    rows, first = np.unique(f.reshape(-1)[order], return_index=True)
    gradient = np.add.reduceat(error[order // 3], first, axis=0)
    kept[2][rows] += gradient * gradient
    kept[1][rows] -= maxent.RATE * gradient / np.sqrt(kept[2][rows] + 1.0)
    assert np.array_equal(table, kept[1]) and np.array_equal(squares, kept[2])


def test_words_of_op1_are_counted_without_a_step_per_letter():
    """Letters were matched one by one; runs of letters and sorted windows give the same figures."""
    import random

    from stackmill.llm import fertility

    assert fertility._LETTERS.findall("ab1 日本_c") == ["ab", "日本", "c"]
    assert [fertility.script_of(t) for t in ("", "12", "ab", "é α β", "日本 a", "𠀀 1", "ß_я")] == ["other", "other", "latin", "greek", "han", "han", "cyrillic"]
    draw = random.Random(5)
    for n in [*range(8), 40, 200]:
        for kinds in (1, 2, 6, 1000):
            words = [b"%d" % draw.randrange(kinds) for _ in range(n)]
            windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
            covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
            assert fertility.repeated_words(words) == len(covered)


@pytest.mark.parametrize("frequent", [maxent.FREQUENT, 3])
def test_context_of_op9_tells_words_of_one_class_apart(spark, monkeypatch, frequent):
    """the features predicted the class of a word only; ``red`` and ``bed``, of one class, scored the same after any word."""
    monkeypatch.setattr(maxent, "FREQUENT", frequent)
    texts = ["u red", "v bed"] * 300 + [f"w{k} x{k}" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len({maxent.tokens([w])[1][0] for w in ("red", "bed")}) == 1
    model = maxent.fit(docs)
    asked = spark.createDataFrame([(0, "u red"), (1, "u bed"), (2, "v red"), (3, "v bed"), (4, "u unseen")], "doc_id long, text string")
    got = by_id(maxent.score(asked, model))
    if frequent > 3:  # else one of the two words has no leaf of its own
        assert got[0].score - got[1].score > 0.3 and got[3].score - got[2].score > 0.3
    assert got[4].score < got[0].score

    trees, n = model.trees, len(model.trees.keys)
    assert n == min(frequent, 85)  # 4 words, 80 others and the end
    found = np.concatenate([np.arange(n), np.full(maxent.CLASSES - 1, -1)])
    kinds = {k: c for w in {w for t in texts for w in t.split()} for k, c in [(maxent.tokens([w])[0][0], maxent.tokens([w])[1][0])]}
    kind = np.array([kinds.get(k, 0) for k in trees.keys] + [*range(1, maxent.CLASSES)])
    key, _, owner = maxent.tokens(["u"])
    past = np.repeat(maxent.history(key, owner)[-1:], len(found), 0)  # the history of what follows "u"
    p = np.exp(maxent.log_probabilities(model.bias, model.table, trees, past, found, kind))
    end = np.exp(maxent._log_softmax(model.bias, model.table[: maxent.BUCKETS], maxent._buckets(past[:1])))[0, 0]
    assert math.isclose(p.sum() + (0 if (kind[:n] == 0).any() else end), 1, rel_tol=1e-4)


def test_trees_of_op9_find_words_and_end_in_their_leaves():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    keys[1] = keys[0] + np.uint64(1)  # two keys with the same first bits
    kinds = np.arange(len(keys)) % 5
    kinds[kinds == 0] = 7
    trees = maxent.grow_trees(keys, np.arange(1.0, len(keys) + 1), kinds, np.full(maxent.CLASSES, 0.1))
    assert trees.find(keys).tolist() == [*range(len(keys))] and trees.find(keys[2:] + np.uint64(1)).max() == -1
    token, node, slot = trees.choices(np.arange(len(keys)), kinds)
    shares = np.exp(np.bincount(token, trees.bias[node, slot]))
    for k in np.unique(kinds):
        own = np.flatnonzero(kinds == k)
        assert np.allclose(shares[own], (own + 1) / ((own + 1).sum() + 0.1), rtol=1e-4)
    assert len(trees.choices(np.array([-1]), np.array([9]))[0]) == 0  # a class without words of its own has no choice
