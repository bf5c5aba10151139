"""Near-duplicate groups by DartMinHash: hashed darts in weighted regions, banded joining, exact verification."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackmill.llm.common import chunks, counted, documents, in_filter, key_filter, mix64, word_hashes
from stackmill.session import stored

SHINGLE = 5
SIMILARITY = 0.8
#: Coordinates of a signature, and coordinates per band: 24 bands of 4. A pair at similarity 0.8 shares no band with
#: probability (1 - 0.8**4)**24 = 3e-6.
COORDINATES, ROWS = 96, 4
#: Height of the lowest rank interval over a weight interval of width 1.
FLOOR = 1 / 16


def windows(text: str) -> np.ndarray:
    """Sorted hashes of all five-word windows; a text of one to four words is one window; no words, no windows."""
    words = word_hashes(text.encode())[0]
    if not len(words):
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return np.sort(mix64(out))


def shingles(text: str, weighted: bool = False) -> np.ndarray:
    """Distinct hashes of the five-word windows. ``weighted``: the n-th occurrence of a window is an element of its own, so that
    the Jaccard similarity of these sets is the weighted one of the windows by their counts."""
    out = windows(text)
    if not len(out):
        return out
    first = np.flatnonzero(np.concatenate(([True], out[1:] != out[:-1])))
    if not weighted:
        return out[first]
    nth = (np.arange(len(out)) - np.repeat(first, np.diff(np.append(first, len(out))))).astype(np.uint64)
    return np.where(nth > 0, mix64(out + nth * np.uint64(0x632BE59BD9B4E019)), out)


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson numbers from uniform ones by the inverse of the distribution."""
    top = int(mean + 12 * math.sqrt(mean) + 20)
    k = np.arange(top + 1)
    logs = -mean + k * math.log(mean) - np.cumsum(np.log(np.maximum(k, 1)))
    return np.searchsorted(np.cumsum(np.exp(logs)), u, side="right")


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """DartMinHash signatures (n x k) of n weighted sets, given as flat elements with owners 0..n-1.

    The plane of an element, weight by rank, is cut into intervals that double; each region gets a Poisson number of darts
    from the hash of element and region, the same in every set. A dart counts in a set if its weight lies below the
    element's weight and its rank below the set's threshold, chosen so that about k ln k + 2k darts count. Each dart names a
    coordinate; the earliest dart (lowest rank) of a coordinate is its value. A set with an empty coordinate doubles its
    threshold. Two sets agree in a coordinate with the probability of their weighted Jaccard similarity. Sets without
    elements get zeros.
    """
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weights, n)
    limit = np.divide(k * math.log(k) + 2 * k, total, out=np.zeros(n), where=total > 0)
    open_sets = total > 0
    while open_sets.any():
        sets, marks, ranks, names = [], [], [], []
        inside = open_sets[owner]
        e, w, o = elements[inside], weights[inside], owner[inside]
        level, low, width = 0, 0.0, 1.0
        while len(e):
            start, height, step = 0.0, FLOOR / width, 0
            near, nw, no = e, w, o
            while len(near):
                region = mix64(near ^ np.uint64((level * 4096 + step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                count = _poisson(_uniform(region), width * height)
                at = np.repeat(np.arange(len(near)), count)
                if len(at):
                    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                    dart = mix64(region[at] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
                    rank = start + height * _uniform(dart)
                    second = mix64(dart + np.uint64(0x632BE59BD9B4E019))
                    hit = (rank < limit[no[at]]) & (low + width * _uniform(second) < nw[at])
                    sets.append(no[at][hit])
                    names.append(dart[hit])
                    ranks.append(rank[hit])
                    marks.append((mix64(second[hit]) % np.uint64(k)).astype(np.int64))
                start, height, step = start + height, height if step == 0 else 2 * height, step + 1
                more = limit[no] > start
                near, nw, no = near[more], nw[more], no[more]
            low, width, level = low + width, width if level == 0 else 2 * width, level + 1
            more = w > low
            e, w, o = e[more], w[more], o[more]
        owners, place, rank, name = map(np.concatenate, (sets, marks, ranks, names))
        cell = owners * k + place
        order = np.lexsort((rank, cell))
        cells, first = np.unique(cell[order], return_index=True)
        out.reshape(-1)[cells] = name[order][first]
        filled = np.bincount(cells // k, minlength=n)
        open_sets &= filled < k
        limit[open_sets] *= 2
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One number per band, from its coordinates and its place."""
    n, k = signature.shape
    grouped = signature.reshape(n, k // rows, rows)
    out = np.tile(mix64(np.arange(1, k // rows + 1, dtype=np.uint64)), (n, 1))
    for r in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return out


def sketches(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """``doc_id, key, n, bands``: a key of the windows and their weights, the sum of the weights, and the bands of the
    signature. A window weighs as often as it occurs, or 1 if not ``weighted``."""

    def run(frames):
        for frame in frames:
            for part, texts in chunks(frame, limit=500_000):
                sets = [np.unique(windows(t), return_counts=True) for t in texts]
                if not weighted:
                    sets = [(e, np.ones(len(e), np.int64)) for e, _ in sets]
                owner = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
                elements, weights = (np.concatenate(x) for x in zip(*sets, strict=True))
                found = bands(signatures(elements, weights.astype(float), owner, len(sets))).view(np.int64)
                keys = [hashlib.blake2b(e.tobytes() + w.tobytes(), digest_size=16).hexdigest() if len(e) else None for e, w in sets]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(object), "key": keys, "n": [int(w.sum()) for _, w in sets], "bands": list(found)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, key string, n long, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, weighted: bool = True) -> DataFrame:
    """``id, shingles`` of at least the documents in ``ids`` (``key``). A filter of fixed size keeps the other texts out of the
    shuffle; the few it lets through join with nothing."""
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(ids))

    def run(frames):
        for frame in frames:
            frame = frame[frame["doc_id"].notna()]
            frame = frame[in_filter(sent.value, frame["doc_id"].to_numpy(np.int64).view(np.uint64))]
            for part, texts in chunks(frame):
                yield pd.DataFrame({"id": part["doc_id"], "shingles": [shingles(t, weighted).view(np.int64) for t in texts]})

    return docs.select("doc_id", "text").mapInPandas(run, "id long, shingles array<long>")


#: Rows of a small table that one task of the next step reads.
ROWS_A_TASK = 100_000


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (least id reached) of every id in ``links`` (``a, b``), by alternating large-star and small-star
    steps until the links are stars. All state stays in tables of the shared folder; the steps use as many tasks as the
    links need, which the job that writes them counts, with the mark that tells when nothing changes any more."""
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")
    edges, now = counted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links", mark)
    before = None
    while now["rows"] and now != before:
        before, tasks = now, 1 + 2 * now["rows"] // ROWS_A_TASK
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").coalesce(tasks)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges, now = counted(small.where("u <> v").distinct().coalesce(tasks), "links", mark)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """``id, component`` when ``links`` (``a, b``) join components known so far. Only the new links are walked, between the
    components they connect; a component's name is its least id, so the least name is the least id of what they form."""
    left = known.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    right = known.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    between = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    roots = components(between)
    renamed = known.join(roots.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left")
    fresh = roots.join(known.select("id"), "id", "left_anti")
    return stored(renamed.select("id", F.coalesce("root", "component").alias("component")).unionByName(fresh), "components")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, j``: exact Jaccard similarity of the pairs."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    j = pairs.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("j"))
    return j.groupBy("a", "b").agg(F.max("j").alias("j"))  # an id that repeats has several sets


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = True) -> DataFrame:
    """``doc_id, class_id, n_links``: one row per row of ``docs`` (``doc_id, text``).

    ``class_id`` is the least id of the texts that links of Jaccard similarity ``similarity`` or more connect (five-word
    shingles, weighted by how often each occurs in its text, or plain sets if not ``weighted``); ``n_links`` counts the links of the row's set of shingles that were verified, which are those the
    classes need. Equal sets of shingles (exact copies) share one representative, so a large group of copies costs one row
    per band. No bucket is capped and none is expanded into all pairs; each step compares only texts that are not connected
    yet: first every text with the most central member of one of its buckets, then with those of all its buckets. Members
    of buckets that still hold several classes go through a prefix filter, which is exact: two sets this similar share one
    of their rarest shingles, so a text whose rarest shingles are its own has no further link.

    A null or empty text has no shingles and is its own class, as is a row with a null id (null class). Rows that repeat an
    id are one document to the links. Other columns are ignored; an empty table gives an empty table.
    """
    sketch = stored(sketches(docs, weighted), "sketches")
    known = sketch.where("key IS NOT NULL AND doc_id IS NOT NULL")
    heads = stored(known.groupBy("key").agg(F.min(F.struct("doc_id", "n", "bands")).alias("h")).select("key", F.col("h.doc_id").alias("id"), F.col("h.bands").alias("bands")), "heads")
    member = heads.select("id", F.explode("bands").alias("bucket")).distinct()
    sizes = member.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    member = stored(member.join(sizes, "bucket"), "members")
    central = member.groupBy("id").agg(F.sum("m").alias("central"))
    member = stored(member.select("bucket", "id").join(central, "id"), "members")
    led = member.groupBy("bucket").agg(F.max(F.struct("central", (-F.col("id")).alias("back"))).alias("h")).select("bucket", "h.central", (-F.col("h.back")).alias("leader"))
    led = stored(member.select("bucket", "id").join(led, "bucket"), "led")
    sets = stored(shingle_sets(docs, member.select(F.col("id").alias("key")), weighted), "sets")

    pairs = led.where("id <> leader").groupBy(F.col("id").alias("a")).agg(F.max(F.struct("central", (-F.col("leader")).alias("back"))).alias("h")).select("a", (-F.col("h.back")).alias("b"))
    checked = stored(_verified(pairs, sets), "verified")
    component = stored(components(checked.where(F.col("j") >= similarity).select("a", "b")), "components")
    pairs = _apart(led, component, "id", "leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    more = stored(_verified(pairs.join(checked, ["a", "b"], "left_anti"), sets), "verified")
    component = merged(component, more.where(F.col("j") >= similarity).select("a", "b"))
    checked = checked.unionByName(more)

    classes = member.select("bucket", "id").join(component, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    mixed = classes.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    open_ids = stored(classes.join(mixed, "bucket").select("id", "component").distinct(), "open")
    # 32 bits of a shingle are enough here: a collision can only add a candidate
    shingle = open_ids.join(sets, "id").select("id", "component", F.size("shingles").alias("n"), F.explode(F.transform("shingles", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))).alias("s"))
    common = shingle.groupBy("s").agg(F.count("*").alias("df"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("s", "df")
    # what no other class holds comes first in the order and joins with nothing; then the rarest
    held = shingle.select("id", "s").join(common, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("held"))
    held = stored(held.join(open_ids.join(sets.select("id", F.size("shingles").alias("n")), "id"), "id"), "held")
    front = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9)) + 1 - (F.col("n") - F.size("held"))
    rare = held.where(front > 0).select("id", "component", "n", F.size("held").alias("most"), F.slice("held", F.lit(1), front.cast("int")).alias("front"))
    rare = rare.select("*", F.posexplode("front").alias("at", "h")).select("id", "component", "n", "most", "h.s", F.slice(F.col("front.s"), F.lit(1), F.col("at")).alias("earlier"))
    spread = rare.groupBy("s").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("s")
    rare = stored(rare.join(spread, "s"), "rare")
    other = rare.select(F.col("id").alias("b"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("most").alias("other_most"), F.col("earlier").alias("other_earlier"), "s")
    # from their first common shingle on, two texts share at most what each still shares with other classes, and they need
    # similarity / (1 + similarity) of the sum of their sizes
    left = F.least(F.col("most") - F.size("earlier"), F.col("other_most") - F.size("other_earlier"))
    enough = left >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-9
    once = ~F.arrays_overlap("earlier", "other_earlier")  # only their first common shingle makes a pair
    near = rare.join(other, "s").where((F.col("component") < F.col("c")) & enough & once)
    pairs = near.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()
    more = stored(_verified(pairs, sets), "verified")
    component = merged(component, more.where(F.col("j") >= similarity).select("a", "b"))
    checked = checked.unionByName(more)

    links = checked.where(F.col("j") >= similarity).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    named = heads.select("key", "id").join(component, "id", "left").join(degree, "id", "left")
    named = named.select("key", F.coalesce("component", "id").alias("class_id"), "n_links")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return sketch.select("doc_id", "key").join(named, "key", "left").select("doc_id", own.alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def _apart(rows: DataFrame, component: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two ids are not in one component yet."""
    left = component.select(F.col("id").alias("__a"), F.col("component").alias("__ca"))
    right = component.select(F.col("id").alias("__b"), F.col("component").alias("__cb"))
    joined = rows.join(left, F.col(a) == F.col("__a"), "left").join(right, F.col(b) == F.col("__b"), "left")
    return joined.where(F.coalesce("__ca", F.col(a)) != F.coalesce("__cb", F.col(b))).drop("__a", "__b", "__ca", "__cb")


def op5(spark, folder):
    return near_duplicates(documents(spark, folder))


def one_per_class(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that represent their class (the least id), with all their columns, whatever their names. Rows
    without an id all stay; of rows that repeat an id the one with the least text hash stays (nulls first)."""
    heads = near_duplicates(docs, similarity).where("doc_id = class_id").select(F.col("doc_id").alias("h")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = docs.select("doc_id", F.struct(F.xxhash64("text").alias("hash"), row.alias("row")).alias("r"))
    kept = kept.join(heads, F.col("doc_id") == F.col("h"), "left_semi")
    first = kept.groupBy("doc_id").agg(F.min("r").alias("r")).select("r.row.*")
    return first.unionByName(docs.where("doc_id IS NULL"))
