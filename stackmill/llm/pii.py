"""Personal data by weak supervision: regex, gazetteer and context labelers vote on spans, expectation-maximisation weighs them,
and a classifier trained on the result decides which spans are added to the exact patterns. DataFrame functions only."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackmill.llm.common import documents
from stackmill.session import stored

# Possessive repeats and starts at run edges (or where the last match ended) find the same leftmost matches as the plain
# patterns, in time linear in the text.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Candidates for added spans, each a kind of its own: values of any length behind a name and an equals sign or colon, with
#: blanks and quotes around them, long runs of letters and digits, numbers in groups, and spelled-out addresses.
CANDIDATES = {
    "secret": r"(?<![\p{L}0-9_-])[\p{L}0-9_-]{3,}+[\x22\x27]?+[\x20\t]*+[=:][\x20\t]*+(?:\x22[^\x22\s]{8,}+\x22|\x27[^\x27\s]{8,}+\x27|[\x22\x27]?+[A-Za-z0-9_./+=~-]{8,}+)",
    "key": r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+",
    "number": r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,5}\)?(?:[\x20.-][0-9]{2,6}){1,5}(?![0-9A-Za-z])",
    "spelled": r"(?i)(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z]{2,24}",
}
ORDER = (*BASE, *CANDIDATES)

#: Words of the gazetteer and context labelers. A secret's name may stand anywhere in a longer one.
SECRET_NAMES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|kennwort|passwort|contraseña|clave|motdepasse"
CONTEXT = "mail|contact|phone|telephone|tel|call|mobile|card|visa|iban|account|ssn|password|secret|key|login|user|address|telefon|konto|carte|compte|tarjeta|teléfono|cuenta"
AGAINST = "version|isbn|issn|page|pages|vol|volume|figure|fig|table|chapter|section|doi|license|copyright|http|https|score|total|year"
CONTEXT_REACH = 40
ROUNDS = 25


def spans(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, text>>`` of all matches: gaps and matches alternate, so places are their running lengths."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def put(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("text")))).alias("out"))

    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))
    return F.aggregate(pairs, start, put, lambda acc: acc["out"])


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Every second digit from the right doubles (nine less above nine); the sum must end in 0."""
    back = F.reverse(number)
    def digit(i):
        d = F.substring(back, i, 1).cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, i: s + F.coalesce(digit(i), F.lit(0))) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"))
    if kind == "card":
        number = digits(match)
        return F.length(number).between(13, 19) & luhn(number)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def _empty() -> Column:
    return F.array().cast("array<struct<start:int,end:int,text:string>>")


def _kept(kind: str) -> Column:
    hint = HINT[kind]
    there = F.col("text").rlike("[0-9]") if hint is None else F.contains(F.col("text"), F.lit(hint))
    if kind == "ip":
        there = F.col("text").rlike(r"[0-9]\.[0-9]")
    return F.when(there, F.filter(spans(F.col("text"), BASE[kind]), lambda s: valid(kind, s["text"]))).otherwise(_empty())


#: The labelers: +1 personal, -1 not, 0 no opinion. ``value`` is the span, ``before`` the text in front of it, in lower case.
LABELERS = {
    "strict": "CASE WHEN base THEN 1 ELSE 0 END",
    "checksum": "CASE WHEN base AND kind IN ('card', 'ip', 'phone') THEN 1 WHEN kind = 'number' THEN -1 ELSE 0 END",
    "gazetteer": f"CASE WHEN kind = 'secret' THEN CASE WHEN lower(value) RLIKE '^[^=:]*({SECRET_NAMES})' THEN 1 ELSE -1 END WHEN kind = 'key' AND value RLIKE '^(AKIA|ASIA|GHP|SK)' THEN 1 WHEN kind = 'email' AND value RLIKE '[.](com|org|net|edu|gov|io|de|fr|es|uk)$' THEN 1 ELSE 0 END",
    "context": f"CASE WHEN before RLIKE '(^|[^a-z])({CONTEXT})[^a-z]{{1,10}}$' THEN 1 WHEN before RLIKE '(^|[^a-z])({AGAINST})[^a-z]{{0,10}}$' THEN -1 ELSE 0 END",
    "shape": "CASE WHEN kind IN ('secret', 'key') THEN CASE WHEN value RLIKE '[0-9]' AND value RLIKE '[A-Za-z]' AND length(regexp_replace(value, '[^0-9]', '')) >= 3 THEN 1 ELSE -1 END WHEN kind = 'spelled' THEN 1 WHEN value RLIKE '^([0-9])\\\\1+$' THEN -1 ELSE 0 END",
    "mixture": "CASE WHEN kind = 'key' THEN CASE WHEN value RLIKE '[0-9]' AND value RLIKE '[A-Za-z]' THEN 1 ELSE -1 END WHEN kind = 'secret' THEN CASE WHEN value RLIKE '^[^=:]+[=:][^A-Za-z0-9]*[0-9.]+[^A-Za-z0-9]*$' THEN -1 ELSE 1 END ELSE 0 END",
}


def candidates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``base`` spans and ``more`` candidate spans (outside base spans), each with
    kind, places, votes and the kind's number."""
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    read = read.select("doc_id", "text", *[_kept(k).alias(f"f_{k}") for k in BASE])
    wide = {
        "secret": F.col("text").rlike("[=:]"), "key": F.col("text").rlike("[A-Za-z0-9]{16}"), "number": F.col("text").rlike(r"[0-9][\x20.-][0-9]"),
        "spelled": F.lower("text").rlike(r"[\[(]at[\])]"),
    }
    read = read.select("*", *[F.when(wide[k], spans(F.col("text"), p)).otherwise(_empty()).alias(f"f_{k}") for k, p in CANDIDATES.items()])

    def labelled(kind: str) -> Column:
        def one(s):
            begin = F.greatest(s["start"] - CONTEXT_REACH, F.lit(0))
            before = F.lower(F.substring(F.col("text"), begin + 1, s["start"] - begin))
            return F.struct(F.lit(ORDER.index(kind)).alias("k"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("value"), before.alias("before"), F.lit(kind in BASE).alias("base"))
        return F.transform(F.col(f"f_{kind}"), one)

    base = F.concat(*[labelled(k) for k in BASE])
    every = F.concat(*[labelled(k) for k in CANDIDATES])
    read = read.select("doc_id", base.alias("base"), every.alias("more"))
    outside = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return read.select("doc_id", "base", outside.alias("more"))


def _votes(rows: DataFrame) -> DataFrame:
    """``s`` (a span) becomes kind number, length class and one vote column per labeler."""
    flat = rows.select("s.*")
    return flat.select("k", F.least(F.floor(F.length("value") / 8), F.lit(8)).cast("int").alias("long"), *[F.expr(e).alias(n) for n, e in LABELERS.items()])


@dataclass
class Weak:
    """Share of personal spans, per labeler the probability that its votes are right, and the classifier's weights."""

    prior: float
    right: dict[str, float]
    intercept: float
    weights: dict[str, float]


FEATURES = ("long", *LABELERS, *[f"kind_{k}" for k in ORDER])


def reliabilities(patterns: list[tuple[dict[str, int], float]], rounds: int = ROUNDS) -> tuple[float, dict[str, float], list[float]]:
    """Expectation-maximisation over counted vote patterns: the share of personal spans, per labeler the probability that a
    vote it gives is right, and the probability of each pattern. No opinion says nothing; a labeler is never taken to be
    worse than chance, which keeps the two classes from changing places."""
    prior, right = 0.5, dict.fromkeys(LABELERS, 0.8)
    post = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (votes, _) in enumerate(patterns):
            odds = math.log(prior / (1 - prior)) + sum(v * math.log(right[n] / (1 - right[n])) for n, v in votes.items())
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = sum(c for _, c in patterns)
        good = sum(c * p for (_, c), p in zip(patterns, post, strict=True))
        prior = min(0.95, max(0.05, (good + 1) / (total + 2)))
        for n in right:
            given = sum(c for votes, c in patterns if votes[n])
            agreed = sum(c * (p if votes[n] > 0 else 1 - p) for (votes, c), p in zip(patterns, post, strict=True) if votes[n])
            right[n] = min(0.98, max(0.55, (agreed + 8) / (given + 10)))
    return prior, right, post


def learn(rows: DataFrame) -> Weak:
    """Fit on all candidates of ``candidates()``. Votes, kinds and length classes are counted by pattern first, so what is
    fitted (and what the driver sees) is bounded by the number of patterns, at most kinds x 9 x 3^labelers, not by the rows."""
    every = _votes(rows.select(F.explode(F.concat("base", "more")).alias("s")))
    counted = every.groupBy("k", "long", *LABELERS).agg(F.count("*").alias("n"))
    patterns = sorted((r.asDict() for r in counted.collect()), key=str)
    votes = [({n: r[n] for n in LABELERS}, float(r["n"])) for r in patterns]
    if not votes:
        return Weak(0.5, {}, 0.0, dict.fromkeys(FEATURES, 0.0))
    prior, right, post = reliabilities(votes)
    data = []
    for r, p in zip(patterns, post, strict=True):
        x = [float(r["long"]), *[float(r[n]) for n in LABELERS], *[float(r["k"] == i) for i in range(len(ORDER))]]
        data += [(*x, 1.0, p * r["n"]), (*x, 0.0, (1 - p) * r["n"])]
    spark = rows.sparkSession
    table = spark.createDataFrame(data, ", ".join(f"{n} double" for n in (*FEATURES, "label", "mass")))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(table)
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="mass", maxIter=50, regParam=1e-4).fit(ready)
    return Weak(prior, right, float(model.intercept), dict(zip(FEATURES, map(float, model.coefficients), strict=True)))


def find(docs: DataFrame, model: Weak | None = None) -> DataFrame:
    """``doc_id, base, more``: spans of every row of ``docs`` (``doc_id, text``), each ``kind, start, end, value`` in code
    points, end exclusive, by kind and start.

    Base spans are the valid matches of the four exact patterns, leftmost and not overlapping within a kind; they always
    stay. ``more`` are candidates outside base spans that the classifier gives 0.5 or more. Null texts count as empty and
    have no span; repeated rows give repeated results; null ids stay null; other columns are ignored. One map over whole
    texts, written once; learning and deciding read that narrow table.
    """
    found = stored(candidates(docs), "pii")
    model = model or learn(found)
    return decided(found, model)


def decided(found: DataFrame, model: Weak) -> DataFrame:
    """The spans of a stored ``candidates()`` table under a fitted model."""
    scored = F.expr("transform(more, s -> named_struct('s', s, 'p', " + _score_sql("s", model) + "))")
    kept = F.transform(F.filter(scored, lambda x: x["p"] >= 0.5), lambda x: x["s"])
    trim = lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))
    return found.select("doc_id", F.array_sort(F.transform("base", trim)).alias("base"), F.array_sort(F.transform(kept, trim)).alias("more"))


def _score_sql(name: str, model: Weak) -> str:
    """The classifier on a span, as SQL over its fields."""
    def on(sql: str) -> str:
        for column in ("kind", "value", "before", "base"):
            sql = _word(sql, column, f"{name}.{column}")
        return sql
    terms = [repr(model.intercept), f"{model.weights['long']!r} * least(floor(length({name}.value) / 8), 8)"]
    terms += [f"{model.weights[n]!r} * ({on(e)})" for n, e in LABELERS.items()]
    terms += [f"CASE WHEN {name}.k = {i} THEN {model.weights[f'kind_{k}']!r} ELSE 0D END" for i, k in enumerate(ORDER)]
    return f"1D / (1D + exp(-({' + '.join(terms)})))"


def _word(sql: str, column: str, by: str) -> str:
    """Replace a column name outside quoted texts."""
    parts = sql.split("'")
    return "'".join(re.sub(rf"\b{column}\b", by, p) if i % 2 == 0 else p for i, p in enumerate(parts))


def masked(docs: DataFrame, model: Weak | None = None) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in angle brackets; null texts stay null.

    The spans travel with the row's whole content, so repeated ids need no join. Overlapping spans are merged under the
    first one's kind. All other columns are kept.
    """
    rows = docs.withColumn("__row", F.struct(*docs.columns))
    found = stored(candidates(rows.select(F.col("__row").alias("doc_id"), "text")), "pii-rows")
    spans_of = decided(found, model or learn(found)).select(F.col("doc_id").alias("r"), F.array_sort(F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans"))
    text = F.col("r.text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc, s):
        fresh = s["start"] >= acc["at"]
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], between, F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(F.size("spans") == 0, text).otherwise(done)
    return spans_of.select(*[clean.alias("text") if c == "text" else F.col(f"r.{c}").alias(c) for c in docs.columns])


def _digest(spans_column: Column) -> Column:
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8(spark, folder):
    found = find(documents(spark, folder))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    every = F.array_sort(F.concat("base", "more"))
    return found.select("doc_id", *counts, F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(every).alias("spans"))
