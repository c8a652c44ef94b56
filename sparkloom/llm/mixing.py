"""Mixing to target weights by soft membership.

A classifier fitted on a bounded sample of a labelled table gives each document its posteriors over domains. Each document
then gets a rate of zero or more, such that the domains' expected tokens - the sum over documents of rate, tokens and
posterior - match the target weights. The rates minimise the squared distance of the domains' totals from their targets, in one
fixed metric, the inverse Gram matrix of the documents' posteriors, and, as little as NEAR of that, the squared distance of the
rates from 1, tokens being weights: so the rates are unique, and they are 1, less a linear form of the posteriors, cut at the bounds.
Its few coefficients are found by projected gradient steps on the dual problem, which has as many unknowns as there are domains,
scaled by the Gram matrix of the documents that no bound holds (Newton's metric). A round of the distributed sums tries several
step lengths at once, and the one of the greatest dual value is taken; only some numbers for each domain come to the driver and go
back. No step writes or shuffles a row. Projected gradient steps on the rates themselves reach the same optimum, but took up to
200 rounds and more where targets can't be reached. Where the best totals miss their targets, because no rates of zero or more
reach them, a warning says by how much.

Domains, from labels (quality, toxic): ``toxic`` if toxic is 1, else ``low`` if quality is 0, else ``clean``. The total is set
by the ``anchor`` domain, whose tokens are to stay as many as they are. Where rates are bounded (the pipeline's stage keeps a
document with its rate as probability and repeats none, so rates may not exceed 1) no domain shall have more tokens than the
weights' proportion to the anchor's that are left, and of the anchor's KEPT_ANCHOR shall be left: what is over, and what the
anchor lacks, is what is squared. Nothing is dropped to make up for a domain that has too few.

Defined results: tokens are words between white space. A null or empty text has no tokens, the prior's posteriors and a rate
like any other. Labels without a domain or document are ignored, repeated ones count repeatedly. Domains without labels have
posterior 0; without any labels, all documents are ``clean``. A domain that has no expected tokens, or under a
MOST_REPEATS-th of its target, has no say: its total stays free. Rows stay rows,
whatever their ids. An empty table gives no rows. Other columns are ignored by mix() and kept by stage(), whatever their names.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import columns, cut, load, map_arrow, row_and, scratch

DOMAINS = ("clean", "low", "toxic")
#: Target weights of the domains in the mix.
WEIGHTS = {"clean": 0.95, "low": 0.04, "toxic": 0.01}
ANCHOR = "clean"
#: Labelled rows of each domain that the classifier is fitted on, at most about.
SAMPLE_ROWS = 600
#: Hashed word stems, and shape features beside them.
STEMS, STEM_LETTERS, SHAPES = 8192, 4, 8
#: A stem counts in full from this share of the words on.
FULL_SHARE = 1 / 50
KEPT_WORDS = 150_000
FIT_ROUNDS, RIDGE = 200, 1e-4
#: Weight of the rates' distance from 1; rounds at most; the share of all tokens below which the dual's gradient counts as zero, and within which totals meet their targets.
NEAR, STEPS, STILL, MET = 1e-5, 100, 1e-9, 1e-4
#: Step lengths that are tried at once.
LENGTHS = (1.0, 0.5, 0.2, 0.05, 1e-2, 1e-3, 1e-5)
#: Share of the anchor's tokens that bounded rates shall leave, and how much more its lack weighs than what others are over.
KEPT_ANCHOR, ANCHOR_WEIGHT = 0.5, 16.0
#: How many times over a domain may have to be repeated, on average, to meet its target.
MOST_REPEATS = 10


class Stems(dict):
    """Hashed stem of each word; words are kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = zlib.crc32(word.lower()[:STEM_LETTERS].encode("utf-8", "replace")) % STEMS
        return found


_stems = Stems()


def features(text: str | None) -> tuple[int, np.ndarray]:
    """Words, and the feature vector: shares of stems, and shapes, between 0 and about 1."""
    words = text.split() if text else []
    out = np.zeros(STEMS + SHAPES, np.float32)
    if words:
        n, chars = len(words), len(text)
        stems = np.bincount(np.fromiter(map(_stems.__getitem__, words), np.int64, n), minlength=STEMS)
        out[:STEMS] = np.minimum(1, stems / (n * FULL_SHARE))
        marks = [text.count(c) for c in "!|#$%&*"]
        out[STEMS:] = (len(set(words)) / n, sum(map(str.isupper, words)) / n, marks[0] / n, marks[1] / n, sum(marks[2:]) / n, min(1.0, n / 50), chars / n / 20, sum(a == b for a, b in zip(words, words[1:])) / n)
    return len(words), out


@dataclass
class Classifier:
    weights: np.ndarray  # features by domains
    bias: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def domain() -> Column:
    return F.when(F.col("toxic") == 1, F.lit(2)).when(F.col("quality") == 0, F.lit(1)).when(F.col("quality") == 1, F.lit(0))


def _collect_features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix and domains of (domain, text) rows; what a row sends is bounded by the number of features, whatever its text's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                own = batch.slice(k, 500)
                found = [features(t)[1] for t in own.column(1).to_pylist()]
                places = [np.flatnonzero(x).astype(np.int16) for x in found]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([x.tobytes() for x in places], pa.binary()), pa.array([x[at].tobytes() for x, at in zip(found, places)], pa.binary())], names=["domain", "places", "x"])

    found = map_arrow(rows, run, "domain int, places binary, x binary").sort("domain", "places", "x").toArrow()
    out = np.zeros((len(found), STEMS + SHAPES), np.float32)
    for row, places, x in zip(out, found.column("places"), found.column("x")):
        row[np.frombuffer(places.as_py(), np.int16)] = np.frombuffer(x.as_py(), np.float32)
    return out, found.column("domain").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Softmax regression on the labelled documents whose ids hash lowest, as many of each domain, then set to the domains' shares."""
    known = labels.select(F.col("doc_id").alias("labelled"), domain().alias("domain")).where("domain is not null and labelled is not null")
    docs = docs.select("doc_id", "text")
    counts = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    bias = np.full(len(DOMAINS), -1e9)
    if not counts:
        bias[0] = 0.0
        return Classifier(np.zeros((STEMS + SHAPES, len(DOMAINS)), np.float32), bias)
    total = sum(counts.values())
    for k, n in counts.items():
        bias[k] = np.log(n / total)
    share = F.coalesce(*(F.when(F.col("domain") == k, F.lit(min(1.0, sample_rows / n))) for k, n in sorted(counts.items())))
    few = known.where(F.pmod(F.xxhash64(F.col("labelled"), F.lit(8)), F.lit(1 << 20)) < share * (1 << 20))
    # few has about sample_rows rows a domain
    x, y = _collect_features(docs.join(F.broadcast(few), F.col("doc_id") == F.col("labelled")).select("domain", "text"))
    weights = np.zeros((x.shape[1], len(DOMAINS)), np.float32)
    if len(set(y.tolist())) < 2:
        return Classifier(weights, bias)
    seen = np.bincount(y, minlength=len(DOMAINS))
    each = (1 / np.maximum(seen, 1))[y] / (seen > 0).sum()
    target = np.eye(len(DOMAINS), dtype=np.float32)[y]
    offset = np.where(seen > 0, 0.0, -1e9).astype(np.float32)
    step, ahead, t = np.float32(30 / max(1.0, float(np.einsum("ij,ij->i", x, x).mean()))), weights, 1.0
    for _ in range(FIT_ROUNDS):  # accelerated gradient; the step follows the rows' mean squared length, which bounds the curvature
        z = x @ ahead + offset
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gradient = x.T @ ((p - target) * each[:, None].astype(np.float32)) + np.float32(RIDGE) * ahead
        after, t_after = ahead - step * gradient, (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = after + np.float32((t - 1) / t_after) * (after - weights)
        weights, t = after, t_after
    return Classifier(weights, bias)


def posteriors(docs: DataFrame, classifier: Classifier, keep: tuple[str, ...]) -> DataFrame:
    """Struct ``row`` of the kept columns, tokens, and a column p0, p1, ... for each domain."""
    whole = "text" in keep  # then it goes once
    left = docs.select(F.struct(*columns(keep)).alias("row"), *([] if whole else ["text"]))
    names = [f"p{k}" for k in range(len(DOMAINS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 100):
                own = batch.slice(k, 100)
                texts = own.column(0).field(keep.index("text")) if whole else own.column(1)
                found = [features(t) for t in texts.to_pylist()]
                p = classifier.posteriors(np.stack([x for _, x in found]))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([n for n, _ in found], pa.int64()), *(pa.array(p[:, j].astype(np.float64)) for j in range(p.shape[1]))], names=["row", "tokens", *names])
        _stems.clear()  # workers are used again by other operators

    return map_arrow(left, run, row_and(left, "tokens long, " + ", ".join(f"{n} double" for n in names)))


def targets(totals: np.ndarray, weights: dict[str, float], anchor: str, lower_only: bool = False) -> np.ndarray:
    """Token totals in the weights' proportions with as many tokens of the anchor as there are. Domains that have no say keep theirs."""
    w, k = np.array([weights[d] for d in DOMAINS]), DOMAINS.index(anchor)
    if w[k] == 0 or totals[k] == 0:
        return totals.copy()
    wanted = w * totals[k] / w[k]
    return np.where((totals < wanted) if lower_only else (totals * MOST_REPEATS < wanted), totals, wanted)


@dataclass
class Rates:
    """The coefficients by domain, the domains' totals and targets, the weighted squared distance, the rounds taken, and whether the optimum is reached and totals meet their targets."""

    push: np.ndarray
    totals: np.ndarray
    targets: np.ndarray
    objective: float
    rounds: int
    optimal: bool
    settled: bool
    at_most: float | None = None

    def of(self, p: list[Column]) -> Column:
        """The rate of a document with these posteriors."""
        return _rate(_form(self.push, p), self.at_most)


def _form(push: np.ndarray, p: list[Column]) -> Column:
    return sum((p[k] * float(push[k]) for k in range(1, len(p))), p[0] * float(push[0]))


def _rate(form: Column, at_most: float | None) -> Column:
    rate = F.greatest(F.lit(0.0), 1 - form)
    return rate if at_most is None else F.least(F.lit(at_most), rate)


def solve(members: DataFrame, weights: dict[str, float] | None = None, anchor: str = ANCHOR, steps: int = STEPS, at_most: float | None = None) -> Rates:
    """The least-squares rates; members has tokens and the posteriors, and is read once a round, so keep it first.

    What is measured are linear forms of the posteriors, one a row of ``forms``: without a bound on rates the domains that have a say, whose totals
    are to equal the targets; with one, each domain less the weights' proportion of the anchor and what the anchor lacks, whose totals are to be 0 or less."""
    width, own, k0 = range(len(DOMAINS)), weights or WEIGHTS, DOMAINS.index(anchor)
    p, tokens = [F.col(f"p{k}") for k in width], F.col("tokens").cast("double")
    row = members.agg(*(F.sum(tokens * p[k]).alias(f"s{k}") for k in width), *(F.sum(tokens * p[i] * p[j]).alias(f"g{i}{j}") for i in width for j in width)).first()
    totals = np.array([row[f"s{k}"] or 0.0 for k in width])
    gram = np.array([[row[f"g{i}{j}"] or 0.0 for j in width] for i in width])
    scale, fixed = totals.sum(), targets(totals, own, anchor, at_most is not None)
    found = Rates(np.zeros(len(DOMAINS)), totals, fixed, 0.0, 0, True, True, at_most)
    upper_only = at_most is not None
    if upper_only:
        held = list(width) if own[anchor] and totals[k0] else []
    else:
        held = [k for k in width if k == k0 or fixed[k] != totals[k]]
    if not scale or not held:
        return found
    forms, wanted = np.eye(len(DOMAINS))[held], fixed[held]
    if upper_only:
        forms[:, k0], wanted = [-own[d] / own[anchor] for d in DOMAINS], np.zeros(len(held))
        wanted[k0] = -KEPT_ANCHOR * totals[k0]
    inner = forms @ gram @ forms.T
    if upper_only:  # what is over is told form by form
        spread = np.diag(np.maximum(np.diag(inner), 1e-12 * scale) / np.where(np.arange(len(inner)) == k0, ANCHOR_WEIGHT, 1.0))
    else:
        spread = inner + 1e-12 * np.trace(inner) * np.eye(len(inner))
    metric = np.linalg.inv(spread)

    narrow, count = members.select(tokens.alias("tokens"), *p), len(DOMAINS)

    def values(duals: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each the dual value, the domains' totals, and the Gram matrix of the documents that no bound holds: sums over all documents, made in each task and then over tasks."""
        pushes = np.array([forms.T @ y for y in duals])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(pushes), 1 + count + count * count))
            for batch in batches:
                t, *q = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                q = np.stack(q, axis=1)
                for n, push in enumerate(pushes):
                    form = q @ push
                    left = 1 - form / NEAR
                    rate = np.clip(left, 0, at_most)
                    live = np.where((left > 0) & (True if at_most is None else left <= at_most), t, 0.0)
                    out[n, 0] += (t * (NEAR / 2 * (rate - 1) ** 2 + rate * form)).sum()
                    out[n, 1 : 1 + count] += (t * rate) @ q
                    out[n, 1 + count :] += ((q * live[:, None]).T @ q).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["k", "x"])

        got = np.zeros(len(pushes) * (1 + count + count * count))
        for r in narrow.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():  # as many rows as there are sums
            got[r["k"]] = r["x"]
        rows = got.reshape(len(pushes), -1)
        return [(float(x[0] - y @ spread @ y / 2 - wanted @ y), x[1 : 1 + count], x[1 + count :].reshape(count, count)) for x, y in zip(rows, duals)]

    dual, at, live = np.zeros(len(held)), totals, gram
    value = -np.inf
    found.optimal = False
    while True:
        slope = forms @ at - wanted - spread @ dual
        free = (dual > 0) | (slope > 0) if upper_only else np.ones(len(held), bool)
        if np.abs(np.where(free, slope, 0)).max() <= STILL * scale:
            found.optimal = True
            break
        if found.rounds >= steps:
            break
        bend = (forms @ live @ forms.T / NEAR + spread)[np.ix_(free, free)]
        way = np.zeros(len(held))
        way[free] = np.linalg.solve(bend + 1e-14 * np.trace(bend) * np.eye(len(bend)), slope[free])
        tried = [dual + x * way for x in LENGTHS]
        tried = [np.maximum(y, 0) for y in tried] if upper_only else tried
        results = values(tried)
        found.rounds += 1
        best = max(range(len(tried)), key=lambda n: results[n][0])
        if results[best][0] <= value:  # nothing within a double's reach is better
            found.optimal = True
            break
        dual, (value, at, live) = tried[best], results[best]
    missed = forms @ at - wanted
    missed = np.maximum(missed, 0) if upper_only else missed
    found.push, found.totals, found.objective = forms.T @ dual / NEAR, at, float(missed @ metric @ missed / 2)
    found.targets = targets(at, own, anchor, True) if upper_only else np.where([k in held for k in width], fixed, at)
    found.settled = bool(np.abs(missed).max() <= MET * scale)
    if not found.settled:
        reason = "no rates reach them" if found.optimal else f"{steps} rounds didn't reach the optimum"
        warnings.warn(f"rates leave the totals at {found.totals.tolist()} for targets {found.targets.tolist()}: {reason}", stacklevel=2)
    return found


def fit_rates(members: DataFrame, weights: dict[str, float] | None = None, anchor: str = ANCHOR, steps: int = STEPS, at_most: float | None = None) -> DataFrame:
    """members with column rate."""
    return members.withColumn("rate", solve(members, weights, anchor, steps, at_most).of([F.col(f"p{k}") for k in range(len(DOMAINS))]))


def mix(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), weights: dict[str, float] | None = None) -> DataFrame:
    """Struct ``row``, tokens, posteriors and rate of each document."""
    return fit_rates(cut(posteriors(docs, fit(docs, labels), keep)), weights)


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select("row.doc_id", "tokens", *(F.round(f"p{k}", 6).alias(f"p_{d}") for k, d in enumerate(DOMAINS)), F.round("rate", 6).alias("rate"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents kept with their rate, 1 at most, as probability, drawn by a hash of id and text, so equal rows share their fate.

    The documents go once, with their posteriors, to a scratch folder whose narrow columns the steps read; no row is shuffled."""
    folder = scratch(spark, "mixing")
    posteriors(docs, fit(docs, load(spark, sf_dir, "labels")), tuple(docs.columns)).write.parquet(folder)
    members = spark.read.parquet(folder)
    drawn = F.pmod(F.xxhash64("row.doc_id", "row.text", F.lit(88)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return fit_rates(members, at_most=1.0).where(drawn < F.col("rate")).select("row.*")


QUERIES = {"op8_soft_mixing": op8_soft_mixing}
ORACLE_SQL: dict[str, str] = {}
