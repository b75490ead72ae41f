"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w[i] + sum over pairs of v[i].v[j]) over the distinct terms of a
text, so pairs such as an insult and a group named with it can weigh more than their parts.

A term is a lower-cased run of letters and digits (every non-ASCII character counts as a letter), or
its first 5, 6 or 7 bytes, which inflected insults share; terms are hashed into `buckets`. The model is
fitted on at most `max_rows` labelled rows, those whose hash of id and text is lowest. Of their terms it learns all that
have to do with the label, by two tests that keep noise out and drop nothing else:

* by themselves: the likelihood ratio of the term and the label reaches `least_ratio`;
* in pairs: among the documents that hold both terms of a pair, the labels differ from what a model of the terms above
  expects of them by a likelihood ratio of `least_pair_ratio`, which by chance not one of 10^10 pairs does. So two
  terms that say nothing each, but much together, are learned as well. All pairs are counted, on the executors, but for
  those that a bound on the ratio rules out.

Scoring reads every text once, without a shuffle.

Defined results: a null text scores as the empty one; no label, or labels of one kind only,
gives a constant model; several labels of a document count as the highest; null labels and
null ids in labels are ignored; rows of a labelled id with equal texts are fitted once, other rows of it each;
repeated rows are scored each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, materialize, utf8

PREFIXES = (5, 6, 7)
_SEPARATE = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    max_rows: int = 20_000  #: labelled documents fitted on at most
    buckets: int = 1 << 24
    least_ratio: float = 8.0  #: log-likelihood ratio of a term that is learned for itself
    least_pair_ratio: float = 25.0  #: and of a pair
    factors: int = 8
    epochs: int = 30
    batch: int = 1024
    rate: float = 0.03
    penalty: float = 2e-4
    threshold: float = 0.3
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """No larger than the terms of the fitted sample."""

    terms: np.ndarray  #: sorted buckets
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    settings: Settings

    def score(self, rows: np.ndarray) -> float:
        v = self.vectors[rows]
        total = v.sum(0)
        z = self.bias + self.weights[rows].sum() + 0.5 * float(total @ total - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def words_of(text: bytes) -> set[bytes]:
    return set(text.decode(errors="replace").lower().encode().translate(_SEPARATE).split())


def terms_of(word: bytes, buckets: int) -> list[int]:
    """The buckets of a word and of its beginnings."""
    return [xxhash.xxh3_64_intdigest(w) % buckets for w in (word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n))]


class _Terms(dict):
    """word -> its terms; remembered for a bounded number of words."""

    def __init__(self, buckets: int, limit: int = 200_000):
        self.buckets, self.limit = buckets, limit

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = tuple(terms_of(word, self.buckets))
        return found


def _counts(buckets: int):
    """term, present, positive: of each batch's documents, how many hold the term, and how many of those are labelled."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of_word = _Terms(buckets)
        for b in batches(it, 4 << 20):
            found = [set().union(*map(terms_of_word.__getitem__, words_of(t))) for t in b.column("text").to_pylist()]
            flat = np.fromiter((x for f in found for x in f), np.int64, sum(map(len, found)))
            terms, at = np.unique(flat, return_inverse=True)
            marked = np.repeat(b.column("label").to_numpy() > 0.5, [len(f) for f in found])
            columns = (terms, np.bincount(at, minlength=len(terms)), np.bincount(at, weights=marked, minlength=len(terms)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["term", "present", "positive"])

    return run


def _chosen_rows(model: Model):
    """rows, label: each document's rows in the model, packed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(model)
        for b in it:
            packed = [rows.of(t).astype(np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), b.column("label")], ["rows", "label"])

    return run


def association(n: int, n_positive: int) -> Column:
    """Log-likelihood ratio of a term's presence and the label, from the columns present and positive."""
    present, positive = F.col("present"), F.col("positive")
    cells = [
        (positive, present, n_positive),
        (present - positive, present, n - n_positive),
        (n_positive - positive, n - present, n_positive),
        (n - n_positive - present + positive, n - present, n - n_positive),
    ]
    parts = [F.when(o > 0, o * F.log(o * float(n) / (r * float(k)))).otherwise(0.0) for o, r, k in cells if k]
    return sum(parts[1:], parts[0])


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column | None = None, settings: Settings = Settings()) -> Model:
    """Fits on documents whose label row satisfies `usable` (a condition on doc_id).

    The labels' side of the join has max_rows rows at most, which bounds its broadcast, and so has the sample,
    however often a labelled id occurs. Terms are counted on the executors; the driver gets the terms that pass a test, and of
    each fitted document those that it holds.
    """
    s = settings
    known = labels.select("doc_id", F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null")
    known = (known if usable is None else known.where(usable)).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    chosen = known.orderBy(F.xxhash64(F.lit(s.seed), "doc_id"), "doc_id").limit(s.max_rows)
    place = F.xxhash64(F.lit(s.seed), "doc_id", "text").alias("place")
    sample = materialize(texts.join(F.broadcast(chosen), "doc_id").select(place, "text", "label"), "labelled")
    places = sample.select("place").distinct().orderBy("place").limit(s.max_rows)
    n_places, last = places.agg(F.count("*"), F.max("place")).first()
    if n_places < sample.count():
        sample = materialize(sample.where(F.col("place") <= last).dropDuplicates(["place"]), "labelled")
    n, n_positive = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("label") > 0.5).cast("int")), F.lit(0))).first()
    rate = (n_positive + 0.5) / (n + 1) if n else 0.01
    none = Model(np.empty(0, np.int64), float(np.log(rate / (1 - rate))), np.empty(0), np.empty((0, s.factors)), s)
    if n_positive in (0, n):
        return none
    counts = sample.mapInArrow(_counts(s.buckets), "term bigint, present bigint, positive bigint").groupBy("term").agg(F.sum("present").alias("present"), F.sum("positive").alias("positive"))
    ratios = counts.select("term", F.round(association(n, n_positive), 6).alias("ratio")).where(F.col("ratio") >= s.least_ratio)
    alone = _fitted(sample, [r.term for r in ratios.select("term").collect()], none)
    paired = _paired_terms(sample, alone, n_positive / n)
    return _fitted(sample, sorted({*alone.terms.tolist(), *paired}), none) if set(paired) - set(alone.terms.tolist()) else alone


def _fitted(sample: DataFrame, terms: list[int], none: Model) -> Model:
    """The model of some terms; `none` is the one of no terms."""
    if not terms:
        return none
    s, terms = none.settings, np.array(sorted(terms), np.int64)
    empty = Model(terms, none.bias, np.zeros(len(terms)), np.zeros((len(terms), s.factors)), s)
    rows = sample.mapInArrow(_chosen_rows(empty), "rows binary, label double").collect()
    rows.sort(key=lambda r: (bytes(r[0]), r[1]))  # the order of tasks must not change the model
    return _learn(empty, [np.frombuffer(bytes(r[0]), np.int32) for r in rows], np.array([r[1] > 0.5 for r in rows], float))


def pair_ratio(both: np.ndarray, positive: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of the labels of documents that hold both terms against what is expected of them."""
    with np.errstate(divide="ignore", invalid="ignore"):
        marked = np.where(positive > 0, positive * np.log(positive / expected), 0.0)
        others = np.where(both > positive, (both - positive) * np.log((both - positive) / (both - expected)), 0.0)
    return marked + others


def _losses(model: Model, low: float):
    """term, loss: of each batch's documents, the summed log losses of those that hold the term."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of_word, known = _Terms(model.settings.buckets), _Rows(model)
        for b in batches(it, 4 << 20):
            texts = b.column("text").to_pylist()
            found = [set().union(*map(terms_of_word.__getitem__, words_of(t))) for t in texts]
            p = np.clip([known.score(t) for t in texts], low, 1 - low)
            loss = -np.log(np.where(b.column("label").to_numpy() > 0.5, p, 1 - p))
            terms, at = np.unique(np.fromiter((x for f in found for x in f), np.int64, sum(map(len, found))), return_inverse=True)
            weights = np.bincount(at, weights=np.repeat(loss, [len(f) for f in found]), minlength=len(terms))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(weights, pa.float64())], ["term", "loss"])

    return run


def _paired_terms(sample: DataFrame, model: Model, rate: float, blocks: int = 48) -> list[int]:
    """The terms of pairs that `least_pair_ratio` marks, given what `model` expects.

    A pair's ratio is never above the summed log losses of the documents that hold one of its terms (Jensen's
    inequality), so terms whose sum is below the ratio are in no such pair; where the model of single terms explains
    the labels, few are left. Expectations are at least half the rarer label's rate. Each task takes its share of the terms
    as first of a pair and counts all pairs with them; the documents' terms and expectations, of the bounded sample, are broadcast.
    """
    s, spark = model.settings, sample.sparkSession
    low = min(rate, 1 - rate) / 2
    losses = sample.mapInArrow(_losses(model, low), "term bigint, loss double").groupBy("term").agg(F.sum("loss").alias("loss"))
    terms = np.array(sorted(r.term for r in losses.where(F.col("loss") >= s.least_pair_ratio - 1e-6).select("term").collect()), np.int64)
    if not len(terms):
        return []
    rows = sample.mapInArrow(_pair_rows(Model(terms, 0.0, np.zeros(len(terms)), np.zeros((len(terms), 1)), s), model), "rows binary, label double, expected double").collect()
    lengths = np.array([len(r.rows) // 4 for r in rows], np.int64)
    held = np.frombuffer(b"".join(bytes(r.rows) for r in rows), np.int32)
    expected = np.clip([r.expected for r in rows], low, 1 - low)
    shared = spark.sparkContext.broadcast((lengths, held, np.array([r.label > 0.5 for r in rows], float), expected))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[int] = set()
        pairs = None
        for b in it:
            pairs = pairs or Pairs(*shared.value, len(terms))
            for block in b.column("id").to_pylist():
                for first in range(block, len(terms), blocks):
                    partners = pairs.marked(first, s.least_pair_ratio)
                    if len(partners):
                        found |= {first, *partners.tolist()}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["at"])

    marked = spark.range(blocks, numPartitions=blocks).mapInArrow(run, "at bigint").distinct().collect()
    shared.unpersist()
    return [int(terms[r.at]) for r in marked]


class Pairs:
    """Counts of pairs of terms over documents: each one's terms, its label and what is expected of it."""

    def __init__(self, lengths: np.ndarray, held: np.ndarray, label: np.ndarray, expected: np.ndarray, terms: int, slice_of: int = 1 << 20):
        self.ends, self.held, self.label, self.expected, self.terms, self.slice_of = np.cumsum(lengths), held, label, expected, terms, slice_of
        self.begins = self.ends - lengths
        self.order = held.argsort(kind="stable").astype(np.int64)  # places by term
        self.doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.first = np.searchsorted(held[self.order], np.arange(terms + 1))

    def marked(self, term: int, ratio: float) -> np.ndarray:
        """Later terms whose pair with `term` reaches the ratio; a document's terms are sorted, so later ones follow its place."""
        places = self.order[self.first[term] : self.first[term + 1]]
        docs = self.doc[places]
        rest = self.ends[docs] - places - 1
        both, positive, expected = np.zeros(self.terms, np.int64), np.zeros(self.terms), np.zeros(self.terms)
        before = np.cumsum(rest)
        for part in np.split(np.arange(len(docs)), np.searchsorted(before, np.arange(self.slice_of, int(before[-1]) if len(before) else 0, self.slice_of))):
            n = rest[part]
            if not n.sum():
                continue
            at = np.repeat(places[part] + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
            other, of = self.held[at], np.repeat(docs[part], n)
            both += np.bincount(other, minlength=self.terms)
            positive += np.bincount(other, weights=self.label[of], minlength=self.terms)
            expected += np.bincount(other, weights=self.expected[of], minlength=self.terms)
        some = np.flatnonzero(both)
        return some[pair_ratio(both[some], positive[some], expected[some]) >= ratio]


def _pair_rows(held: Model, model: Model):
    """rows, label and expected: each document's terms among those of `held`, packed, and what `model` says of it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = _Rows(held), _Rows(model)
        for b in it:
            texts = b.column("text").to_pylist()
            packed = [own.of(t).astype(np.int32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), b.column("label"), pa.array([known.score(t) for t in texts], pa.float64())], ["rows", "label", "expected"])

    return run


def gradient(parameters: np.ndarray, docs: list[np.ndarray], y: np.ndarray, penalty: float) -> np.ndarray:
    """Of the mean log loss of some documents plus half the penalty times the squares of all but the bias.

    A parameter row is a term's weight and vector; the last row holds the bias.
    """
    size, k = len(parameters) - 1, parameters.shape[1] - 1
    feature = np.concatenate(docs)
    of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    p = parameters[feature]
    sums = np.stack([np.bincount(of, weights=p[:, j], minlength=len(docs)) for j in range(k + 1)], 1)
    own = np.bincount(of, weights=(p[:, 1:] ** 2).sum(1), minlength=len(docs))
    z = parameters[-1, 0] + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - own)
    error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(docs)
    each = error[of]
    grad = penalty * parameters
    grad[-1] = [error.sum(), *[0.0] * k]
    grad[:-1, 0] += np.bincount(feature, weights=each, minlength=size)
    for j in range(1, k + 1):
        grad[:-1, j] += np.bincount(feature, weights=each * (sums[of, j] - p[:, j]), minlength=size)
    return grad


def _learn(model: Model, docs: list[np.ndarray], y: np.ndarray) -> Model:
    """Adam over batches of documents; docs: rows of the model that each document holds."""
    s, k, size = model.settings, model.settings.factors, len(model.terms)
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(docs))
    parameters = np.concatenate([np.zeros((size, 1)), rng.normal(0, 0.02, (size, k))], 1)
    # The last row holds the bias.
    parameters = np.vstack([parameters, [[model.bias, *[0.0] * k]]])
    mean, square, step = np.zeros_like(parameters), np.zeros_like(parameters), 0
    for _ in range(s.epochs):
        for first in range(0, len(docs), s.batch):
            chosen = order[first : first + s.batch]
            grad = gradient(parameters, [docs[i] for i in chosen], y[chosen], s.penalty)
            step += 1
            mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
            parameters = parameters - s.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(model.terms, float(parameters[-1, 0]), parameters[:-1, 0].copy(), parameters[:-1, 1:].copy(), s)


class _Rows(dict):
    """word -> the rows of its terms in the model; remembered for a bounded number of words."""

    def __init__(self, model: Model, limit: int = 300_000):
        self.model, self.limit = model, limit
        self.place = {int(t): i for i, t in enumerate(model.terms)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        at = map(self.place.get, terms_of(word, self.model.settings.buckets))
        found = self[word] = tuple(i for i in at if i is not None)
        return found

    def of(self, text: bytes) -> np.ndarray:
        return np.array(sorted({r for w in words_of(text) for r in self[w]}), np.int64)

    def score(self, text: bytes) -> float:
        return self.model.score(self.of(text))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 where score reaches the threshold) of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(model)
        for b in it:
            scores = [rows.score(text) for text in b.column("text").to_pylist()]
            predicted = pa.array([int(x >= model.settings.threshold) for x in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), predicted], ["doc_id", "score", "predicted"])

    rows = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that the model doesn't reject."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(model)
        for b in it:
            keep = [rows.score(text or b"") < model.settings.threshold for text in b.column("text").cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
