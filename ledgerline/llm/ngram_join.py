"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of hashed word shingles; two link when 100 * intersection >= percent * union. Equal
sets are one class and are handled once.

Prefixes. Shingles are ordered by hash. Of linked sets with sizes a and b, overlap at least
o = ceil(percent * (a+b) / (100+percent)), the prefixes of p + l - 1 shingles (p = a - ceil(percent*a/100)
+ 1) share l shingles or more, for every l. A shingle in more than `light` prefixes is heavy: its list of
documents costs too many candidates and is never paired. Linked sets share h + 1 shingles of prefixes
longer by h, so with h heavy ones at most, one of them is light. Which shingles are heavy isn't known when
prefixes are written: each gets the same room for its size, `extra(a)` more shingles. In lists of light
shingles one shared shingle makes a candidate pair; the number shared is counted, and the requirement is
applied as a bound (see Filter). Sets with more heavy shingles than the room are dense.

Filter. Both prefixes cover all hashes up to the smaller one's last, so shared light shingles, plus
the fewer heavy ones, plus what that set has beyond bound the overlap. Pairs below o are dropped.

Dense documents have more heavy shingles than the room allows: large groups of near copies. Among
themselves only, they are joined on their whole sets, with heaviness counted anew: pairs that share a
light shingle as above, and pairs that share heavy ones only by prefixes of their differences from a pivot,
whose length and number of shared elements follow from the estimated cost of candidates (dense_join.py).

Candidates are verified on whole sets; components follow from the links. No list, group or pair set
is held by one task: lists are streamed in sorted order and a list that is heavy inside one batch is
sent as a single mark.

Shingle identity is a 64-bit hash; class identity 128 bits. Defined results: a text with fewer words
than a shingle is one shingle of them all; null, empty and blank texts have no shingles and are their
own component; a component's id is its smallest id that isn't null, or null if all are; rows with the
same id are judged each; extra columns are not read by `join` and come back unchanged from `keep_one`,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dense_join
from .common import WordHashes, batches, gram_hashes, materialize, temporary, unused, utf8
from .components import components
from .jaccard import Rule, verified

SMALL_BYTES = 8 << 20  #: of 8-byte place hashes that may be broadcast


def shingles(text: bytes, n: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a text, sorted, as signed numbers."""
    words = hashes.of(text.lower().split())
    return np.unique(gram_hashes(words, min(n, len(words)) or 1).view(np.int64))


def _sets(rule: Rule, whole: bool):
    """doc_id, place, n, key and the first shingles of each row, or all of them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches(it):
            sizes, keys, kept = [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, rule.words, hashes)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                kept.append(s if whole else s[: rule.window(len(s))])
            ends = np.cumsum([0, *map(len, kept)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*kept, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("place"), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), lists], ["doc_id", "place", "n", "key", "shingles"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """place is a hash of the text: with the id it finds the row of a class again."""
    return docs.select("doc_id", F.xxhash64(utf8(F.col("text"))).alias("place"), utf8(F.col("text")).alias("text"))


def _set_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, place bigint, n int, key binary, shingles array<bigint>"


def _postings(light: int):
    """shingle, node, n: a row per shingle of a set; node -1 marks one that is heavy in one batch alone."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 16 << 20):
            lists = b.column("shingles")
            flat, counts = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            node, n = (np.repeat(b.column(c).to_numpy(), counts) for c in ("node", "n"))
            order = np.argsort(flat, kind="stable")
            flat, node, n = flat[order], node[order], n[order]
            starts, runs = _runs(flat)
            keep, marks = np.repeat(runs <= light, runs), flat[starts[runs > light]]
            columns = (np.concatenate([flat[keep], marks]), np.concatenate([node[keep], np.full(len(marks), -1)]).astype(np.int64), np.concatenate([n[keep], np.zeros(len(marks))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "node", "n"])

    return run


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and how long they are."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(values)]])).astype(np.int64)


def _pair_lists(rule: Rule):
    """Streams sorted postings: pairs a, b of each light list whose sizes allow a link, or the heavy shingle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = tuple(np.empty(0, np.int64) for _ in range(3))
        for b in it:
            now = tuple(np.concatenate([r, b.column(c).to_numpy().astype(np.int64)]) for r, c in zip(rest, ("shingle", "node", "n")))
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last list may go on
            yield pairs(*(x[:cut] for x in now))
            rest = tuple(x[cut : cut + rule.light + 1] for x in now)  # more rows of it say no more
        yield pairs(*rest)

    def pairs(shingle, node, n):
        starts, runs = _runs(shingle)
        heavy = (runs > rule.light) | (node[starts] < 0)
        light = np.repeat(~heavy, runs)
        group = np.repeat(np.arange(len(runs)), runs)[light]
        node, n = node[light], n[light]
        lefts, rights = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for gap in range(1, int(runs[~heavy].max(initial=1))):
            small, large = np.minimum(n[gap:], n[:-gap]), np.maximum(n[gap:], n[:-gap])
            linked = (group[gap:] == group[:-gap]) & (100 * small >= rule.percent * large)
            lefts.append(np.minimum(node[gap:], node[:-gap])[linked])
            rights.append(np.maximum(node[gap:], node[:-gap])[linked])
        a, b, h = np.concatenate(lefts), np.concatenate(rights), shingle[starts[heavy]]
        is_pair = np.arange(len(a) + len(h)) < len(a)
        fill_a, fill_h = np.zeros(len(a), np.int64), np.zeros(len(h), np.int64)
        columns = ((np.concatenate([fill_a, h]), is_pair), (np.concatenate([a, fill_h]), ~is_pair), (np.concatenate([b, fill_h]), ~is_pair))
        return pa.RecordBatch.from_arrays([pa.array(v, mask=m) for v, m in columns], ["heavy", "a", "b"])

    return run


def _paired(sets: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Of sets node, n, shingles: pairs a, b, shared; node, shingle of each heavy shingle."""
    postings = sets.mapInArrow(_postings(rule.light), "shingle bigint, node bigint, n int")
    listed = postings.repartition("shingle").sortWithinPartitions("shingle", "node")
    found = materialize(listed.mapInArrow(_pair_lists(rule), "heavy bigint, a bigint, b bigint"), "lists")
    heavy = found.where("heavy is not null").select(F.col("heavy").alias("shingle"))
    pairs = found.where("a is not null and a != b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return pairs, sets.select("node", F.explode("shingles").alias("shingle")).join(heavy, "shingle")


def _with_heavy(facts: DataFrame, counts: DataFrame) -> DataFrame:
    return facts.join(counts, "node", "left").withColumn("n_heavy", F.coalesce("n_heavy", F.lit(0)))


def _bounded(pairs: DataFrame, facts: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose overlap can reach what a link needs; facts: node, n, w (in the prefix), last, n_heavy."""
    left, right = (facts.select(*[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "w", "last", "n_heavy")]) for side in "ab")
    known = pairs.join(left, pairs.a == left.node_a).join(right, pairs.b == right.node_b)
    beyond = F.when(F.col("last_a") <= F.col("last_b"), F.col("n_a") - F.col("w_a")).otherwise(F.col("n_b") - F.col("w_b"))
    most = F.col("shared") + F.least("n_heavy_a", "n_heavy_b") + beyond
    return known.where(most >= rule.overlap(F.col("n_a"), F.col("n_b"))).select("a", "b")


def _dense_links(sets: DataFrame, rule: Rule) -> DataFrame:
    """Links a, b among dense documents, enough of them for the components."""
    pairs, held = _paired(sets, rule)
    held = materialize(held, "dense-heavy")
    counts = held.groupBy("node").agg(F.count("*").alias("n_heavy"))
    facts = sets.select("node", "n", F.col("n").alias("w"), F.lit(0).alias("last"))
    near = _bounded(pairs, _with_heavy(facts, counts), rule)
    known = materialize(verified(near, sets, rule), "dense-links")
    return dense_join.links(sets, held, known, rule)


def classes(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Rows doc_id, n, key; and of each distinct set node, key, n, first_id, place, shingles (its prefix)."""
    rows = materialize(_rows(docs).mapInArrow(_sets(rule, False), _set_schema(docs)), "shingles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place"))
    found = rows.where("n > 0").groupBy("key").agg(first.alias("f"), F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    found = found.select(F.monotonically_increasing_id().alias("node"), "key", "n", F.col("f.doc_id").alias("first_id"), F.col("f.place").alias("place"), "shingles")
    return rows, materialize(found, "classes")


def _whole_sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """node, n, shingles (all) of wanted classes (node, key, place), from texts with their place, each text once."""
    wanted = materialize(wanted, "wanted")
    places = wanted.select("place").distinct()
    small = 8 * places.count() <= SMALL_BYTES
    rows = _rows(docs).withColumn("second", F.xxhash64(F.lit("second"), "text"))
    rows = rows.join(F.broadcast(places) if small else places, "place", "left_semi")
    sets = rows.dropDuplicates(["place", "second"]).mapInArrow(_sets(rule, True), _set_schema(docs))
    return materialize(sets.select("key", "n", "shingles").join(wanted.select("node", "key"), "key").select("node", "n", "shingles"), "sets")


def links(docs: DataFrame, found: DataFrame, rule: Rule) -> DataFrame:
    """Links a, b between the classes' nodes: all that aren't implied by others' components."""
    pairs, held = _paired(found.select("node", "n", "shingles"), rule)
    counts = held.groupBy("node").agg(F.count("*").alias("n_heavy"))
    facts = found.select("node", "n", F.size("shingles").alias("w"), F.element_at("shingles", -1).alias("last"))
    facts = materialize(_with_heavy(facts, counts), "facts")
    near = materialize(_bounded(pairs, facts, rule), "near")
    partner = F.ceil(rule.percent * F.col("n") / F.lit(100) - 1e-9)
    room = F.least(F.ceil(rule.percent * partner / F.lit(100) - 1e-9) - 1, F.floor(partner / 10) + 8)
    dense = facts.where(F.col("n_heavy") > room).select("node").withColumn("dense", F.lit(True))
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(dense, "node", "full")
    wanted = found.select("node", "key", "place").join(ends, "node")
    sets = _whole_sets(docs, wanted.select("node", "key", "place"), rule)
    some = verified(near, sets, rule)
    dense_sets = materialize(sets.join(dense.select("node"), "node"), "dense-sets")
    return some if dense_sets.isEmpty() else some.union(_dense_links(dense_sets, rule))


def join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, found = classes(docs, rule)
    with temporary(docs.sparkSession) as keep:
        label = keep(components(links(docs, found, rule)))
    named = found.select("node", "key", "first_id").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_key = named.join(least, "component").select("key", "component_id", F.lit(True).alias("known"))
    full = rows.where("n > 0").select("doc_id", "n", "key").join(of_key, "key", "left")
    joined = full.select("doc_id", "n", "component_id", "known").union(
        rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("known")))
    return joined.select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule) -> DataFrame:
    """docs without near copies: of each component the row with the smallest id, all columns.

    A null id comes last. Rows with the same id and text are copies too. Texts without shingles stay.
    """
    rows, found = classes(docs, rule)
    with temporary(docs.sparkSession) as keep:
        label = keep(components(links(docs, found, rule)))
    named = found.select("node", "key", "first_id", "place").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = named.groupBy("component").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("place").alias("at"))).alias("best"))
    winners = named.join(best, "component").select("key", "best.id", "best.at")
    id_hash = F.xxhash64("doc_id", F.col("doc_id").isNull())
    wins = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("place") == F.col("at"))
    judged = rows.where("n > 0").join(winners, "key").select(F.struct(id_hash.alias("id"), F.col("place").alias("at")).alias("row"), wins.alias("wins"))
    judged = materialize(judged, "judged")
    here, nth = unused(docs, "row"), unused(docs, "nth")
    marked = docs.withColumn(here, F.struct(id_hash.alias("id"), F.xxhash64(utf8(F.col("text"))).alias("at")))
    losers = judged.where("not wins").select(F.col("row").alias(here)).distinct()
    twice = judged.where("wins").groupBy(F.col("row").alias(here)).agg(F.count("*").alias("n")).where("n > 1").select(here)
    twice = materialize(twice, "twice")
    kept = marked.join(losers, here, "left_anti")
    if not twice.isEmpty():
        order = Window.partitionBy(here).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
        again = kept.join(twice, here, "left_semi").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
        kept = kept.join(twice, here, "left_anti").union(again)
    return kept.select([F.col(f"`{c}`") for c in docs.columns])
