"""Substring deduplication by super-k-mer partitioning.

A window is `words` consecutive words of a text (35). Its minimiser is the least hash of its GRAM-word
runs. Consecutive windows with one minimiser form a super-k-mer, which travels as one packed string to
the minimiser's bucket; equal windows have equal minimisers and meet there. In the bucket the windows
are cut out and sorted, and a window that starts in two places or more is repeated. Every word that a
repeated window covers is removed.

What needn't travel stays: equal texts count as one text with copies (their windows are all repeated),
and a first pass sends only minimisers and places, since a super-k-mer whose minimiser occurs nowhere
else has no repeated window. Minimisers with more than HOT super-k-mers have their windows sent one by
one, dealt by the window's own digest, so no bucket holds a common passage's neighbourhoods. That is
decided once for a minimiser, by its total, since equal windows meet only if they travel alike.

Both shuffles are combined on the way out: rows with one key inside a batch are settled there and only
a mark is sent, so a key gets at most a row from each batch, however frequent it is. A hot minimiser's
marks go back to the rows settled in their batches, by minimiser and batch.

Text and window identity are 128-bit hashes. Defined results: a null text has no words; texts shorter
than a window keep all words; the same window twice in one text is repeated; repeated rows are copies;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batches, gram_hashes, materialize, utf8, window_min

GRAM = 8
HOT = 64
#: Kinds of rows: settled in their batch, a mark of that, and open.
SETTLED, MARK, OPEN = 0, 1, 2


def super_kmers(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """minimiser, first window, number of windows, and whether its minimiser recurs in the text."""
    grams = gram_hashes(hashes, min(GRAM, words)).view(np.int64)
    least = window_min(grams, words - min(GRAM, words) + 1)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    minimisers = least[starts]
    values, counts = np.unique(grams, return_counts=True)
    recurs = np.isin(minimisers, values[counts > 1]) if len(values) < len(grams) else np.zeros(len(starts), bool)
    return minimisers, starts, np.diff(np.concatenate([starts, [len(least)]])), recurs


def _settle(key: np.ndarray, always: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's rows: each row's kind, the number of rows with its key, and a row of each key to be marked."""
    values, first, back, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    several = counts > 1
    several[back[always]] = True
    return np.where(several[back], SETTLED, OPEN).astype(np.int32), counts[back], first[several]


def _keyed(docs: DataFrame) -> DataFrame:
    text = utf8(F.col("text"))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"))


def _places(words: int):
    """route, kind, minimiser, batch, k1, k2, doc_id, start, n, count: the super-k-mers of texts, each text once a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for number, b in enumerate(batches(it, 16 << 20), TaskContext.get().partitionId() << 32):
            row, parts = [], []
            for i, (text, k1, k2) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "k1", "k2")))):
                if (k1, k2) in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add((k1, k2))
                tokens = text.split()
                if len(tokens) >= words:
                    parts.append(super_kmers(hashes.of(tokens), words))
                    row.append(i)
            if not parts:
                continue
            minimiser, start, n, recurs = (np.concatenate(x) for x in zip(*parts))
            row = np.repeat(row, [len(p[0]) for p in parts])
            kind, count, marks = _settle(minimiser, recurs)
            at = np.concatenate([np.arange(len(row)), marks])
            kind = np.concatenate([kind, np.full(len(marks), MARK, np.int32)])
            taken = b.select(["k1", "k2", "doc_id"]).take(pa.array(row[at]))
            k1 = taken.column("k1").to_numpy()
            route = np.where(kind == SETTLED, k1 ^ start[at], minimiser[at])
            narrow = (x[at].astype(np.int32) for x in (start, n, count))
            columns = (route, kind, minimiser[at], np.full(len(at), number), k1, taken.column("k2").to_numpy(), taken.column("doc_id"), *narrow)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["route", "kind", "minimiser", "batch", "k1", "k2", "doc_id", "start", "n", "count"])

    return run


def _whole_keys(it: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of sorted rows, none of which splits a key: a batch's last key waits for the next batch."""
    rest = None
    for b in it:
        t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
        if t.num_rows:
            values = t.column(key).to_numpy()
            cut = int(np.argmax(values == values[-1]))
            if cut:
                yield t.slice(0, cut)
            rest = t.slice(cut)
    if rest is not None:
        yield rest


def _judge(keys: list[np.ndarray], kind: np.ndarray, places: list[np.ndarray], count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows, sorted by keys, kind and places, have a key with two places or a mark; and the key's
    frequency, which settled rows do not add to: it is known only where a key's marks and open rows are.

    A place counts and stays once for each kind.
    """

    def changes(columns):
        new = np.zeros(len(kind), bool)
        new[:1] = True
        for v in columns:
            new[1:] |= v[1:] != v[:-1]
        return new

    group = np.cumsum(changes(keys)) - 1
    new = changes([*keys, kind, *places])
    weight = np.where(kind == MARK, np.maximum(count, 2), (new & (kind == OPEN)).astype(np.int64))
    total = np.bincount(group, weights=weight).astype(np.int64)[group] if len(kind) else count
    return new & ((kind == SETTLED) | ((kind == OPEN) & (total > 1))), total


def _shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of super-k-mers sorted by minimiser, kind and place: those whose minimiser has two places, with
    hot, which settled ones don't know yet; and the marks of hot minimisers."""
    for t in _whole_keys(it, "minimiser"):
        c = {n: t.column(n).to_numpy() for n in ("minimiser", "kind", "k1", "k2", "start", "count")}
        keep, total = _judge([c["minimiser"]], c["kind"], [c["k1"], c["k2"], c["start"]], c["count"])
        hot = (c["kind"] != SETTLED) & (total > HOT)
        t = t.append_column("hot", pa.array(hot)).filter(pa.array(keep | (hot & (c["kind"] == MARK))))
        yield from t.select(["kind", "minimiser", "batch", "k1", "k2", "doc_id", "start", "n", "hot"]).to_batches()


def _window_rows(rows: list[tuple[int, int, list[bytes]]], words: int) -> tuple[np.ndarray, ...]:
    """d1, d2, text, start of every window of the runs given as (text, first start, words)."""
    digests, text, start = [], [], []
    for t, first, tokens in rows:
        for i in range(len(tokens) - words + 1):
            digests.append(xxhash.xxh3_128_digest(b" ".join(tokens[i : i + words])))
            text.append(t)
            start.append(first + i)
    d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return d[:, 0], d[:, 1], np.array(text, np.int64), np.array(start, np.int32)


_CUT = "route bigint, kind int, packed binary, d1 bigint, d2 bigint, text_no bigint, start int, count int"
_CUT_ARROW = pa.schema([
    ("route", pa.int64()), ("kind", pa.int32()), ("packed", pa.binary()), ("d1", pa.int64()), ("d2", pa.int64()),
    ("text_no", pa.int64()), ("start", pa.int32()), ("count", pa.int32()),
])


def _cut(words: int):
    """Packed strings of the super-k-mers listed with each text; windows one by one where they are hot."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # rows that repeat a text
        for b in batches(it, 4 << 20):
            packed, hot = [], []
            for number, text, found in zip(*(b.column(c).to_pylist() for c in ("text_no", "text", "found"))):
                if number in done:
                    continue
                done.add(number)
                tokens = text.split()
                for x in {x["start"]: x for x in found}.values():
                    run_ = tokens[x["start"] : x["start"] + x["n"] + words - 1]
                    if x["hot"]:
                        hot.append((number, x["start"], run_))
                    else:
                        packed.append((x["minimiser"], number, x["start"], b" ".join(run_)))
            if packed:
                m, number, start, strings = zip(*packed)
                zero = pa.array(np.zeros(len(m), np.int64))
                kind, count = pa.array(np.full(len(m), OPEN, np.int32)), pa.array(np.ones(len(m), np.int32))
                columns = [pa.array(m, pa.int64()), kind, pa.array(strings, pa.binary()), zero, zero, pa.array(number, pa.int64()), pa.array(start, pa.int32()), count]
                yield pa.RecordBatch.from_arrays(columns, schema=_CUT_ARROW)
            if hot:
                d1, d2, number, start = _window_rows(hot, words)
                kind, count, marks = _settle(d1, np.zeros(len(d1), bool))
                # Settled by half of the digest: make sure that both halves agree, else leave all open.
                order = np.lexsort((d2, d1))
                clash = set(d1[order][1:][(d1[order][1:] == d1[order][:-1]) & (d2[order][1:] != d2[order][:-1])].tolist())
                if clash:
                    bad = np.isin(d1, list(clash))
                    kind[bad] = OPEN
                    marks = marks[~bad[marks]]
                at = np.concatenate([np.arange(len(d1)), marks])
                kind = np.concatenate([kind, np.full(len(marks), MARK, np.int32)])
                route = np.where(kind == SETTLED, number[at] * 31 + start[at], d1[at])
                columns = (route, kind, d1[at], d2[at], number[at], start[at], count[at].astype(np.int32))
                arrays = [pa.array(c) for c in columns]
                arrays.insert(2, pa.nulls(len(at), pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, schema=_CUT_ARROW)

    return run


def _repeated_windows(words: int):
    """Of buckets in their order: cuts out the packed windows, sorts all, and gives text_no, start of repeated ones.

    A bucket has few rows from each batch (see the top), so it is sorted in memory.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_keys(it, "route"):
            packed = t.column("packed")
            own, single = t.filter(packed.is_valid()), t.filter(packed.is_null())
            rows = [(n, s, p.split(b" ")) for n, s, p in zip(*(own.column(c).to_pylist() for c in ("text_no", "start", "packed")))]
            cut = _window_rows(rows, words)
            kind = np.concatenate([single.column("kind").to_numpy(), np.full(len(cut[0]), OPEN, np.int32)])
            count = np.concatenate([single.column("count").to_numpy(), np.ones(len(cut[0]), np.int32)])
            d1, d2, number, start = (np.concatenate([single.column(c).to_numpy(), x]) for c, x in zip(("d1", "d2", "text_no", "start"), cut))
            order = np.lexsort((start, number, kind, d2, d1))
            d1, d2, number, start, kind, count = (x[order] for x in (d1, d2, number, start, kind, count))
            keep, _ = _judge([d1, d2], kind, [number, start], count)
            yield pa.RecordBatch.from_arrays([pa.array(number[keep]), pa.array(start[keep].astype(np.int32))], ["text_no", "start"])

    return run


def covered(n: int, starts: list[int], words: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of the starts."""
    steps = np.zeros(n + 1, np.int64)
    at = np.unique(np.array(starts, np.int64))
    steps[at] += 1
    steps[at + words] -= 1
    return np.cumsum(steps[:n]) > 0


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def repeated(docs: DataFrame, words: int = 35) -> tuple[DataFrame, DataFrame]:
    """text_no, k1, k2, text of texts that may have repeated windows; and text_no, starts of those windows."""
    rows = _keyed(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    places = rows.mapInArrow(_places(words), f"route bigint, kind int, minimiser bigint, batch bigint, k1 bigint, k2 bigint, doc_id {kind}, start int, n int, count int")
    sorted_places = places.repartition("route").drop("route").sortWithinPartitions("minimiser", "kind", "k1", "k2", "start")
    shared = sorted_places.mapInArrow(_shared, f"kind int, minimiser bigint, batch bigint, k1 bigint, k2 bigint, doc_id {kind}, start int, n int, hot boolean")
    shared = materialize(shared, "shared")
    marks = materialize(shared.where(F.col("kind") == MARK).select("minimiser", "batch", F.lit(True).alias("marked")), "hot-minimisers")
    settled = shared.where(F.col("kind") == SETTLED).join(marks, ["minimiser", "batch"], "left").withColumn("hot", F.col("marked").isNotNull())
    columns = ["k1", "k2", "doc_id", "start", "n", "minimiser", "hot"]
    known = shared.where(F.col("kind") == OPEN).select(columns).union(settled.select(columns))
    lists = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("one"), F.collect_list(F.struct("start", "n", "minimiser", "hot")).alias("found"))
    found = materialize(lists.withColumn("text_no", F.monotonically_increasing_id()), "super-kmers")
    texts = rows.join(found, ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("one"))).select("text_no", "k1", "k2", "text", "found")
    texts = materialize(texts, "super-kmer-texts")
    cut = texts.select("text_no", "text", "found").mapInArrow(_cut(words), _CUT)
    starts = cut.repartition("route").sortWithinPartitions("route").mapInArrow(_repeated_windows(words), "text_no bigint, start int")
    return texts.select("text_no", "k1", "k2", "text"), starts.groupBy("text_no").agg(F.collect_set("start").alias("starts"))


def deduplicate(docs: DataFrame, words: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, one space between them) of every row."""
    rows = _keyed(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            tokens = [t.split() for t in b.column("text").to_pylist()]
            columns = [*(b.column(c) for c in ("doc_id", "k1", "k2")), pa.array([len(t) for t in tokens], pa.int64()), pa.array([_sha(t) for t in tokens], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "n_words", "sha"])

    plain = materialize(rows.mapInArrow(count, f"doc_id {kind}, k1 bigint, k2 bigint, n_words bigint, sha string"), "words")
    texts, starts = repeated(docs, words)

    def edit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            removed, shas = [], []
            for text, at in zip(b.column("text").to_pylist(), b.column("starts").to_pylist()):
                tokens = text.split()
                gone = covered(len(tokens), at, words)
                removed.append(int(gone.sum()))
                shas.append(_sha([t for t, g in zip(tokens, gone) if not g]))
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["k1", "k2", "cut", "cut_sha"])

    edited = texts.join(starts, "text_no").select("k1", "k2", "text", "starts").mapInArrow(edit, "k1 bigint, k2 bigint, cut bigint, cut_sha string").dropDuplicates(["k1", "k2"])
    copies = plain.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("k1", "k2", F.lit(True).alias("copied"))
    whole = F.coalesce("copied", F.lit(False)) & (F.col("n_words") >= words)
    joined = plain.join(edited.join(copies, ["k1", "k2"], "full"), ["k1", "k2"], "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, F.lit(_sha([]))).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
