"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Of every WIDTH
consecutive GRAM-word hashes of a text the least is kept as a fingerprint. Two texts that share
WIDTH + GRAM - 1 = 13 consecutive words share all hashes of that span and so its least one: no
shared window is missed. A document's fingerprints are joined to the items' and every match is
extended to both sides as far as windows with the fingerprint reach; runs of 13 words or more are hits. Occurrences with the same words
around them, as in a phrase that many items share, are extended once, and all others of a fingerprint in one step. An item
of fewer words is one window; those are found by the hashes of all runs of their lengths.

Items whose text is small (`most_bytes`, checked first) travel as a broadcast of sorted arrays and one
pass over the documents does all, without a shuffle. Larger sets take `_by_join`: fingerprints travel with
the hashes of the windows that they stand for; those that no item has go first, and then the windows are
joined. So a phrase that is common in documents and items meets no pairs, only equal windows, and no text
is moved. Both ways give the same rows.

Words are compared by 64-bit hashes, windows by two of them.

Defined results: a null text has no words; an item without words has no windows; rows of equal text
have equal results; items of equal or null id count once per distinct id, a null one as ''; without items
nothing is hit; extra columns are not read by `decontaminate` and come back unchanged from `keep_clean`,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batches, gram_hashes, materialize, unused, utf8, window_min

WINDOW, GRAM = 13, 5
WIDTH = WINDOW - GRAM + 1
#: Places, from that of a fingerprint, of the words of all windows that hold it.
NEAR = np.arange(GRAM - WINDOW, WINDOW)
CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"
_LETTERS = bytes((c + 32 if 65 <= c < 91 else c) if 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def fingerprints(words: np.ndarray) -> np.ndarray:
    """The distinct kept hashes of a text of 13 words or more, given its words' hashes."""
    grams = gram_hashes(words, GRAM)
    return np.unique(window_min(grams, WIDTH)) if len(grams) >= WIDTH else np.empty(0, np.uint64)


class Items:
    """The items' fingerprints and words as sorted arrays, as they are broadcast."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        hashes = WordHashes()
        self.ids = [i for i, _ in rows]
        words = [hashes.of(words_of(t)) for _, t in rows]
        self.ends = np.cumsum([0, *map(len, words)])
        self.words = np.concatenate([*words, np.empty(0, np.uint64)])
        prints, items, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        short: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, h in enumerate(words):
            if len(h) >= WINDOW:
                grams = gram_hashes(h, GRAM)
                at = np.flatnonzero(np.isin(grams, fingerprints(h)))
                prints.append(grams[at])
                items.append(np.full(len(at), k))
                places.append(at)
            elif len(h):
                short[len(h)].append((int(gram_hashes(h, len(h))[0]), k))
        self._group(np.concatenate(prints), np.concatenate(items), np.concatenate(places))
        self.short = {}
        for n, found in short.items():
            found.sort()
            self.short[n] = np.array([h for h, _ in found], np.uint64), np.array([k for _, k in found])

    def _group(self, prints: np.ndarray, items: np.ndarray, places: np.ndarray) -> None:
        """Sorts occurrences of fingerprints into classes with the same words around them; a class is extended once.

        Class c, of fingerprint prints[c], has the items holders[begins[c]:begins[c + 1]], and stands at place[c] of item[c].
        """
        near = [np.empty((0, 2), np.uint64)]
        for i in range(0, len(prints), 1 << 16):
            words, inside = self._around(items[i : i + (1 << 16)], places[i : i + (1 << 16)])
            words = np.where(inside, words, np.uint64(len(NEAR)))
            near.append(np.stack([gram_hashes(np.ascontiguousarray(w.T), len(NEAR))[0] for w in (words, words ^ np.uint64(0x9E3779B97F4A7C15))], 1))
        one, other = np.concatenate(near).T
        order = np.lexsort((items, other, one, prints))
        prints, items, places, one, other = prints[order], items[order], places[order], one[order], other[order]
        new = np.ones(len(prints), bool)
        new[1:] = (prints[1:] != prints[:-1]) | (one[1:] != one[:-1]) | (other[1:] != other[:-1])
        first = np.flatnonzero(new)
        self.prints, self.item, self.place = prints[first], items[first], places[first]
        self.holders, self.begins = items, np.append(first, len(items))
        self.keys = np.unique(prints)

    def _around(self, items: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words around places of items, and which of them are inside the item."""
        at = self.ends[items][:, None] + places[:, None] + NEAR
        inside = (at >= self.ends[items][:, None]) & (at < self.ends[items + 1][:, None])
        return self.words[np.where(inside, at, 0)], inside

    def of(self, k: int) -> np.ndarray:
        return self.words[self.ends[k] : self.ends[k + 1]]

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words, given by their hashes, are hit, and the items with a window that occurs."""
        hit, items = np.zeros(len(words), bool), set()
        if len(words) >= WINDOW and len(self.keys):
            grams = gram_hashes(words, GRAM)
            kept = np.unique(window_min(grams, WIDTH))
            shared = kept[_among(kept, self.keys)]
            met: set[int] = set()
            for p in np.flatnonzero(_among(grams, shared)).tolist():
                classes, start, end = self._extended(words, p, grams[p])
                if len(classes):
                    hit[start:end] = True
                    met.update(classes.tolist())
            for c in met:
                items.update(self.holders[self.begins[c] : self.begins[c + 1]].tolist())
        for n, (keys, of) in self.short.items():
            grams = gram_hashes(words, n)
            for p in np.flatnonzero(_among(grams, keys)).tolist():
                for k in of[np.searchsorted(keys, grams[p]) : np.searchsorted(keys, grams[p], "right")].tolist():
                    if (self.of(k) == words[p : p + n]).all():
                        hit[p : p + n] = True
                        items.add(k)
        return hit, items

    def _extended(self, words: np.ndarray, p: int, gram: np.uint64) -> tuple[np.ndarray, int, int]:
        """Classes of a fingerprint at word p that share a window with the text around it, and which words these windows cover.

        All windows with the fingerprint are within NEAR; others have a fingerprint of their own. The extension goes
        to both sides of all classes at once. Of two classes the words that are covered are next to p, so a range holds them.
        """
        some = np.arange(np.searchsorted(self.prints, gram), np.searchsorted(self.prints, gram, "right"))
        near, inside = self._around(self.item[some], self.place[some])
        at = p + NEAR
        equal = inside & ((at >= 0) & (at < len(words))) & (near == words[np.clip(at, 0, len(words) - 1)])
        left = np.logical_and.accumulate(equal[:, : -NEAR[0]][:, ::-1], 1).sum(1)
        right = np.logical_and.accumulate(equal[:, -NEAR[0] :], 1).sum(1)
        long = (left + right >= WINDOW) & (right >= GRAM)
        if not long.any():
            return some[:0], p, p
        return some[long], p - int(left[long].max()), p + int(right[long].max())


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return keys[at] == values


_RESULT = "doc_id {0}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string"


def _digest(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs.

    contaminated: at least one word and a twentieth of all words are hit.
    """
    items = _items(benchmark)
    found = _by_broadcast(docs, items) if _size(items) <= most_bytes else _by_join(docs, items)
    return found.withColumn("contaminated", F.expr(CONTAMINATED))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), utf8(F.col("text")).alias("words"))


def _size(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("words") + 64)).first()[0] or 0


def keep_clean(docs: DataFrame, benchmark: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs, all columns, that aren't contaminated."""
    items = _items(benchmark)
    if _size(items) > most_bytes:
        key = F.unhex(F.md5(utf8(F.col("text"))))
        name = unused(docs, "key")
        judged = _by_join(docs.select(key.alias("doc_id"), "text"), items)
        bad = judged.where(CONTAMINATED).select(F.col("doc_id").alias(name)).distinct()
        return docs.withColumn(name, key).join(bad, name, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
    known = docs.sparkSession.sparkContext.broadcast(Items([(r[0], bytes(r[1])) for r in items.collect()]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches(it):
            keep = []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                words = hashes.of(words_of(text or b""))
                n_hit = int(known.value.hits(words)[0].sum())
                keep.append(not (n_hit and 20 * n_hit >= len(words)))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _by_broadcast(docs: DataFrame, items: DataFrame) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(Items([(r[0], bytes(r[1])) for r in items.collect()]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, items = WordHashes(), known.value
        empty = _digest(set())
        for b in batches(it):
            n_words, n_hit, n_items, digest = [], [], [], []
            for text in b.column("text").to_pylist():
                words = hashes.of(words_of(text))
                hit, found = items.hits(words)
                ids = {items.ids[k] for k in found}
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                n_items.append(len(ids))
                digest.append(_digest(ids) if ids else empty)
            numbers = [pa.array(x, pa.int64()) for x in (n_words, n_hit, n_items)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *numbers, pa.array(digest, pa.string())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    rows = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(run, _RESULT.format(rows.schema["doc_id"].dataType.simpleString()))


_SPOTS = "key binary, print bigint, n int, starts array<int>, windows array<bigint>"


def _spots(lengths: list[int], own: bool):
    """Of texts with a key: each fingerprint, and starts and hashes of the windows whose fingerprint it is.

    Windows have 13 words, and the lengths given; of items (own) the whole text alone if it is shorter than 13.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches(it, 1 << 20):
            rows, parts = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                h = hashes.of(words_of(text))
                sizes = ([WINDOW] if len(h) >= WINDOW else [len(h)]) if own else [WINDOW, *lengths]
                for n in [n for n in sizes if 0 < n <= len(h)]:
                    prints = window_min(gram_hashes(h, GRAM), WIDTH) if n == WINDOW else gram_hashes(h, n)
                    windows = gram_hashes(h[::-1].copy(), n)[::-1]
                    parts.append((prints, np.full(len(prints), n), np.arange(len(prints)), windows))
                    rows.append(np.full(len(prints), i))
            if not parts:
                continue
            row, prints, n, starts, windows = np.concatenate(rows), *(np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((starts, n, prints, row))
            row, prints, n, starts, windows = (x[order] for x in (row, prints, n, starts, windows))
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (prints[1:] != prints[:-1]) | (n[1:] != n[:-1])
            first = np.flatnonzero(new)
            ends = pa.array(np.append(first, len(row)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (starts.astype(np.int32), windows.view(np.int64))]
            columns = [b.column("key").take(pa.array(row[first])), pa.array(prints[first].view(np.int64)), pa.array(n[first], pa.int32()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["key", "print", "n", "starts", "windows"])

    return run


def _covered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n_hit: how many words the windows of each key cover."""
    for b in batches(it):
        found = []
        for spots in b.column("spots").to_pylist():
            start, n = (np.array([x[c] for x in spots]) for c in ("start", "n"))
            steps = np.zeros(int((start + n).max()) + 1, np.int64)
            np.add.at(steps, start, 1)
            np.add.at(steps, start + n, -1)
            found.append(int((np.cumsum(steps) > 0).sum()))
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(found, pa.int64())], ["key", "n_hit"])


def _by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For item sets too large to broadcast: equal fingerprints, then equal windows meet in shuffle joins.

    What is gathered of a document is its hit places and the ids of items found in it; nothing is by pair.
    """
    rows = docs.select("doc_id", utf8(F.col("text")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    whole = items.select(F.col("item").cast("binary").alias("key"), F.col("words").alias("text"))
    window = ["print", "n", "window"]
    known = whole.mapInArrow(_spots([], True), _SPOTS).select(F.col("key").cast("string").alias("item"), "print", "n", F.explode("windows").alias("window"))
    known = materialize(known.distinct(), "item-windows")
    lengths = sorted(r.n for r in known.where(F.col("n") < WINDOW).select("n").distinct().collect())  # 12 at most
    spots = rows.select("key", "text").mapInArrow(_spots(lengths, False), _SPOTS)
    spots = spots.join(known.select("print", "n").distinct(), ["print", "n"], "left_semi").dropDuplicates(["key", "print", "n"])
    spots = spots.select("key", "print", "n", F.explode(F.arrays_zip("starts", "windows")).alias("w"))
    spots = spots.select("key", "print", "n", F.col("w.starts").alias("start"), F.col("w.windows").alias("window"))
    hits = materialize(spots.join(known.select(window).distinct(), window, "left_semi"), "hits")
    covered = hits.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spots")).mapInArrow(_covered, "key binary, n_hit bigint")
    ids = hits.select("key", *window).distinct().join(known, window).groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("ids"))
    found = covered.join(ids, "key")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n_words = [len(words_of(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(n_words, pa.int64())], ["doc_id", "key", "n_words"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.select("doc_id", "text", "key").mapInArrow(count, f"doc_id {kind}, key binary, n_words bigint")
    return counted.join(found, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
    )
