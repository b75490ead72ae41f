"""Vector code compression: product quantisation, with Orchard's search for the nearest codebook entry.

A vector of integers floor(scale * x) is cut into equal consecutive parts; each part position has a codebook, and a
vector's code holds the index of each part's nearest entry. Orchard's search keeps, for every entry, the list of all
entries by their distance from it. It walks the list of the best entry so far; an entry nearer to the part becomes the
best one, and the walk goes on in its list; what was visited is marked and not measured again; the walk ends where the
list goes beyond twice the part's distance from the best entry, since by the triangle inequality no entry there can be
nearer. All parts of a batch walk at once, a few places of their lists in a step. Comparisons are between
squares of whole numbers, so the result is exact, ties included.

A round reads the table of integers and gets at most one row per entry from each task: count and component sums.

Defined results: rows whose vector is null or holds a null or a value that isn't finite are left out. Vectors have the
number of components of the usable row with the smallest id that a cut into equal parts allows; rows with another number
stay with a null code and error. Of equal ids the one whose packed integers sort first comes first, null ids come last; with fewer rows than
entries the codebooks have as many entries as rows. Repeated rows are coded each. Null labels form one group, NaN and
all other labels theirs. Integers of 2^27 or more in size are an error, as in `bitplanes`. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitplanes import integers
from .common import batches, materialize

#: Places of a neighbour list that one step measures.
STEP = 8
#: Entries that are measured first; the nearest of them starts the walk.
PIVOTS = 8
#: Labels with more than this share of the rows are summed apart, so there are fewer than 1 / SHARE of them.
SHARE = 1e-3


class Codebook:
    """The entries of one part position, with the neighbour list of each."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = np.stack([((entries - e) ** 2).sum(1) for e in entries]) if len(entries) else np.zeros((0, 0), np.int64)
        self.neighbours = between.argsort(1, kind="stable")
        self.reach = np.take_along_axis(between, self.neighbours, 1)
        self.pivots = np.unique(np.linspace(0, len(entries) - 1, min(PIVOTS, len(entries))).astype(np.int64))

    def nearest(self, x: np.ndarray, rows: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of x the nearest entry, the lower index in a tie, and the squared distance."""
        found = [self._walk(x[i : i + rows])[:2] for i in range(0, len(x), rows)]
        return tuple(np.concatenate(c) if found else np.empty(0, np.int64) for c in (zip(*found, strict=True) if found else ((), ())))

    def _measure(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        difference = x - self.entries[entry]
        return np.einsum("ij,ij->i", difference, difference)

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Also the number of distances that were measured."""
        n, m = len(x), len(self.entries)
        seen = np.zeros((n, m), bool)
        seen[:, self.pivots] = True
        first = np.stack([((x - self.entries[p]) ** 2).sum(1) for p in self.pivots], 1)
        best, least = self.pivots[first.argmin(1)], first.min(1)
        place, measured = np.zeros(n, np.int64), n * len(self.pivots)
        walking = np.arange(n)
        while len(walking):
            at = place[walking, None] + np.arange(STEP)
            inside = at < m
            at = np.minimum(at, m - 1)
            mine = best[walking, None]
            entry, reach = self.neighbours[mine, at], self.reach[mine, at]
            # Only a list's places within twice the distance count: squared, four times.
            inside &= reach <= 4 * least[walking, None]
            who, step = np.nonzero(inside & ~seen[walking[:, None], entry])
            entries, rows = entry[who, step], walking[who]
            seen[rows, entries] = True
            distance = np.full(at.shape, np.iinfo(np.int64).max)
            distance[who, step] = self._measure(x[rows], entries)
            measured += len(rows)
            low = distance.min(1)
            index = np.where(distance == low[:, None], entry, m).min(1)
            better = (low < least[walking]) | (low == least[walking]) & (index < best[walking])
            moved = walking[better]
            best[moved], least[moved], place[moved] = index[better], low[better], 0
            place[walking[~better]] += STEP
            walking = walking[better | inside[:, -1]]
        return best, least, measured


@dataclass(frozen=True)
class Codes:
    """Fitted codebooks and the table of integers that they were fitted on."""

    vectors: DataFrame
    books: np.ndarray  #: (parts, entries, components of a part)
    id_column: str
    label: str | None


def _numbers(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have `size` components, and their integers."""
    packed = batch.column("numbers").to_pylist()
    keep = np.fromiter((len(p) == 4 * size for p in packed), bool, len(packed))
    return keep, np.frombuffer(b"".join(p for p, k in zip(packed, keep, strict=True) if k), "<i4").reshape(int(keep.sum()), size).astype(np.int64)


def integer_table(df: DataFrame, id_column: str, vector: str, label: str | None, scale: int) -> DataFrame:
    """id, label and numbers (32-bit integers) of the usable rows, written to the shared folder."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            lengths = b.column("vector").value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for size in np.unique(lengths[lengths >= 0]):
                keep, numbers = integers(b.column("vector"), scale, int(size))
                if len(numbers):
                    rows = b.filter(pa.array(keep))
                    packed = pa.array([r.tobytes() for r in numbers.astype("<i4")], pa.binary())
                    yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), packed], ["id", "label", "numbers"])

    rows = df.select(F.col(id_column).alias("id"), (F.lit(None).cast("int") if label is None else F.col(label)).alias("label"), F.col(vector).alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return materialize(rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, numbers binary"), "integers")


def fit(
    df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_column: str = "vec_id", vector: str = "embedding", label: str | None = "label",
) -> Codes:
    """Fits the codebooks; they start as the parts of the usable rows with the smallest ids. Unused entries stay."""
    vectors = integer_table(df, id_column, vector, label, scale)
    length = F.length("numbers")
    in_order = vectors.where((length > 0) & (length % (4 * parts) == 0)).orderBy(F.asc_nulls_last("id"), "numbers")
    head = in_order.select(length).first()
    size = head[0] // 4 if head else 0
    width = size // parts
    first = in_order.where(length == 4 * size).limit(entries).collect() if head else []
    books = np.array([np.frombuffer(bytes(r.numbers), "<i4") for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        books = books.copy()
        for part, entry, n, *sums in _totals(vectors, books):
            books[part, entry] = [s // n for s in sums]
    return Codes(vectors, books, id_column, label)


def _totals(vectors: DataFrame, books: np.ndarray) -> list:
    """(part, entry, number of vectors, component sums ...) of the entries in use."""
    parts, entries, width = books.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        count, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches(it):
            _, numbers = _numbers(b, parts * width)
            for p, book in enumerate(own if len(numbers) else ()):
                x = numbers[:, p * width : (p + 1) * width]
                code, _ = book.nearest(x)
                order = code.argsort(kind="stable")
                used, start = np.unique(code[order], return_index=True)
                count[p] += np.bincount(code, minlength=entries)
                sums[p, used] += np.add.reduceat(x[order], start)
        part, entry = np.nonzero(count)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    each = vectors.select("numbers").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    return each.groupBy("part", "entry").agg(F.sum("n"), *[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).collect()


def encode(model: Codes) -> DataFrame:
    """id, label, code (array of indexes, a part each) and error (summed squared distances) of every usable row."""
    books, kinds = model.books, {f.name: f.dataType.simpleString() for f in model.vectors.schema.fields}
    parts, _, width = books.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        for b in batches(it):
            keep, numbers = _numbers(b, parts * width)
            keep &= books.size > 0
            codes, error = np.zeros((b.num_rows, parts), np.int32), np.zeros(b.num_rows, np.int64)
            for p, book in enumerate(own if keep.any() else ()):
                codes[keep, p], distance = book.nearest(numbers[:, p * width : (p + 1) * width])
                error[keep] += distance
            code = pa.array([c if k else None for c, k in zip(codes, keep, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), code, pa.array(error, mask=~keep)], ["id", "label", "code", "error"])

    return model.vectors.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code array<int>, error bigint")


def codebooks_sha256(model: Codes) -> str:
    """Of all entries' components as decimal integers, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, model.books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded, a written table, with label_error: error summed over equal labels.

    Labels of many rows, fewer than 1 / SHARE by their share, are broadcast with their sums; rows of the others, each
    with a small share of the rows, are joined by label, so that no task gets a hot one.
    """
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    sums = materialize(sums, "label-errors")
    least = SHARE * (sums.agg(F.sum("n")).first()[0] or 0)
    hot = sums.where(F.col("n") > least).select(F.col("label").alias("hot"), F.col("label_error"), F.lit(True).alias("is_hot"))
    rare = sums.where(F.col("n") <= least).select(F.col("label").alias("rare"), F.col("label_error").alias("rare_error"))
    known = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("hot")), "left")
    apart = known.where("is_hot is null").join(rare, F.col("label").eqNullSafe(F.col("rare")), "left")
    columns = [c for c in coded.columns]
    return known.where("is_hot").select(*columns, "label_error").unionByName(apart.select(*columns, F.col("rare_error").alias("label_error")))


def compress(df: DataFrame, **settings) -> DataFrame:
    """id, code (two hex digits an index), error, label_error and codebooks_sha256 of every usable row; settings: fit()'s."""
    model = fit(df, **settings)
    if model.books.shape[1] > 256:
        raise ValueError("an index of two hex digits has 256 values")
    coded = materialize(encode(model), "codes")
    digits = F.array_join(F.transform("code", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    return with_label_error(coded).select(
        F.col("id").alias(model.id_column), digits.alias("code"), "error", "label_error", F.lit(codebooks_sha256(model)).alias("codebooks_sha256"),
    )
