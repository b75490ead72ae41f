"""Centroid clustering: k-means of whole-number vectors, with distances from bit planes.

A component x becomes the integer floor(scale * x). Plane b of a vector holds bit b of its components, 64 of
them in one uint64; the highest plane counts negatively, as in two's complement. A dot product is then the sum of
popcount(plane of x AND plane of c), weighted by both planes' weights, and |x - c|^2 = x.x - 2 x.c + c.c:
whole numbers throughout, exact. Vectors are packed once, into a table of their planes; a round reads
it, and each task answers with one row for each centroid, its count and component sums, so that
neither memory nor shuffle grows with a cluster. The driver sees the centroids and their sums only.

Defined results: rows whose vector is null, has another number of components, or holds a null or a value
that isn't finite are left out; a null id counts as the empty text where the first centroids are drawn, and
rows of equal rank are drawn by their planes; repeated rows count each; with fewer rows than centroids
there are as many centroids as rows; other columns are not read. Components whose integer is 2^27 or more
in size are an error, since squared distances of such vectors wouldn't fit in 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, materialize

#: Integers of this size and above are refused.
LIMIT = 1 << 27


def integers(vectors: pa.Array, scale: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors (lists of numbers) have `size` components, none null or not finite, and floor(scale * x) of
    these, a row each."""
    keep = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size
    values = vectors.filter(pa.array(keep)).flatten().cast(pa.float64())
    flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(int(keep.sum()), size)
    finite = np.isfinite(flat).all(1)
    keep[keep] = finite
    numbers = np.floor(flat[finite] * scale)
    if (np.abs(numbers) >= LIMIT).any():
        raise ValueError(f"a component times {scale} is {LIMIT} or more in size: squared distances would not fit in 64 bits")
    return keep, numbers.astype(np.int64)


def weights_of(planes: int) -> np.ndarray:
    """1, 2, 4, ... and the negative weight of the highest plane."""
    w = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def pack(numbers: np.ndarray) -> np.ndarray:
    """(rows, components) integers as (rows, planes, words) uint64, with just the planes that they need."""
    rows, size = numbers.shape
    planes = 1 + max(int(n if n >= 0 else ~n).bit_length() for n in (numbers.max(initial=0), numbers.min(initial=0)))
    bits = (numbers[:, None, :] >> np.arange(planes)[None, :, None] & 1).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, 0), (0, -size % 64)))
    return np.packbits(bits, axis=2, bitorder="little").view("<u8").reshape(rows, planes, bits.shape[2] // 64)


def plane_sums(planes: np.ndarray, size: int) -> np.ndarray:
    """Sums over rows of each of the `size` components."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8), axis=2, bitorder="little", count=size)
    return weights_of(planes.shape[1]) @ bits.sum(0, dtype=np.int64)


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of the rows of x with one vector c, both as planes."""
    wx, total = weights_of(x.shape[1]), np.zeros(len(x), np.int64)
    for plane, weight in zip(c, weights_of(len(c)), strict=True):
        total += weight * (np.bitwise_count(x & plane).sum(2, dtype=np.int64) @ wx)
    return total


def squares(x: np.ndarray) -> np.ndarray:
    """x.x of each row, as planes."""
    w, total = weights_of(x.shape[1]), np.zeros(len(x), np.int64)
    for plane, weight in enumerate(w):
        total += weight * (np.bitwise_count(x & x[:, plane : plane + 1]).sum(2, dtype=np.int64) @ w)
    return total


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row (planes), the number of its nearest centroid (a row of integers), the smaller in a tie, and the squared distance."""
    own = squares(x)
    distance = np.stack([own - 2 * dots(x, pack(c[None])[0]) + int(c @ c) for c in centroids], 1)
    best = distance.argmin(1)
    return best, distance[np.arange(len(x)), best]


def _by_width(batch: pa.RecordBatch, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the batch and their planes; batches of the packing stage may have different numbers of planes."""
    packed = batch.column("planes").to_pylist()
    widths = np.fromiter(map(len, packed), np.int64, len(packed))
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield at, np.frombuffer(b"".join(packed[i] for i in at), "<u8").reshape(len(at), -1, words)


@dataclass(frozen=True)
class Clusters:
    """A fitted clustering: the table of packed vectors, and what is known of each centroid."""

    packed: DataFrame
    centroids: np.ndarray  #: (centroids, components)
    inertia: list[int]  #: summed squared distance of each centroid's vectors
    id_column: str


def packed_table(df: DataFrame, id_column: str, vector: str, scale: int, size: int) -> DataFrame:
    """id and planes of the usable rows, written to the shared folder."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            keep, numbers = integers(b.column("vector"), scale, size)
            if len(numbers):
                rows = [r.tobytes() for r in pack(numbers)]
                yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(keep)), pa.array(rows, pa.binary())], ["id", "planes"])

    rows = df.select(F.col(id_column).alias("id"), F.col(vector).alias("vector"))
    return materialize(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, planes binary"), "planes")


def fit(
    df: DataFrame, centroids: int = 16, rounds: int = 3, scale: int = 64, size: int = 64, id_column: str = "vec_id", vector: str = "embedding", draw: Column | None = None,
) -> Clusters:
    """Clusters the usable rows. `draw`, a column of id, ranks rows: those that come first in it are the first
    centroids (default: SHA-256 of "1:" and the id). Empty centroids stay where they are."""
    words = -(-size // 64)
    packed = packed_table(df, id_column, vector, scale, size)
    if draw is None:
        draw = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = packed.orderBy(draw, "planes").limit(centroids).collect()
    at = np.array([plane_sums(np.frombuffer(bytes(r.planes), "<u8").reshape(1, -1, words), size) for r in first], np.int64).reshape(len(first), size)
    inertia = [0] * len(at)
    for turn in range(rounds + 1 if len(at) else 0):
        found = _totals(packed, at, size)
        if turn < rounds:
            at = np.array([[s // found[k][0] for s in found[k][2]] if k in found else c for k, c in enumerate(at)], np.int64)
        else:
            inertia = [found[k][1] if k in found else 0 for k in range(len(at))]
    return Clusters(packed, at, inertia, id_column)


def _totals(packed: DataFrame, centroids: np.ndarray, size: int) -> dict[int, tuple[int, int, list[int]]]:
    """By centroid: its vectors' number, summed squared distances and component sums."""
    words, k = -(-size // 64), len(centroids)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, far, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for b in batches(it):
            for _, planes in _by_width(b, words):
                best, distance = nearest(planes, centroids)
                for c in np.unique(best):
                    mine = best == c
                    count[c] += mine.sum()
                    far[c] += distance[mine].sum()
                    sums[c] += plane_sums(planes[mine], size)
        some = np.flatnonzero(count)
        columns = [pa.array(some, pa.int32()), pa.array(count[some]), pa.array(far[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "far", "sums"])

    each = packed.select("planes").mapInArrow(run, "cluster int, n bigint, far bigint, sums array<bigint>")
    total = each.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)])
    return {r[0]: (r[1], r[2], list(r[3:])) for r in total.collect()}


def assign(model: Clusters) -> DataFrame:
    """id, cluster and distance (squared) of every usable row, and of its centroid cluster_inertia, inertia and centroid_sha256."""
    centroids, name = model.centroids, model.id_column
    words = -(-centroids.shape[1] // 64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            cluster, distance = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
            for at, planes in _by_width(b, words):
                cluster[at], distance[at] = nearest(planes, centroids)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    rows = model.packed.mapInArrow(run, f"id {model.packed.schema['id'].dataType.simpleString()}, cluster int, distance bigint")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.get(F.array([F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    return rows.select(
        F.col("id").alias(name), "cluster", "distance", of(model.inertia, "bigint").alias("cluster_inertia"), F.lit(sum(model.inertia)).cast("bigint").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
    )
