"""What several operators of this subpackage share: scratch tables, word rules, word hashes."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import clear_scratch, delete_scratch, scratch_folder

__all__ = ["clear_scratch"]  # deletes what operators have left in the shared folder

#: A word is a run of anything but ASCII whitespace; bytes.split() separates at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a table's files up to which its rows are dealt out to all cores.
SMALL_TABLE = 24 << 20


class _Blocks(threading.local):
    """The open `temporary` blocks of a thread, each with the scratch tables made in it."""

    def __init__(self):
        self.open: list[list[str]] = []


_blocks = _Blocks()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows. A small one, which may be a single row group and so a single task's, is dealt out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_TABLE:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    if _blocks.open:
        _blocks.open[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block at whose end the scratch tables that this thread has made in it are deleted, but for those that a
    DataFrame passed to what the block gets reads. Tables of other threads stay."""
    kept: list[str] = []
    made: list[str] = []
    _blocks.open.append(made)

    def keep(df: DataFrame) -> DataFrame:
        files = df.inputFiles()
        kept.extend(p for p in made if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in files))
        return df

    try:
        yield keep
    finally:
        _blocks.open.pop()
        if _blocks.open:
            _blocks.open[-1].extend(p for p in made if p in kept)
        delete_scratch(spark, [p for p in made if p not in kept])


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in either case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes; null counts as the empty text."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


class WordHashes(dict):
    """64-bit hashes of words, remembered for a bounded number of words."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = words[:count].copy()
    for i in range(1, n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += words[i : i + count]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values, in about log2(width) passes."""
    m, have = values, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return m if have == width else np.minimum(m[: len(values) - width + 1], m[width - have : width - have + len(values) - width + 1])


def batches(it: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Splits Arrow batches so that each holds about `most_bytes` at most, or one row."""
    for batch in it:
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
