"""Token-ID files: texts as ids of a tokenizer, Huffman-coded with one code for the whole corpus.

Format: a folder with three Parquet tables. `code` has the id and the code length of every id that occurs; lengths make
the canonical code. `files` has a row for each file: its number, the ids in all files before it, and its own. `blocks`
has the blocks: file, the ids before it in its file, its documents' ids and lengths, and `data`: magic "LTH1",
then little-endian the symbols between two checkpoints (32 bits), the number of ids, the number of checkpoints behind the
first and a CRC-32 of the rest; the bits between checkpoints, 16 bits each; the stream as big-endian 64-bit words. A
block holds whole documents, and closes once it has `BLOCK` ids. Blocks are decoded without any other, by tables,
from all checkpoints side by side.

Documents are in ascending order of doc_id, null last; rows of equal doc_id by the CRC-32 of their ids. Every document
ends with the id `end`, and null counts as the empty text, which has that id only. Repeated rows are stored each;
other columns are not read; an empty table gives files without rows.

Texts are encoded once, into a scratch table of ids. A tokenizer that drops white space, lower-cases, and splits between
letters and other characters is asked for words instead of texts: what stands between ASCII white space is
encoded apart, letters apart from what follows them, and words are remembered, a bounded number of them. Words of Latin letters
go to the tokenizer's model at once, in the form that its own normalizer and splitter give each letter. That gives the same ids, as no rule of such a tokenizer looks across these borders; set words_apart to False for others.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, materialize, utf8
from .huffman import EVERY, Code, code_lengths

#: Ids from which on a block closes.
BLOCK = 1 << 16
#: Bytes of ids that a file gets, and the most files there are: the driver holds a row for each of them.
FILE_BYTES, MOST_FILES = 32 << 20, 20_000
_HEAD = struct.Struct("<4sIIII")
#: Code points up to which letters are looked up one by one; what may follow them without forming a contraction or a special token.
_LATIN, _BEHIND = 0x180, r"[!-&(-/:;=-@\[-`{}~]*"


class _Words(dict):
    """word -> its ids, as bytes; the last two generations of `limit` words are remembered."""

    def __init__(self, path: str, kind: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.code = self.tokenizer.model, {"<u2": "H", "<u4": "I"}[kind]
        self.old: dict[bytes, bytes] = {}
        self.forms = dict(self._letters())
        letters = "".join(map(chr, self.forms))
        self.plain = re.compile(f"([{letters}]+)({_BEHIND})")

    def _letters(self) -> Iterator[tuple[int, str]]:
        """Letters that the tokenizer brings into one form whatever their case, with this form."""
        form = lambda c: self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(c))
        for c in map(chr, range(_LATIN)):
            if c.isalpha() and len(form(c)) == 1 and form(c)[0][0] == form(c.lower())[0][0]:
                yield ord(c), form(c)[0][0]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        found = self.old.get(word)
        if found is None:
            found = self._encode(word)
        self[word] = found
        return found

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _encode(self, word: bytes) -> bytes:
        plain = self.plain.fullmatch(word.decode())
        if not plain:
            return self.whole(word)
        letters, rest = plain.groups()
        lower = letters.lower()
        if rest or lower != letters:
            return self[lower.encode()] + (self[rest.encode()] if rest else b"")
        return self._packed([t.id for t in self.model.tokenize(lower.translate(self.forms))])

    def whole(self, text: bytes) -> bytes:
        """The ids of a text, asked for at once."""
        return self._packed(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)

    def text(self, text: bytes) -> bytes:
        """The ids of a text, word by word."""
        return b"".join(map(self.__getitem__, text.split()))


_words: dict[tuple[str, str], _Words] = {}


def _words_of(path: str, kind: str) -> _Words:
    """This Python worker's words; it goes on to other tasks with them."""
    if (path, kind) not in _words:
        _words[path, kind] = _Words(path, kind)
    return _words[path, kind]


def id_kind(path: str, end: int) -> str:
    """The narrowest unsigned type, little-endian, that holds all ids."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, path: str, end: int = 1, words_apart: bool = True) -> DataFrame:
    """doc_id, at (a number of the row), n, crc and ids (of `id_kind`) of every row; written to the shared folder.

    path: a tokenizer's file, which is at the same place on all machines.
    """
    kind = id_kind(path, end)
    width, last = np.dtype(kind).itemsize, np.array([end], kind).tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words_of(path, kind)
        of = known.text if words_apart else known.whole
        for b in batches(it):
            ids = [of(t) + last for t in b.column("text").to_pylist()]
            columns = [b.column("doc_id"), b.column("at"), pa.array([len(i) // width for i in ids], pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "n", "crc", "ids"])

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("at"), utf8(F.col("text")).alias("text"))
    return materialize(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, at bigint, n bigint, crc bigint, ids binary"), "token-ids")


def id_counts(tokens: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs; as long as the vocabulary at most."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in it:
            own = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), kind), minlength=len(total))
            own[: len(total)] += total
            total = own
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def block_bytes(code: Code, ids: np.ndarray) -> bytes:
    words, between = code.encode(ids)
    body = between.astype("<u2").tobytes() + words.astype(">u8").tobytes()
    return _HEAD.pack(b"LTH1", EVERY, len(ids), len(between), zlib.crc32(body)) + body


def decode_blocks(code: Code, blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; all their stretches at once."""
    streams, begins, shapes, before = [], [], [], 0
    for data in blocks:
        magic, every, n, checkpoints, crc = _HEAD.unpack_from(data)
        body = memoryview(data)[_HEAD.size :]
        if magic != b"LTH1" or every != EVERY or zlib.crc32(body) != crc:
            raise ValueError("not a block of token ids, or a damaged one")
        between = np.frombuffer(body, "<u2", checkpoints).astype(np.int64)
        streams.append(np.frombuffer(body, ">u8", offset=2 * checkpoints).astype(np.uint64))
        begins.append(before * 64 + np.concatenate([[0], np.cumsum(between)]))
        shapes.append((n, checkpoints + 1))
        before += len(streams[-1])
    if not blocks:
        return []
    rows = code.decode(np.concatenate(streams), np.concatenate(begins), min(EVERY, max(n for n, _ in shapes)))
    out, first = [], 0
    for n, stretches in shapes:
        out.append(rows[first : first + stretches].reshape(-1)[:n])
        first += stretches
    return out


def _blocks(lengths: np.ndarray, kind: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, file, before = Code(lengths), TaskContext.get().partitionId(), 0
        docs, parts, size = [], [], 0

        def block() -> pa.RecordBatch:
            columns = ([file], [before], [size], [[d for d, _ in docs]], [[n for _, n in docs]], [block_bytes(code, np.frombuffer(b"".join(parts), kind))])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "before", "n", "doc_ids", "lengths", "data"])

        for b in batches(it):
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(b.schema.field("doc_id").type), pa.list_(pa.int64()), pa.binary()]
            for doc_id, n, ids in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
                docs.append((doc_id, n))
                parts.append(ids)
                size += n
                if size >= BLOCK:
                    yield block()
                    docs, parts, before, size = [], [], before + size, 0
        if docs:
            yield block()

    return run


def write(docs: DataFrame, folder: str, path: str, end: int = 1, limit: int = 20, words_apart: bool = True) -> None:
    """Writes the files. The driver gets the ids' counts (a vocabulary of them) and a row for each file."""
    spark = docs.sparkSession
    tokens = tokenize(docs, path, end, words_apart)
    ids = id_kind(path, end)
    lengths = code_lengths(id_counts(tokens, ids), limit)
    some = np.flatnonzero(lengths)
    code = spark.createDataFrame([(int(i), int(lengths[i])) for i in some], "id bigint, bits int")
    code.coalesce(1).write.parquet(f"{folder}/code")
    n = tokens.agg(F.sum("n")).first()[0] or 0
    wanted = min(MOST_FILES, max(spark.sparkContext.defaultParallelism, np.dtype(ids).itemsize * n // FILE_BYTES))
    order = [F.asc_nulls_last("doc_id"), F.asc("crc"), F.asc("at")]
    ordered = tokens.select("doc_id", "crc", "at", "n", "ids").repartitionByRange(wanted, *order).sortWithinPartitions(*order)
    kind = tokens.schema["doc_id"].dataType.simpleString()
    blocks = ordered.mapInArrow(_blocks(lengths, ids), f"file int, before bigint, n bigint, doc_ids array<{kind}>, lengths array<bigint>, data binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("file").agg(F.sum("n").alias("n")).orderBy("file").collect()
    starts = np.cumsum([0, *(r.n for r in sizes)]).tolist()
    files = spark.createDataFrame([(r.file, s, r.n) for r, s in zip(sizes, starts, strict=False)], "file int, start bigint, n bigint")
    files.coalesce(1).write.parquet(f"{folder}/files")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (unsigned, 32 bits each, little-endian) of every document."""
    known = spark.read.parquet(f"{folder}/code").collect()  # at most a vocabulary
    lengths = np.zeros(max((r.id for r in known), default=0) + 1, np.uint8)
    for r in known:
        lengths[r.id] = r.bits
    starts = {r.file: r.start for r in spark.read.parquet(f"{folder}/files").collect()}  # at most MOST_FILES
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for b in batches(it, 1 << 20):
            rows = b.to_pydict()
            for i, ids in enumerate(decode_blocks(code, rows["data"])):
                n = np.array(rows["lengths"][i], np.int64)
                ends = np.cumsum(n)
                texts, raw = (ends - n) * 4, ids.astype("<u4").tobytes()
                own = [raw[s : s + 4 * k] for s, k in zip(texts.tolist(), n.tolist(), strict=True)]
                start = starts[rows["file"][i]] + rows["before"][i] + ends - n
                columns = [pa.array(rows["doc_ids"][i], b.schema.field("doc_ids").type.value_type), pa.array(start), pa.array(n), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")
