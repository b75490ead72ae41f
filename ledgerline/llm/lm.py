"""Language-model scoring by deleted interpolation.

P(w | u) = a*c(u,w)/c(u) + b*c(w)/N + c/(V+1): bigram, unigram and uniform estimates from the training
documents. The weights depend on the context's frequency, in buckets of doubling size, and are learned
by expectation-maximisation on held-out counts: a part of the training documents is deleted from the
counts, the weights are fitted to predict it, and the part is put back for the final estimates.

Counting. Documents are packed into blocks. A block sends each of its distinct words and word pairs,
as sorted 64-bit hashes with their counts, to the buckets that own them, one packed row per bucket; the
owners add the counts up and answer in the same order. So a frequent word costs a number per block,
and a block's answers suffice to score it. Blocks and owners hold a bounded share of the data each;
their number follows the corpus. Only totals and the fitting's bounded histogram reach the driver.

Tokens are the words of a text, A-Z lower-cased, and one end. Defined results: a null text is the empty
one, an end only; a null id counts as the empty text for the choice of part; with no training documents
all estimates are uniform; repeated rows count and are scored each; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batches, id_remainder, materialize, utf8

BLOCK = 16 << 20  #: bytes of text in a block
OWNED = 16 << 20  #: bytes of text for which there is one owner
END, START = b"", b" "  #: no word has these spellings
BUCKETS = 24
STEPS = 60
#: The fitting's histogram has a cell for each sixteenth of a probability's logarithm, and its mean inside.
RESOLUTION, NEVER = 16, -10_000.0
SMOOTH = 0.1


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one more for each doubling of its count."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _blocks(doc_id_type: pa.DataType):
    """block, deleted, doc_ids, parts and packed texts; documents of the deleted part have blocks of their own."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, BLOCK):
            parts = b.column("part").to_numpy()
            for deleted in (True, False):
                own = b.filter(pa.array((parts == 1) == deleted))
                if own.num_rows:
                    texts = own.column("text").to_pylist()
                    lengths = np.array([len(t) for t in texts], np.int64)
                    row = [
                        pa.array([uuid.uuid4().hex]), pa.array([deleted]),
                        pa.array([own.column("doc_id").to_pylist()], pa.list_(doc_id_type)), pa.array([own.column("part").to_pylist()], pa.list_(pa.int32())),
                        pa.array([_pack(lengths)], pa.binary()), pa.array([zstandard.compress(b"".join(texts), 3)], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(row, ["block", "deleted", "doc_ids", "parts", "lengths", "packed"])

    return run


def _pack_counts(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest width that holds them all, 64 bits at most; the width is the first byte."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + _pack(values.astype(kind))


def _unpack_counts(data: bytes) -> np.ndarray:
    return _unpack(data[1:], f"u{data[0]}").astype(np.int64)


class Block:
    """The tokens and pairs of a block's documents, as places in sorted tables of distinct hashes."""

    def __init__(self, lengths: bytes, packed: bytes, hashes: WordHashes):
        text, at = zstandard.decompress(packed), 0
        tokens = []
        for n in _unpack(lengths, np.int64).tolist():
            tokens.append(hashes.of([*text[at : at + n].lower().split(), END]))
            at += n
        self.sizes = np.array([len(t) for t in tokens])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        flat = np.concatenate(tokens)
        before = np.concatenate([[0], flat[:-1]]).astype(np.uint64)
        before[self.first] = hashes[START]
        pair = before * np.uint64(0x9E3779B97F4A7C15)
        pair = (pair ^ (pair >> np.uint64(31))) + flat * np.uint64(0xC2B2AE3D27D4EB4F)
        pair ^= pair >> np.uint64(29)
        pair *= np.uint64(0xBF58476D1CE4E5B9)
        pair ^= pair >> np.uint64(32)
        self.keys, self.places = {}, {}
        for name, values in (("word", flat), ("pair", pair)):
            self.keys[name], self.places[name] = np.unique(values, return_inverse=True)
        # A document's first context is its start, which is as frequent as the end.
        self.context = np.concatenate([[0], self.places["word"][:-1]])
        self.context[self.first] = self.places["word"][self.first + self.sizes - 1]

    def by_owner(self, name: str, owners: int) -> tuple[np.ndarray, np.ndarray]:
        """An order of the keys by owner, and the bounds of each owner's."""
        owner = self.keys[name] % np.uint64(owners)
        order = np.argsort(owner, kind="stable")
        return order, np.searchsorted(owner[order], np.arange(owners + 1, dtype=np.uint64))


def _requests(owners: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in it:
            for name, deleted, parts, lengths, packed in zip(*(b.column(c).to_pylist() for c in ("block", "deleted", "parts", "lengths", "packed"))):
                block = Block(lengths, packed, hashes)
                train = np.repeat(np.array(parts) != 0, block.sizes).astype(np.float64)
                for kind in ("word", "pair"):
                    counts = np.bincount(block.places[kind], weights=train).astype(np.int64)
                    order, bounds = block.by_owner(kind, owners)
                    own = np.flatnonzero(np.diff(bounds))
                    keys, counts = block.keys[kind][order], counts[order]
                    cut = [(keys[bounds[o] : bounds[o + 1]], counts[bounds[o] : bounds[o + 1]]) for o in own]
                    n = len(own)
                    packed_keys, packed_counts = ([f(x) for x in part] for f, part in zip((np.ndarray.tobytes, _pack_counts), zip(*cut)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, pa.int32()), *(pa.array([x] * n) for x in (kind, name, deleted)),
                            pa.array(packed_keys, pa.binary()), pa.array(packed_counts, pa.binary()),
                        ],
                        ["owner", "kind", "block", "deleted", "keys", "counts"],
                    )

    return run


_ANSWER = pa.schema([("block", pa.string()), ("deleted", pa.bool_()), ("kind", pa.string()), ("owner", pa.int32()), ("total", pa.binary()), ("kept", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _sums(places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of the 64-bit values of each place."""
    out = np.zeros(int(places.max(initial=-1)) + 1, np.int64)
    np.add.at(out, places, values)
    return out


def _answer(group: pa.Table) -> pa.Table:
    """Adds up one owner's counts of one kind; answers each request, and a row of totals.

    total: counts in all training documents; kept: without the deleted part, for deleted blocks only.
    """
    rows = group.to_pylist()
    keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    counts = [_unpack_counts(r["counts"]) for r in rows]
    known, back = np.unique(np.concatenate(keys), return_inverse=True)
    flat = np.concatenate(counts)
    total = _sums(back, flat)
    gone = np.concatenate([np.full(len(k), r["deleted"]) for k, r in zip(keys, rows)])
    kept = total - _sums(back, flat * gone)
    out, at = [], 0
    for r, k in zip(rows, keys):
        own = back[at : at + len(k)]
        at += len(k)
        kept_own = _pack_counts(kept[own]) if r["deleted"] else None
        out.append({"block": r["block"], "deleted": r["deleted"], "kind": r["kind"], "owner": r["owner"], "total": _pack_counts(total[own]), "kept": kept_own, "stats": None})
    stats = [int(total.sum()), int((total > 0).sum()), int(kept.sum()), int((kept > 0).sum())]
    out.append({"block": None, "deleted": None, "kind": rows[0]["kind"], "owner": rows[0]["owner"], "total": None, "kept": None, "stats": stats})
    return pa.Table.from_pylist(out, _ANSWER)


def _counts(block: Block, answers: list[dict], owners: int, which: str) -> dict[str, np.ndarray]:
    """The corpus counts of a block's words and pairs."""
    found = {}
    for kind in ("word", "pair"):
        order, bounds = block.by_owner(kind, owners)
        sorted_counts = np.zeros(len(order), np.int64)
        for a in answers:
            if a["kind"] == kind:
                sorted_counts[bounds[a["owner"]] : bounds[a["owner"] + 1]] = _unpack_counts(a[which])
        found[kind] = np.empty(len(order), np.int64)
        found[kind][order] = sorted_counts
    return found


def _estimates(block: Block, counts: dict[str, np.ndarray], n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of each token the context's bucket, bigram and unigram estimate; and the uniform one."""
    context = counts["word"][block.context]
    pair, word = counts["pair"][block.places["pair"]], counts["word"][block.places["word"]]
    return bucket_of(context), np.where(context > 0, pair / np.maximum(context, 1), 0.0), word / max(n, 1), 1 / (v + 1)


def _log(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.log(np.maximum(p, 1e-300)), NEVER)


def _histogram(owners: int, n: int, v: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {**dict.fromkeys(("bucket", "pair", "word", "tokens"), pa.int64()), "pair_log": pa.float64(), "word_log": pa.float64()}
        if not left.num_rows:
            return pa.table({c: pa.array([], k) for c, k in kinds.items()})
        row = left.to_pylist()[0]
        block = Block(row["lengths"], row["packed"], WordHashes())
        b, p2, p1, _ = _estimates(block, _counts(block, right.to_pylist(), owners, "kept"), n, v)
        logs = [_log(p2), _log(p1)]
        cells, back, tokens = np.unique(np.stack([b.astype(np.int64), *(np.rint(RESOLUTION * x).astype(np.int64) for x in logs)]), axis=1, return_inverse=True, return_counts=True)
        sums = [np.bincount(back.reshape(-1), weights=x) for x in logs]
        return pa.table({c: pa.array(x, k) for (c, k), x in zip(kinds.items(), [*cells, tokens, *sums])})

    return run


def fit_weights(bucket: np.ndarray, logs: np.ndarray, tokens: np.ndarray, v: int) -> np.ndarray:
    """BUCKETS rows of three weights that sum to 1, by EM; logs: of the bigram and unigram estimates.

    A bucket without held-out tokens takes the weights that fit all tokens together; an unseen context
    has no bigram weight.
    """

    def em(pick: np.ndarray, bigram: bool) -> np.ndarray:
        if not pick.any():
            return np.array([0.0, 0.5, 0.5])
        p = np.stack([*np.exp(logs[:, pick]), np.full(pick.sum(), 1 / (v + 1))])
        weights = np.array([1 / 3] * 3) if bigram else np.array([0.0, 0.5, 0.5])
        for _ in range(STEPS):
            share = weights[:, None] * p
            weights = (share / share.sum(0) * tokens[pick]).sum(1) / tokens[pick].sum()
        weights = np.maximum(weights, 1e-6 * np.array([bigram, 1, 1]))
        return weights / weights.sum()

    together = em(bucket > 0, True) if (bucket > 0).any() else np.array([1 / 3] * 3)
    return np.stack([em(bucket == b, b > 0) if (bucket == b).any() or b == 0 else together for b in range(BUCKETS)])


def _scores(owners: int, n: int, v: int, weights: np.ndarray, doc_id_type: pa.DataType):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    kinds = [doc_id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        row = left.to_pylist()[0]
        block = Block(row["lengths"], row["packed"], WordHashes())
        counts = _counts(block, right.to_pylist(), owners, "total")
        b, p2, p1, p0 = _estimates(block, counts, n, v)
        w = weights[b]
        model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
        c = counts["word"][block.places["word"]]
        base = np.log10((c + SMOOTH) / (n + SMOOTH * (v + 1)))
        sums = [np.add.reduceat(x, block.first) for x in ((c > 0).astype(np.int64), base, model)]
        columns = [row["doc_ids"], [p == 0 for p in row["parts"]], block.sizes, *sums]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def score(docs: DataFrame, parts: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Of crc32(id as text) modulo `parts`, 0 is held out from training and 1 is the deleted part.
    base_score: log10 probability by unigram counts with 0.1 added, the unseen word counted as one type.
    """
    rows = docs.select("doc_id", utf8(F.col("text")).alias("text"), id_remainder(F.col("doc_id"), parts).cast("int").alias("part"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(docs.schema["doc_id"].dataType)
    blocks = materialize(rows.mapInArrow(_blocks(arrow_kind), f"block string, deleted boolean, doc_ids array<{kind}>, parts array<int>, lengths binary, packed binary"), "lm-blocks")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(16, -(-size // OWNED))
    requests = blocks.mapInArrow(_requests(owners), "owner int, kind string, block string, deleted boolean, keys binary, counts binary")
    answers = requests.groupBy("owner", "kind").applyInArrow(_answer, "block string, deleted boolean, kind string, owner int, total binary, kept binary, stats array<bigint>")
    answers = materialize(answers, "lm-counts")
    sums = answers.where("kind = 'word' and stats is not null").agg(*[F.sum(F.col("stats")[i]) for i in range(4)]).first()
    n, v, n_kept, v_kept = (x or 0 for x in sums)
    given = answers.where("stats is null")
    both = blocks.where("deleted").groupBy("block").cogroup(given.where("deleted").groupBy("block"))
    held = both.applyInArrow(_histogram(owners, n_kept, v_kept), "bucket bigint, pair bigint, word bigint, tokens bigint, pair_log double, word_log double")
    cells = held.groupBy("bucket", "pair", "word").agg(*[F.sum(c) for c in ("tokens", "pair_log", "word_log")]).orderBy("bucket", "pair", "word").collect()
    table = np.array([(c[0], c[3], c[4] / c[3], c[5] / c[3]) for c in cells], np.float64).reshape(-1, 4).T
    weights = fit_weights(table[0].astype(np.int64), table[2:], table[1], v_kept)
    if not n:  # nothing to estimate from: all weight is the uniform one's
        weights = np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    fields = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    scored = blocks.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_scores(owners, n, v, weights, arrow_kind), fields)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
