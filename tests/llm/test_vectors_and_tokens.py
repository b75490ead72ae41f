"""Operators 11, 12 and 13 against brute force and exact round trips."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import bitplanes, huffman, token_files, vector_codes

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = "vec_id bigint, embedding array<double>, label int"


def usable(vector, size=None):
    return vector is not None and (size is None or len(vector) == size) and all(x is not None and math.isfinite(x) for x in vector)


def odd_rows(size=64):
    return [(900, None, 1), (901, [0.5] * (size - 1), 1), (902, [None] + [0.5] * (size - 1), None), (903, [math.nan] * size, 2), (904, [0.5] * (size - 1) + [math.inf], 2), (905, [], 3)]


def brute_clusters(rows, centroids, rounds, scale=64, size=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if usable(v, size)]
    rank = lambda r: hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    at = [v for _, v in sorted(kept, key=rank)[:centroids]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        best = [min((far(v, c), k) for k, c in enumerate(at)) for _, v in kept]
        if turn < rounds:
            groups = [[v for (_, v), (_, b) in zip(kept, best, strict=True) if b == k] for k in range(len(at))]
            at = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else at[k] for k, g in enumerate(groups)]
    own = [sum(d for d, k in best if k == j) for j in range(len(at))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(str((i, k, d, own[k], sum(own), sha[k])) for (i, _), (d, k) in zip(kept, best, strict=True))


def found_clusters(spark, rows, **kw):
    df = spark.createDataFrame(rows, WHOLE).repartition(3)
    return sorted(str(tuple(r)) for r in bitplanes.assign(bitplanes.fit(df, **kw)).collect())


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 64).tolist(), 0) for i in range(150)]
    rows += [(200 + i, rows[5][1], 0) for i in range(20)]  # copies: several first centroids may be equal
    rows += [(300, [1000.5] * 64, 0), (301, [-1000.5] * 64, 0), (302, [0.0] * 64, 0), (None, rows[7][1], 0), (5, rows[5][1], 0), *odd_rows()]
    for centroids, rounds in ((16, 3), (5, 1), (200, 2), (3, 0)):
        assert found_clusters(spark, rows, centroids=centroids, rounds=rounds) == brute_clusters(rows, centroids, rounds)
    few = [(i, [float(i % 2)] * 64, 0) for i in range(6)]  # ties only
    assert found_clusters(spark, few) == brute_clusters(few, 16, 3)
    wide = [(i, rng.integers(-3, 3, 70).astype(float).tolist(), 0) for i in range(60)]  # two words a plane
    assert found_clusters(spark, wide, size=70, centroids=4) == brute_clusters(wide, 4, 3, 64, 70)
    assert found_clusters(spark, odd_rows()) == [] == found_clusters(spark, [])


def test_clusters_refuse_what_does_not_fit(spark):
    with pytest.raises(Exception, match="64 bits"):
        found_clusters(spark, [(1, [3e6] * 64, 0)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**27) + 1, 2**27 - 1), min_size=5, max_size=5), min_size=1, max_size=6))
def test_planes_are_exact(rows):
    x = np.array(rows, np.int64)
    planes = bitplanes.pack(x)
    assert planes.shape[1] <= 28 and (bitplanes.squares(planes) == (x * x).sum(1)).all()
    assert (bitplanes.dots(planes, planes[0]) == x @ x[0]).all() and (bitplanes.plane_sums(planes, 5) == x.sum(0)).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 3), st.integers(1, 50), st.integers(0, 2**32 - 1))
def test_orchard_search_is_exact(entries, width, spread, seed):
    rng = np.random.default_rng(seed)
    book = rng.integers(-spread, spread + 1, (entries, width))
    x = rng.integers(-spread, spread + 1, (40, width))
    index, distance = vector_codes.Codebook(book).nearest(x, 17)
    whole = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (index == whole.argmin(1)).all() and (distance == whole.min(1)).all()


def test_orchard_search_measures_few_entries():
    rng = np.random.default_rng(0)
    book = rng.integers(-10_000, 10_000, (256, 2))
    x = book[rng.integers(0, 256, 1000)] + rng.integers(-30, 30, (1000, 2))
    assert vector_codes.Codebook(book)._walk(x)[2] < 40 * 1000


def brute_codes(rows, parts, entries, rounds, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if usable(v)]
    fits = sorted((r for r in kept if r[1] and len(r[1]) % parts == 0), key=lambda r: (r[0] is None, r[0] or 0))
    size = len(fits[0][1]) if fits else 0
    fits, w = [r for r in fits if len(r[1]) == size], size // parts
    cut = lambda v: [tuple(v[p * w : (p + 1) * w]) for p in range(parts)]
    books = [[cut(r[1])[p] for r in fits[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        best = [[min((far(x, e), k) for k, e in enumerate(books[p])) for p, x in enumerate(cut(r[1]))] for r in fits]
        for p in range(parts if turn < rounds else 0):
            groups = [[cut(r[1])[p] for r, b in zip(fits, best, strict=True) if b[p][1] == k] for k in range(len(books[p]))]
            books[p] = [tuple(sum(c) // len(g) for c in zip(*g, strict=True)) if g else books[p][k] for k, g in enumerate(groups)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(r[0], "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b), r[2]) for r, b in zip(fits, best, strict=True)]
    out += [(r[0], None, None, r[2]) for r in kept if len(r[1]) != size or not size]
    total = {label: [e for *_, e, own in out if own == label and e is not None] for label in {r[3] for r in out}}
    return sorted(str((i, c, e, sum(total[label]) if total[label] else None, sha)) for i, c, e, label in out)


def found_codes(spark, rows, kind="int", **kw):
    df = spark.createDataFrame(rows, WHOLE.replace("label int", f"label {kind}")).repartition(3)
    return sorted(str(tuple(r)) for r in vector_codes.compress(df, **kw).collect())


def test_codes_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 16).tolist(), [None, 1, 2][i % 3]) for i in range(120)]
    rows += [(200 + i, rows[3][1], 7) for i in range(30)] + [(3, rows[3][1], 7), (None, rows[4][1], None), *odd_rows(16)]
    for entries, rounds in ((20, 4), (256, 1), (1, 2), (7, 0)):
        assert found_codes(spark, rows, entries=entries, rounds=rounds) == brute_codes(rows, 4, entries, rounds)
    whole = [(i, [float(i % 3)] * 8, i % 5) for i in range(30)]  # ties only
    assert found_codes(spark, whole, parts=2) == brute_codes(whole, 2, 256, 4)
    assert found_codes(spark, [], parts=4) == [] == found_codes(spark, odd_rows(16)[:1])
    assert found_codes(spark, [(1, [], 1), (2, [1.0], None)]) == brute_codes([(1, [], 1), (2, [1.0], None)], 4, 256, 4)
    expect = brute_codes(rows, 4, 20, 2)
    for share in (0.05, 0.3, 1.0):  # some labels by broadcast, some by a join; all by a join
        monkeypatch.setattr(vector_codes, "SHARE", share)
        assert found_codes(spark, rows, entries=20, rounds=2) == expect


def test_vector_operators_read_no_other_columns(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(0, 0.2, 64).tolist(), i % 3) for i in range(40)], WHOLE)
    clashing = df.withColumns({c: F.lit("own") for c in ("id", "numbers", "planes", "cluster", "vector", "code", "error", "hot", "n", "label_error", "rare", "distance")})
    for run in (lambda d: bitplanes.assign(bitplanes.fit(d)), vector_codes.compress):
        assert sorted(map(str, run(df).collect())) == sorted(map(str, run(clashing).collect()))


def cost_without_limit(counts):
    import heapq

    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=60), st.integers(1, 12), st.integers(0, 2**32 - 1), st.integers(0, 700))
def test_code_is_complete_limited_and_round_trips(counts, limit, seed, size):
    lengths = huffman.code_lengths(np.array(counts, np.int64), limit)
    used = [c for c in counts if c]
    assert all((n > 0) == (c > 0) for n, c in zip(lengths, counts, strict=True))
    assert lengths.max(initial=0) <= max(limit, (len(used) - 1).bit_length(), 1)
    if len(used) > 1:
        assert sum(2.0 ** -int(n) for n in lengths if n) == 1.0
        free = huffman.code_lengths(np.array(counts, np.int64), 60)
        assert sum(int(n) * c for n, c in zip(free, counts, strict=True)) == cost_without_limit(counts)
    if used:
        code = huffman.Code(lengths)
        ids = np.random.default_rng(seed).choice(np.flatnonzero(counts), size).astype(np.uint32)
        data = token_files.block_bytes(code, ids)
        for back in token_files.decode_blocks(code, [data, token_files.block_bytes(code, ids[:1]), data])[::2]:
            assert (back == ids).all()


def test_damaged_block_is_noticed():
    code = huffman.Code(np.array([1, 2, 2]))
    data = bytearray(token_files.block_bytes(code, np.arange(3, dtype=np.uint32)))
    data[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.decode_blocks(code, [bytes(data)])


ODD_TEXTS = [
    None, "", " \n\t", "a<|endoftext|>b <|startoftext|> <|endoftext|>", "é ́x   y　z\x1cw\x85v", "İSTANBUL ΣΊΣΥΦΟΣ Σ. it's we'LL 'S x'd 12 345", "\x00 \x7f ￿ 😀👍🏽 a‍b",
    "x" * 30_000, "1:\"'--''s", "ﬁ ﷺ 가각 가", "Å \r\f\v ok", "word " * 70_000,
]


def whole_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def check_files(spark, folder, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("own") for c in ("at", "n", "ids", "crc", "file", "start")})
    token_files.write(docs.repartition(5), folder, PATH, **kw)
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in token_files.read(spark, folder).collect()]
    expect, start = [], 0
    raw = [(i, np.array(whole_ids(t), "<u4").tobytes()) for i, t in rows]
    for i, ids in sorted(raw, key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32(np.frombuffer(r[1], "<u4").astype("<u2").tobytes()))):
        expect.append((i, start, len(ids) // 4, ids))
        start += len(ids) // 4
    assert sorted(map(str, got)) == sorted(map(str, expect))


@pytest.mark.parametrize("apart", [True, False])
def test_token_files_round_trip(spark, tmp_path, apart, monkeypatch):
    rows = [(i * 3 % 13, t) for i, t in enumerate(ODD_TEXTS)] + [(5, "again"), (5, "again"), (5, "other"), (None, "no id"), (-7, "first")]
    check_files(spark, str(tmp_path / "t"), rows, words_apart=apart)
    blocks = spark.read.parquet(str(tmp_path / "t/blocks"))
    assert blocks.agg(F.max(F.size("doc_ids"))).first()[0] > 1 and blocks.where(F.col("n") > token_files.BLOCK).count() == 1
    check_files(spark, str(tmp_path / "none"), [], words_apart=apart)
    check_files(spark, str(tmp_path / "short"), rows, limit=1)


def test_words_are_remembered_within_bounds():
    words = token_files._Words(PATH, "<u2", 10)
    text = " ".join(f"w{i % 37} v{i} Word{'abc'[i % 3]}, and" for i in range(500))
    for _ in range(2):
        assert np.frombuffer(words.text(text.encode()), "<u2").tolist() == whole_ids(text)[:-1]
        assert len(words) <= 13 and len(words.old) <= 13


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("aeA'sStT ll<|>́̊  \n0.12Σ", max_size=40))
def test_words_apart_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(token_files._words_of(PATH, "<u2").text(text.encode()), "<u2").tolist() == whole_ids(text)[:-1]
