"""Media: exact round trips, and a brute-force encoder whose files take the general path."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from ledgerline.llm import common, media, queries
from ledgerline.operators import store


@pytest.mark.parametrize("n", [0, 1, 64, 65, 384, 385, 3000, 200_000])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for text in (rng.integers(0, 256, n, np.uint8).tobytes(), b"\xff" * n, bytes(n)):
        payload = media.pad(text)
        assert len(payload) % 64 == 0 and payload[:n] == text and len(payload) - n < 65 and payload
        image = media.decode(media.encode(payload))
        assert media.payload_of(image) == payload
        assert media.rgb(image).shape == (image.height, image.width, 3)


def test_symbol_reader_agrees_with_fixed_strides(monkeypatch):
    files = [media.encode(media.pad(np.random.default_rng(s).integers(0, 256, 700, np.uint8).tobytes())) for s in range(3)]
    fast = [media.decode(f) for f in files]
    monkeypatch.setattr(media, "_read_scan", lambda image, chosen, tables, restart, *rest: media._read_symbols(image, chosen, tables, restart, *rest))
    for a, b in zip(fast, map(media.decode, files)):
        assert all((x.levels == y.levels).all() for x, y in zip(a.components, b.components))


class Writer:
    """Symbols in eight-bit codes: symbol s has code s, 255 isn't used."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def signed(self, value):
        size = abs(int(value)).bit_length()
        return size, (value if value > 0 else value + (1 << size) - 1)

    def bytes(self):
        out = np.packbits(np.array(self.bits + [1] * (-len(self.bits) % 8), np.uint8)).tobytes()
        return out.replace(b"\xff", b"\xff\0")


def brute_file(levels, width, height):
    """A grey file: interleaving none; DC with Al=1, AC 1-63 with Al=1, then refinements, with runs of EOB."""
    full = media._marker
    table = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))
    parts = [b"\xff\xd8", full(0xDB, bytes([0, *range(1, 65)])), full(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])), full(0xC4, bytes([0]) + table), full(0xC4, bytes([0x10]) + table)]
    w, last = Writer(), 0
    for b in levels:
        size, raw = w.signed((b[0] >> 1) - last)
        w.put(size, 8)
        w.put(raw, size)
        last = b[0] >> 1
    parts += [media._scan(1, 0, 0, 0, 1), w.bytes()]
    cut = [[(abs(int(x)) >> 1) * (1 if x > 0 else -1) for x in b] for b in levels]
    w, run = Writer(), 0

    def flush(corrections=()):
        nonlocal run
        if run:
            n = run.bit_length() - 1
            w.put(n << 4, 8)
            w.put(run - (1 << n), n)
            run = 0
        for c in corrections:
            w.put(c, 1)

    for b in cut:
        zeros = 0
        for k in range(1, 64):
            if not b[k]:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                w.put(0xF0, 8)
                zeros -= 16
            size, raw = w.signed(b[k])
            w.put(zeros << 4 | size, 8)
            w.put(raw, size)
            zeros = 0
        run += zeros > 0
    flush()
    parts += [media._scan(1, 1, 63, 0, 1), w.bytes()]
    w = Writer()
    for b in levels:
        w.put(b[0] & 1, 1)
    parts += [media._scan(1, 0, 0, 1, 0), w.bytes()]
    w, run, pending = Writer(), 0, []
    for b, old in zip(levels, cut):
        new_at = [k for k in range(1, 64) if not old[k] and b[k]]
        zeros, corrections = 0, []
        for k in range(1, 64):
            if old[k]:
                corrections.append(abs(int(b[k])) & 1)
            elif not b[k]:
                zeros += 1
                if zeros == 16 and new_at and k < new_at[-1]:
                    flush(pending)
                    pending = []
                    w.put(0xF0, 8)
                    [w.put(c, 1) for c in corrections]
                    zeros, corrections = 0, []
            else:
                flush(pending)
                pending = []
                w.put(zeros << 4 | 1, 8)
                w.put(b[k] > 0, 1)
                [w.put(c, 1) for c in corrections]
                zeros, corrections = 0, []
        if zeros or corrections:
            run += 1
            pending += corrections
        if run == 3:
            flush(pending)
            pending = []
    flush(pending)
    parts += [media._scan(1, 1, 63, 1, 0), w.bytes(), b"\xff\xd9"]
    return b"".join(map(bytes, parts))


def test_general_files_and_inverse_transform():
    rng = random.Random(6)
    levels = np.zeros((12, 64), np.int64)
    for b in levels:
        b[0] = rng.randrange(-600, 600)
        for k in rng.sample(range(1, 64), rng.choice([0, 0, 3, 30])):
            b[k] = rng.randrange(-90, 90)
    image = media.decode(brute_file(levels, 30, 20))
    assert (image.components[0].levels.reshape(-1, 64) == levels).all()
    out = media.rgb(image)
    assert out.shape == (20, 30, 3)
    block = np.zeros((8, 8))
    for z, place in enumerate(media.zigzag()):
        u, v = divmod(int(place), 8)
        for r in range(8):
            for c in range(8):
                s = (np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1) / 4
                block[r, c] += s * levels[0][z] * (z + 1) * np.cos((2 * r + 1) * u * np.pi / 16) * np.cos((2 * c + 1) * v * np.pi / 16)
    assert np.abs(out[:8, :8, 0] - np.clip(block + 128, 0, 255)).max() <= 0.51
    assert media.zigzag()[:6].tolist() == [0, 1, 8, 16, 9, 2]
    with pytest.raises((ValueError, IndexError)):
        media.decode(b"no picture")


def brute_tensor(payload):
    """The RGB tensor of a stored payload of at most 384 bytes, sample by sample."""
    blocks = [payload[i : i + 64] for i in range(0, len(payload), 64)] + [bytes(64)] * (6 - len(payload) // 64)
    order = [int(x) for x in media.zigzag()]

    def samples(block):
        level = {p: (256 + v if z == 0 else v if v >= 128 else v - 255) for z, (p, v) in enumerate(zip(order, block))}
        scale = lambda u: np.sqrt(0.5) if u == 0 else 1.0
        wave = lambda x, u: np.cos((2 * x + 1) * u * np.pi / 16)
        return np.array([[sum(scale(p // 8) * scale(p % 8) / 4 * v * wave(r, p // 8) * wave(c, p % 8) for p, v in level.items()) + 128 for c in range(8)] for r in range(8)])

    planes = [samples(b) for b in blocks]
    out = np.zeros((16, 16, 3))
    for r in range(16):
        for c in range(16):
            y = planes[r // 8 * 2 + c // 8][r % 8, c % 8]
            cb, cr = (p[r // 2, c // 2] - 128 for p in planes[4:])
            out[r, c] = y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb
    return np.clip(np.rint(out), 0, 255)


@pytest.mark.parametrize("text", [b"", b"abc def " * 30, bytes(range(64, 192)) * 3])
def test_tensor_and_feature_equal_sample_by_sample_sums(text):
    payload = media.pad(text)
    tensor = media.rgb(media.decode(media.encode(payload)))
    expect = brute_tensor(payload)
    if len(payload) <= 64:
        assert tensor.shape == (16, 16, 3)
    assert np.abs(tensor - expect).max() <= 1 and (tensor != expect).mean() < 0.01
    size, mean, shares = media.feature(tensor).split(":")
    assert size == "16x16"
    assert [float(x) for x in mean.split(",")] == pytest.approx(expect.mean((0, 1)), abs=0.02)
    counts = [sum(32 * k <= g < 32 * k + 32 for g in expect[:, :, 1].reshape(-1)) for k in range(8)]
    assert [int(x) for x in shares.split(",")] == pytest.approx([n * 1000 // 256 for n in counts], abs=8)


def test_columns(spark, tmp_path):
    texts = [(1, "abc"), (2, None), (3, ""), (None, "é" * 40_000), (1, "abc"), (4, "x" * 64)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], "doc_id bigint, text string, media string, n_bytes int")
    rows = media.describe(media.write(docs, str(tmp_path / "files"), with_tensors=False)).collect()
    assert len(rows) == len(texts)
    for r, (i, t) in zip(sorted(rows, key=lambda r: (str(r.doc_id), r.n_bytes)), sorted(texts, key=lambda x: (str(x[0]), len((x[1] or "").encode())))):
        payload = media.pad((t or "").encode())
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len((t or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    kept = media.write(docs, str(tmp_path / "both")).collect()
    assert sorted((len(m.media), hashlib.sha256(m.media).hexdigest()) for m in kept) == sorted((r.media_bytes, r.media_sha256) for r in rows)
    for m in kept:
        assert np.frombuffer(m.rgb, np.uint8).reshape(m.height, m.width, 3).tolist() == media.rgb(media.decode(m.media)).tolist()
    assert media.describe(media.write(docs.limit(0), str(tmp_path / "none"))).count() == 0


def test_query_stores_the_tensor_of_every_file(spark, tmp_path, monkeypatch):
    common.clear_scratch(spark)
    monkeypatch.setattr(store, "scratch_dir", lambda spark: str(tmp_path))
    texts = [(1, "abc"), (2, None), (3, ""), (None, "é" * 40_000), (1, "abc"), (4, "x" * 64), (5, "words of a text " * 999)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/in/documents.parquet")
    result = queries.op9_media(spark, f"{tmp_path}/in")
    at = next(str(p) for p in tmp_path.iterdir() if p.name != "in")
    files, stored = (spark.read.parquet(f"{at}/{x}").collect() for x in ("files", "tensors"))
    expect = [media.rgb(media.decode(m.media)) for m in files]
    assert len(stored) == len(texts)
    assert sorted((m.height, m.width, bytes(m.rgb)) for m in stored) == sorted((*t.shape[:2], t.tobytes()) for t in expect)
    rows = result.collect()
    assert sorted(r.feature for r in rows) == sorted(map(media.feature, expect))
    assert sorted(map(str, rows)) == sorted(map(str, media.describe(spark.read.parquet(f"{at}/files")).collect()))
    common.clear_scratch(spark)


def test_features_are_those_of_the_stored_tensors(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abc"), (2, "é" * 999)], "doc_id bigint, text string")
    files = media.write(docs, str(tmp_path / "files"), with_tensors=False)
    kept = media.keep(files, str(tmp_path / "tensors"))
    black = kept.withColumn("rgb", F.expr("unhex(repeat('00', length(rgb)))"))
    assert [r.feature.split(":", 1)[1] for r in media.features(black).collect()] == ["0.00,0.00,0.00:1000,0,0,0,0,0,0,0"] * 2
    with pytest.raises(Exception, match="reshape"):
        media.features(kept.withColumn("rgb", F.expr("substring(rgb, 2)"))).collect()
    nothing = media.keep(files.limit(0), str(tmp_path / "none"))
    assert nothing.columns == kept.columns and media.features(nothing).columns == media.describe(files).columns
    assert media.features(nothing).count() == 0


def test_tensors_lie_in_row_groups_of_bounded_rows(spark, tmp_path):
    docs = spark.range(0, 1300, 1, 1).selectExpr("id as doc_id", "'abc' as text")
    media.keep(media.write(docs, str(tmp_path / "files"), with_tensors=False).coalesce(1), str(tmp_path / "tensors"))
    found = [pq.ParquetFile(p).metadata for p in (tmp_path / "tensors").glob("*.parquet")]
    assert sorted(m.row_group(i).num_rows for m in found for i in range(m.num_row_groups)) == [276, 512, 512]
