"""Language-model scores against brute-force counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import lm

DOC = "doc_id bigint, text string, score double, part int"


def part(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "The"]
    follow = {w: rng.sample(vocabulary, 3) for w in vocabulary}

    def text():
        out = [rng.choice(vocabulary)]
        for _ in range(rng.randrange(60)):
            out.append(rng.choice(follow[out[-1]]) if rng.random() < 0.8 else rng.choice(vocabulary))
        return " ".join(out)

    rows = [(i, text()) for i in range(n)]
    return rows + [(None, "w1 w2"), (None, None), (n, ""), (n + 1, "new words here"), (n + 2, rows[0][1].upper()), (3, rows[3][1]), (n + 3, "w1 " * 30_000)]


def test_scores_equal_brute_force(spark):
    texts = corpus(1)
    docs = spark.createDataFrame([(i, t, 0.5, 9) for i, t in texts], DOC).repartition(4)
    out = lm.score(docs).collect()
    train = [tokens(t) for i, t in texts if part(i)]
    word = Counter(w for t in train for w in t)
    pair = Counter(p for t in train for p in zip([b" ", *t], t))
    context = Counter(word) | Counter({b" ": len(train)})
    n, v = sum(word.values()), len(word)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.held_out, r.train_tokens, round(r.base_score, 6)) for r in out)
    expect = sorted((str(i), len(tokens(t)), sum(word[w] > 0 for w in tokens(t)), part(i) == 0, n, round(sum(math.log10((word[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t in texts)
    assert got == expect
    # The model: weights from EM over the deleted part's own tokens, one by one.
    kept = [tokens(t) for i, t in texts if part(i) > 1]
    kword, kpair = Counter(w for t in kept for w in t), Counter(p for t in kept for p in zip([b" ", *t], t))
    kcontext = Counter(kword) | Counter({b" ": len(kept)})
    kn, kv = sum(kword.values()), len(kword)

    def estimates(u, w, words, pairs, contexts, n, v):
        return [pairs[u, w] / contexts[u] if contexts[u] else 0, words[w] / n, 1 / (v + 1)]

    rows = [(math.frexp(kcontext[u])[1], estimates(u, w, kword, kpair, kcontext, kn, kv)) for i, t in texts if part(i) == 1 for u, w in zip([b" ", *tokens(t)], tokens(t))]

    def em(p, start):
        weights = np.array(start)
        for _ in range(lm.STEPS):
            share = weights * p
            weights = (share / share.sum(1, keepdims=True)).mean(0)
        weights = np.maximum(weights, [1e-6 * (start[0] > 0), 1e-6, 1e-6])
        return weights / weights.sum()

    every = em(np.array([p for b, p in rows if b]), [1 / 3] * 3)
    learned = {b: em(np.array([p for x, p in rows if x == b]), [1 / 3] * 3 if b else [0, 0.5, 0.5]) for b in {b for b, _ in rows}}
    learned.setdefault(0, np.array([0, 0.5, 0.5]))
    total = {}
    for i, t in texts:
        s = sum(math.log10(learned.get(math.frexp(context[u])[1], every) @ estimates(u, w, word, pair, context, n, v)) for u, w in zip([b" ", *tokens(t)], tokens(t)))
        total.setdefault((str(i), len(tokens(t))), []).append(s)
    for r in out:
        assert any(r.score == pytest.approx(s, rel=2e-3, abs=2e-3) for s in total[str(r.doc_id), r.n_tokens])
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    """Over all words and the unseen one, for seen and unseen contexts."""
    rng = np.random.default_rng(0)
    logs = np.stack([rng.uniform(-5, 0, 300), rng.uniform(-9, -2, 300)])
    weights = lm.fit_weights(rng.integers(0, 5, 300), logs, rng.integers(1, 9, 300).astype(float), 100)
    assert np.allclose(weights.sum(1), 1) and weights[0, 0] == 0 and (weights >= 0).all()
    assert lm.bucket_of(np.array([0, 1, 2, 3, 4, 1 << 40])).tolist() == [0, 1, 2, 2, 3, lm.BUCKETS - 1]


def test_counts_beyond_32_bits():
    """An owner adds up blocks whose counts together pass 2**32, and answers with the whole sum."""
    keys = np.array([3, 9], np.uint64)
    rows = [{"owner": 0, "kind": "word", "block": b, "deleted": d, "keys": keys.tobytes(), "counts": lm._pack_counts(np.array(c))} for b, d, c in (("a", False, [2**32 - 1, 1]), ("b", True, [2**31 + 7, 0]), ("c", False, [2**52, 5]))]
    out = lm._answer(pa.Table.from_pylist(rows)).to_pylist()
    assert [lm._unpack_counts(r["total"]).tolist() for r in out[:3]] == [[2**52 + 2**32 + 2**31 + 6, 6]] * 3
    assert lm._unpack_counts(out[1]["kept"]).tolist() == [2**52 + 2**32 - 1, 6] and out[0]["kept"] is None
    assert out[3]["stats"] == [2**52 + 2**32 + 2**31 + 12, 2, 2**52 + 2**32 + 5, 2]
    for values in ([], [0], [255, 256], [2**63 - 1]):
        assert lm._unpack_counts(lm._pack_counts(np.array(values, np.int64))).tolist() == values


def test_small_and_empty_corpora(spark):
    docs = spark.createDataFrame([(i, t, 0.0, 0) for i, t in [(1, None), (2, "a b"), (3, "")]], DOC)
    rows = lm.score(docs).collect()
    assert len(rows) == 3 and all(math.isfinite(r.score) and math.isfinite(r.base_score) and r.score < 0.0 or r.n_tokens == 1 for r in rows)
    assert lm.score(docs.limit(0)).count() == 0
    none = next(i for i in range(50) if part(i) == 0)
    only = lm.score(spark.createDataFrame([(none, "a b c", 0.0, 0)], DOC)).first()
    assert (only.held_out, only.train_tokens, only.n_known, only.n_tokens) == (True, 0, 0, 4) and only.score == pytest.approx(0, abs=1e-6)
