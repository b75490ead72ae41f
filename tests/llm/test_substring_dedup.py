"""Substring deduplication against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from ledgerline.llm import substring_dedup

DOC = "doc_id bigint, text string, start int, n_words int, k1 string"


def brute(texts, words):
    split = [(t or "").encode().split() for _, t in texts]
    seen = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    out = []
    for (d, _), w in zip(texts, split):
        gone = set()
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i : i + words])] > 1:
                gone |= set(range(i, i + words))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "Wort", "w1"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, long = text(60), text(35)
    out = [text(rng.choice([0, 1, 34, 35, 36, 90, 200])) for _ in range(50)]
    out += [text(rng.randrange(40)) + passage + text(rng.randrange(40)) for _ in range(100)]  # more than HOT texts
    out += [text(20) + long + text(20), text(3) + long, long + text(9), text(20) + long[:-1] + text(20)]
    out += [["same"] * 500, ["same"] * 34, ["a", "b"] * 40, text(50) + ["x", "y", "z"] * 30 + text(5)]
    inside = text(40)
    out.append(inside + text(30) + inside)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(w)) for i, w in enumerate(out)]
    rng.shuffle(rows)
    rows += [(1000 + i, rng.choice(rows)[1]) for i in range(25)]
    return rows + [(None, None), (2000, ""), (2001, "  "), (None, rows[0][1] + " end"), (5, rows[3][1]), (5, rows[3][1]), (2002, "long " + " ".join(text(30_000)))]


@pytest.mark.parametrize(("words", "parts"), [(35, 6), (35, 1), (5, 3)])
def test_removal_equals_brute_force(spark, words, parts):
    texts = corpus(words + parts)
    docs = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in texts], DOC).repartition(parts)
    got = sorted(map(str, (tuple(r) for r in substring_dedup.deduplicate(docs, words).collect())))
    assert got == sorted(map(str, brute(texts, words)))


@pytest.fixture
def apart(spark):
    """Many partitions: in a few, rows with different routes meet by chance."""
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("copies", "lone"), [(3, 1), (3, 0), (1, 3), (70, 3)])
def test_a_minimiser_is_hot_or_not_in_all_batches(spark, apart, copies, lone):
    """A passage in all batches; another one once in the first and once in the last batch."""
    rng = random.Random(copies)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    gram, passage = text(8), text(60)
    passage[26:34] = gram
    variant = [*text(24), *gram, *text(24)]  # may share minimisers with the passage
    size = max(copies, lone) + 3
    batch = lambda n, other: [*[text(5) + passage + text(5) for _ in range(n)], *[text(5) + variant + text(5)] * other, *[text(60) for _ in range(size)]][:size]
    parts = [batch(copies, i == 0) for i in range(30)] + [batch(lone, 1)]
    texts = [(i, " ".join(w)) for i, w in enumerate(w for p in parts for w in p)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(i, t, 1, 2, "k") for i, t in texts], len(parts)), DOC)
    got = sorted(map(str, (tuple(r) for r in substring_dedup.deduplicate(docs).collect())))
    assert got == sorted(map(str, brute(texts, 35)))


def test_empty_table(spark):
    assert substring_dedup.deduplicate(spark.createDataFrame([], DOC)).count() == 0
