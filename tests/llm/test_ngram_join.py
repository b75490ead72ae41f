"""The n-gram join and components against brute force, with and without dense groups."""

import random

import numpy as np
import pytest

from ledgerline.llm import ngram_join
from ledgerline.llm.components import components

DOC = "doc_id bigint, text string, component_id string, n int, key string"


def brute_sets(texts, words):
    out = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def brute_components(texts, words, percent):
    sets = brute_sets(texts, words)
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for i, (d, _) in enumerate(texts):
        ids = [texts[j][0] for j in groups[root(i)] if texts[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return out, groups


def corpus(seed):
    """Plain texts, exact and near copies, a large group of near copies, a common passage, odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = text(25), text(140)
    out = [text(rng.choice([1, 2, 3, 8, 60, 150])) for _ in range(60)]
    out += [text(30) + passage + text(30) for _ in range(25)] + [passage + text(1) for _ in range(12)]

    def edited(words, edits):
        words = list(words)
        for _ in range(edits):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.choice([0, 1, 1, 2])] = text(rng.choice([0, 1, 1]))
        return words

    out += [edited(base, rng.randrange(0, 9)) for _ in range(70)]
    for _ in range(10):
        near = rng.choice(out[:60])
        out += [edited(near, rng.randrange(0, 4)) for _ in range(rng.randrange(1, 6))]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(w)) for i, w in enumerate(out)]
    rng.shuffle(rows)
    rows += [(1000 + i, rng.choice(rows)[1].upper()) for i in range(20)]
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, ""), (None, rows[0][1]), (None, "null id only here today"), (5, rows[1][1]), (5, rows[1][1]), (2004, "é è"), (2005, "É è"), (2006, "long " * 20_000)]


@pytest.mark.parametrize(("words", "percent", "light"), [(3, 90, 32), (3, 90, 4), (5, 80, 8)])
def test_components_equal_brute_force(spark, words, percent, light):
    texts = corpus(words * light)
    docs = spark.createDataFrame([(i, t, "c", 1, "k") for i, t in texts], DOC).repartition(5)
    got = sorted(map(str, (tuple(r) for r in ngram_join.join(docs, ngram_join.Rule(words, percent, light)).collect())))
    assert got == sorted(map(str, brute_components(texts, words, percent)[0]))


def test_one_of_each_group_stays(spark):
    texts = corpus(99)
    docs = spark.createDataFrame([(i, t, "c", 1, "k") for i, t in texts], DOC).repartition(3)
    out = ngram_join.keep_one(docs, ngram_join.Rule(5, 80, 6))
    assert out.columns == docs.columns
    _, groups = brute_components(texts, 5, 80)
    key = lambda i: (texts[i][0] is None, texts[i][0] or 0, texts[i][1] or "")
    expect = [texts[min(g, key=key)][0] for g in groups.values()]
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, expect))


def near_copies(seed, n):
    """A group without its original: copies of 150 words with one to six edits each, half of them of a second version."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    other = base[:40] + [f"c{i}" for i in range(20)] + base[60:]
    out = []
    for i in range(n):
        words = list(rng.choice([base, base, other]))
        for _ in range(rng.choice([1, 2, 2, 3, 3, 3, 4, 6]) + 1):
            words[rng.randrange(150)] = f"x{rng.randrange(10**9)}" if rng.random() < 0.9 else "common"
        out.append((i, " ".join(words[: rng.choice([150, 150, 140])])))
    return out


@pytest.mark.parametrize(("words", "percent"), [(5, 80), (3, 90)])
def test_large_group_of_near_copies_of_which_many_are_unlinked(spark, words, percent):
    texts = near_copies(words, 2500)
    sets = brute_sets(texts, words)
    numbers = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    marks = np.zeros((len(sets), len(numbers)), np.float32)
    for i, s in enumerate(sets):
        marks[i, [numbers[x] for x in s]] = 1
    both = marks @ marks.T
    sizes = marks.sum(1)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None] - both)
    label = np.arange(len(sets))
    while (new := np.array([label[linked[i]].min() for i in range(len(sets))])).tolist() != label.tolist():
        label = new
    assert 200 < len(set(label.tolist())) < 2400
    docs = spark.createDataFrame([(i, t, "c", 1, "k") for i, t in texts], DOC).repartition(5)
    got = {r.doc_id: r.component_id for r in ngram_join.join(docs, ngram_join.Rule(words, percent)).collect()}
    assert got == dict(enumerate(label.tolist()))


def test_empty_table(spark):
    none = spark.createDataFrame([], DOC)
    assert ngram_join.join(none).count() == 0 and ngram_join.keep_one(none, ngram_join.Rule()).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300), (300, 302)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, **dict.fromkeys(range(300, 303), 300)}
