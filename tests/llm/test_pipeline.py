"""The pipeline's stages, each against brute force on what the one before it kept."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm.test_ngram_join import brute_components
from tests.llm.test_row_operators import brute_contamination, brute_spans

from ledgerline.llm import decontaminate


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(20)) for i in range(6)] + [(6, text(4))]
    docs, labels = [], []
    for i in range(500):
        words = text(rng.choice([30, 60, 120])).split()
        toxic = rng.random() < 0.3
        for insult in rng.sample(["scum", "clown", "idiot"], 2) if toxic else []:
            words.insert(rng.randrange(len(words)), insult)
        labels.append((i, 1, int(toxic)))
        docs.append(" ".join(words))
    for i in range(0, 60, 3):
        docs.append(docs[i] + " " + text(1))
        docs.append(text(10) + " " + items[i % 6][1] + " " + text(8))
        docs.append(text(30) + f' token="{rng.randrange(10**9):012d}" ' + text(5))
    docs += [None, "", "  ", docs[0]]
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t or ""), "extra") for i, t in enumerate(docs)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, predicted string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, items


def test_stages(spark, folder):
    at, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, at)
        if k < 4:
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{at}/stage{k}")
        docs = spark.read.parquet(f"{at}/stage{k}")
        kept.append(docs.collect())
    start, civil, single, clean, masked, mixed = kept
    insults = {"scum", "clown", "idiot"}
    assert {r.doc_id for r in civil} == {r.doc_id for r in start if not insults & set((r.text or "").split())}
    pairs = [(r.doc_id, r.text) for r in civil]
    assert {r.doc_id for r in single} == {c for _, _, c in brute_components(pairs, 5, 80)[0]}
    assert {r.doc_id for r in clean} == {r.doc_id for r in single if not brute_contamination(r.text, items)[-1]}
    assert len(clean) < len(single) < len(civil) < len(start)
    before = {r.doc_id: r for r in clean}
    assert {r.doc_id for r in masked} == set(before)
    for r in masked:
        assert not brute_spans(r.text) and (r.text == before[r.doc_id].text) == (not brute_spans(before[r.doc_id].text))
        assert r.n_chars == len(r.text or "")
    assert any("[secret]" in (r.text or "") for r in masked)
    assert {r.doc_id for r in mixed} == set(before)
    total = sum(r.size for r in mixed)
    assert sum(r.taken for r in mixed) == pytest.approx(1.5 * total, abs=4)


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.count() == spark.read.parquet(f"{folder[0]}/stage4").count()
    assert out.where(F.col("taken") > 2 * F.col("size")).isEmpty()


def test_large_benchmarks_filter_alike(spark, folder):
    at, items = folder
    docs, benchmark = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/benchmark.parquet")
    ways = [sorted(r.doc_id for r in decontaminate.keep_clean(docs, benchmark, n).collect()) for n in (1 << 30, -1)]
    assert ways[0] == ways[1] and len(ways[0]) < docs.count()
