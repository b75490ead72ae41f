"""Every operator and every stage of the pipeline on odd tables: clashing columns, nulls, repeated rows, no rows."""

import threading

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import common, decontaminate, lm, media, mixing, ngram_join, pii, queries, secret_scan, substring_dedup, token_files, toxicity, warc
from ledgerline.operators import store

LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, LONG), (2, LONG), (2, LONG), (3, LONG + " more"), (4, None), (5, ""), (6, " \n"), (None, LONG), (None, None), (7, 'token="abcdef012345" 4111111111111111'),
    (8, "scum folk " * 20), (9, "x" * 100_000), (10, " ".join(f"v{i % 50}" for i in range(20_000))), (11, " ".join(f"i{i}" for i in range(20))), (11, "another text"),
]
#: Names that operators use inside, some in another case.
CLASHES = [
    "row", "NTH", "key", "place", "_key", "_name", "_place", "_nth", "node", "n", "shingles", "component", "predicted", "score", "spans", "found", "_found", "k1", "k2", "part",
    "size", "target", "taken", "position", "kind", "weight", "payload", "media", "n_bytes", "contaminated", "n_words", "n_hit", "lengths", "print", "label", "url_", "turn", "batch", "start", "at",
]


def docs_of(spark, texts, clashes, n_chars="bigint"):
    base = spark.createDataFrame([(i, t, "en", None if i == 3 else "ab"[(i or 0) % 2]) for i, t in texts], "doc_id bigint, text string, lang string, source string")
    base = base.withColumn("n_chars", F.lit("three").cast(n_chars) if n_chars == "string" else F.length("text").cast(n_chars))
    return base.withColumns({c: F.lit(f"own {c}") for c in CLASHES} if clashes else {})


def benchmark_of(spark):
    rows = [(1, TEXTS[-2][1], "x"), (2, None, "x"), (None, "another text", "x"), (1, TEXTS[-2][1], "x"), (3, "", None)]
    return spark.createDataFrame(rows, "item_id bigint, text string, key string")


def labels_of(spark, rows=((1, 1), (2, 0), (2, None), (None, 1), (8, 1), (9, 0))):
    return spark.createDataFrame(list(rows), "doc_id bigint, toxic int").withColumn("label", F.lit("own"))


def through_warc(spark, docs, tmp):
    pages = docs.withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "url"})
    folder = str(tmp / f"warc{docs.count()}-{len(docs.columns)}")
    warc.write(pages, folder)
    return warc.read(spark, folder)


def through_token_files(spark, docs, tmp):
    folder = str(tmp / f"tokens{docs.count()}-{len(docs.columns)}")
    token_files.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, folder)


OPERATORS = {
    "secret scan": lambda spark, docs, tmp: secret_scan.scan(docs),
    "mixing": lambda spark, docs, tmp: mixing.plan(docs),
    "warc": through_warc,
    "n-gram join": lambda spark, docs, tmp: ngram_join.join(docs),
    "personal data": lambda spark, docs, tmp: pii.pseudonymize(docs, "k"),
    "decontamination": lambda spark, docs, tmp: decontaminate.decontaminate(docs, benchmark_of(spark)),
    "decontamination, large": lambda spark, docs, tmp: decontaminate.decontaminate(docs, benchmark_of(spark), -1),
    "substring dedup": lambda spark, docs, tmp: substring_dedup.deduplicate(docs),
    "language model": lambda spark, docs, tmp: lm.score(docs),
    "media": lambda spark, docs, tmp: media.describe(media.store(docs)),
    "token files": through_token_files,
    "toxicity": lambda spark, docs, tmp: toxicity.score(docs, toxicity.fit(docs, labels_of(spark), "toxic")),
}


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_reads_no_other_columns_and_takes_empty_tables(spark, tmp_path, name):
    run = OPERATORS[name]
    plain, clashing = (docs_of(spark, TEXTS, clash).repartition(3) for clash in (False, True))
    out = run(spark, plain, tmp_path)
    assert rows_of(out) == rows_of(run(spark, clashing, tmp_path)) and out.count() == len(TEXTS)
    none = run(spark, clashing.limit(0), tmp_path)
    assert none.columns == out.columns and none.count() == 0


@pytest.mark.parametrize("place", range(4))
@pytest.mark.parametrize("large", [False, True])
def test_stage_keeps_columns(spark, tmp_path, place, large, monkeypatch):
    """A stage gives back rows of its input, all columns; only the text and n_chars change, where secrets are."""
    if large and place != 2:
        pytest.skip("one way only")
    at = str(tmp_path)
    labels_of(spark).write.parquet(f"{at}/labels.parquet")
    benchmark_of(spark).write.parquet(f"{at}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[place][1]
    if large:
        stage = lambda spark, docs, at: decontaminate.keep_clean(docs, benchmark_of(spark), -1)
    for n_chars in ("bigint", "string"):
        docs = docs_of(spark, TEXTS, True, n_chars).repartition(3)
        out = stage(spark, docs, at)
        assert out.schema.simpleString() == docs.schema.simpleString()
        got, whole = rows_of(out.drop("text", "n_chars")), rows_of(docs.drop("text", "n_chars"))
        assert all(got.count(r) <= whole.count(r) for r in set(got))
        expect = {0: None, 1: len(TEXTS) - 4, 2: len(TEXTS) - 2, 3: len(TEXTS)}[place]
        assert expect is None or len(got) == expect
        if place == 3:
            masked = {r.doc_id: r for r in out.collect()}[7]
            assert "[secret]" in masked.text and masked.n_chars == ("three" if n_chars == "string" else len(masked.text))
        assert stage(spark, docs.limit(0), at).count() == 0


def test_pipeline_takes_empty_tables_and_clashing_columns(spark, tmp_path):
    at = {}
    for name, texts in (("some", TEXTS), ("none", [])):
        at[name] = str(tmp_path / name)
        docs_of(spark, TEXTS, True).limit(len(texts)).write.parquet(f"{at[name]}/documents.parquet")
        labels_of(spark, [(8, 1), *((i, 0) for i in (1, 2, 3, 4, 5, 7, 9, 10))]).limit(len(texts)).write.parquet(f"{at[name]}/labels.parquet")
        benchmark_of(spark).limit(len(texts)).write.parquet(f"{at[name]}/benchmark.parquet")
    some, none = (corpus_pipeline.run(spark, at[k]) for k in ("some", "none"))
    assert 0 < some.count() < len(TEXTS) and none.count() == 0 and some.columns == none.columns


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    """Only the tables that the result reads outlive an n-gram join; clear_scratch deletes them as well."""
    common.clear_scratch(spark)
    monkeypatch.setattr(store, "scratch_dir", lambda spark: str(tmp_path))
    out = ngram_join.join(docs_of(spark, TEXTS, False))
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"shingles", "classes", "labels"}
    assert out.count() == len(TEXTS)
    common.clear_scratch(spark)
    assert not list(tmp_path.iterdir())


def test_threads_keep_their_scratch_tables(spark):
    """What another thread makes while a block is open isn't the block's to delete."""
    opened, made, found = threading.Event(), threading.Event(), []

    def other():
        opened.wait(60)
        found.append(common.materialize(spark.range(5), "other"))
        made.set()

    thread = threading.Thread(target=other)
    thread.start()
    with common.temporary(spark) as keep:
        opened.set()
        made.wait(60)
        gone, stays = common.materialize(spark.range(3), "gone"), keep(common.materialize(spark.range(4), "stays"))
    thread.join()
    assert found[0].count() == 5 and stays.count() == 4
    with pytest.raises(Exception):
        gone.count()


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.startswith(("op3", "op9", "op11", "op12", "op13"))])
def test_queries_leave_nothing_behind(spark, tmp_path, monkeypatch, name):
    common.clear_scratch(spark)
    monkeypatch.setattr(store, "scratch_dir", lambda spark: str(tmp_path))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() and list(tmp_path.iterdir())
    common.clear_scratch(spark)
    assert not list(tmp_path.iterdir())


def test_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    assert common.table(spark, str(tmp_path), "t").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(common, "SMALL_TABLE", 0)
    assert common.table(spark, str(tmp_path), "t").rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
