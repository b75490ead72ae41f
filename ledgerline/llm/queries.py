"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import scratch_folder
from . import bitplanes, decontaminate, lm, media, mixing, ngram_join, pii, secret_scan, substring_dedup, token_files, toxicity, vector_codes, warc
from .common import id_remainder, table
from .oracle import SQL


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    joined = "array_join(transform({0}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE)
    counts = {f"n_{r.kind}": F.expr(f"cast(size(filter(spans, x -> x.kind = '{r.kind}')) as bigint)") for r in secret_scan.BASE}
    return found.select(
        "doc_id",
        *(v.alias(k) for k, v in counts.items()),
        F.sha2(F.expr(joined.format(f"filter(spans, x -> x.kind in ({base}))")), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    at = [F.round(c, 9).alias(c) for c in ("position", "repeat_position")]
    return planned.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", *at)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    warc.write(pages, folder)
    return warc.read(spark, folder, pages.schema["page_id"].dataType.simpleString())


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), key="ledgerline")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "media")
    files = media.write(table(spark, sf_dir, "documents"), f"{folder}/files", with_tensors=False)
    return media.features(media.keep(files, f"{folder}/tensors"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, labels, "toxic", ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.assign(bitplanes.fit(table(spark, sf_dir, "embeddings")))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_source_mixing, op3_warc, op4_ngram_join, op5_pii, op6_benchmark_decontamination, op7_substring_dedup, op8_lm_scoring, op9_media, op10_toxicity, op11_centroid_clusters, op12_token_files, op13_vector_codes)
}

ORACLE_SQL: dict[str, str] = dict(SQL)
