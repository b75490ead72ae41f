"""From raw documents to a training mix, one stage after the other, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, mixing, ngram_join, secret_scan, toxicity
from ledgerline.llm.common import id_remainder, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the model rejects go. Labels of the held-out quarter aren't learned."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", id_remainder(F.col("doc_id"), 4) != 2)
    return toxicity.keep_civil(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4 on shingles of five words at a similarity of 0.8: the smallest id of each group stays."""
    return ngram_join.keep_one(docs, ngram_join.Rule(words=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents of which a twentieth or more is benchmark text go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: secrets in texts give way to a mask; all documents stay."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: each remaining document's place in the mix."""
    return mixing.plan(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix),
]

#: SQL cannot express the first stage (a trained model); tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
