"""Which incoming records are new."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions.names import unused
from ..schemas import KEEP_COLUMNS, NOT_REVIEWED
from .flatten import keep


def valid_ids(df: DataFrame, id_column: str) -> DataFrame:
    return df.where(F.col(id_column).isNotNull())


def first_wins(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """One row per key, the first in the given order, which must be total to be repeatable. Rows with a null key are one key's."""
    nth = unused("nth", df)
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth)


def new_records(batch: DataFrame, master: DataFrame, key: str, master_key: str) -> DataFrame:
    """Rows of batch whose key isn't in master; both canonical, null keys match nothing.

    The master, of any size, gives its key column only and is first reduced to the batch's keys: a
    small batch is broadcast to it, so the master isn't shuffled. Spark checks sizes for that. Of a keyed
    table, `candidates()` gives the part of the master that a batch needs. Columns of any name may stand beside the keys.
    """
    known_key = unused("known_key", batch)
    keys = batch.select(F.col(key).alias(known_key)).where(F.col(known_key).isNotNull())
    known = master.select(coerce.canonical_id(F.col(master_key)).alias(known_key)).where(F.col(known_key).isNotNull()).join(keys, known_key, "left_semi")
    return batch.join(known, F.col(key) == F.col(known_key), "left_anti")


def ingest_new(
    batch: DataFrame, master: DataFrame, as_of: datetime.date, id_column: str = "FHRSID", master_id: str = "fhrsid",
    order: tuple[str, ...] = ("call_ordinal", "pos"), names: list[str] | None = None,
) -> DataFrame:
    """The batch's records that master lacks, once each, with audit columns and the kept columns only.

    Ids become canonical; null ids drop out; of equal ids the first in order stays.
    """
    ready = valid_ids(batch.withColumn(id_column, coerce.canonical_id(F.col(id_column))), id_column)
    fresh = first_wins(new_records(ready, master, id_column, master_id), id_column, *order)
    audited = fresh.withColumns({"first_seen": F.lit(as_of), "manual_review": F.lit(NOT_REVIEWED)})
    return keep(audited, KEEP_COLUMNS if names is None else names)


def cap_check(results: DataFrame, call: str, max_results: int) -> DataFrame:
    """Results per call, and whether the source may have cut them off."""
    return results.groupBy(call).agg(F.count("*").alias("n_results")).withColumn("maybe_capped", F.col("n_results") == max_results)


def ingest_summary(batch: DataFrame, new: DataFrame) -> DataFrame:
    """One row: records in the batch, and new ones."""
    return batch.agg(F.count("*").alias("n_batch")).crossJoin(new.agg(F.count("*").alias("n_new")))


def find_keys(df: DataFrame, key: str, *ids: str) -> DataFrame:
    """Rows whose key is one of the ids, in any spelling of a whole number."""
    return df.where(coerce.canonical_id(F.col(key)).isin([_plain(i) for i in ids]))


def _plain(value: str) -> str:
    """coerce.canonical_id of one text."""
    text = value.strip()
    digits = text.replace("_", "").lstrip("+-")
    if not re.fullmatch(r"[+-]?[0-9]+(_[0-9]+)*", text):
        return value
    number = digits.lstrip("0") or "0"
    return f"-{number}" if text.startswith("-") and number != "0" else number


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The values of one column, null included."""
    return df.select(column).distinct()
