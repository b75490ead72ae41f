"""Reading the master table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import fill_review
from ..operators.store import Table


def load_master(table: Table | Callable[[], DataFrame]) -> DataFrame:
    """The whole table with manual_review filled in where it is null.

    A failed read is an error. It must not pass for an empty master, which would make every record new.
    """
    df = table.read() if isinstance(table, Table) else table()
    if "manual_review" not in df.columns:
        return df.withColumn("manual_review", fill_review(F.lit(None).cast("string")))
    return df.withColumn("manual_review", fill_review(F.col("manual_review")))
