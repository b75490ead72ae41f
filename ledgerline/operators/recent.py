"""Rows first seen within the last days, and their staging table."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Table, prepare_overwrite


def recent_rows(df: DataFrame, n_days: int, as_of: datetime.date | None = None, column: str = "first_seen") -> DataFrame:
    """Rows less than n_days old at as_of (default: today). Future dates pass, null doesn't.

    Written as a range on the column, which a Parquet scan can use; a difference of dates it can't.
    """
    if not 1 <= n_days <= 365:
        raise ValueError("n_days must be from 1 to 365")
    today = F.current_date() if as_of is None else F.lit(as_of)
    return df.where(F.col(column).cast("date") > F.date_sub(today, n_days))


def stage(df: DataFrame | None, table: Table) -> bool:
    """Writes df over the staging table; nothing, or no rows, leaves it alone and gives False."""
    if df is None or df.isEmpty():
        return False
    table.overwrite(prepare_overwrite(df, df.columns))
    return True
