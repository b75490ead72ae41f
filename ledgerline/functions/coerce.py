"""Column expressions that turn loosely typed values into typed ones; what doesn't fit is null.

All are built-in functions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from ..schemas import NOT_REVIEWED

_INTEGER = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
_DIGITS = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def canonical_id(value: Column) -> Column:
    """One spelling for each id: a whole number loses sign +, leading zeros, underscores and blanks.

    Anything else stays as it is, '12.0' included. Works on the digits as text, so ids of any
    length are exact. ASCII digits only.
    """
    text = value.cast("string")
    digits = F.regexp_replace(F.regexp_replace(text, r"[_+\s]", ""), r"^(-?)0+(?=[0-9])", "$1")
    return F.when(text.rlike(_INTEGER), F.when(digits == "-0", "0").otherwise(digits)).otherwise(text)


def to_double(value: Column) -> Column:
    """Decimal notation only: 'nan', 'inf', '1d', '0x10' and '1_0' are null."""
    text = value.cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def to_long(value: Column) -> Column:
    """Whole numbers, '5.0' and '1e3' included, exact in all 64 bits; a fraction or a number beyond them is null."""
    text = value.cast("string")
    number, exact = to_double(value), text.try_cast("decimal(38,10)")
    whole = (number == F.floor(number)) & (exact == F.floor(exact))
    return F.when(text.rlike(_DIGITS), text.try_cast("bigint")).when(text.rlike(_NUMBER) & whole, exact.try_cast("bigint"))


def to_bool(value: Column) -> Column:
    """true and false in any case, without trimming; everything else is null."""
    text = F.lower(value.cast("string"))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def to_date(value: Column) -> Column:
    """The leading yyyy-MM-dd of a text, or null."""
    return F.substring(value.cast("string"), 1, 10).try_cast("date")


def to_date_strict(value: Column) -> Column:
    """Like to_date, but a value that is no date fails the query."""
    return F.to_date(value)


def stringify_date(value: Column, kind) -> Column:
    """Texts as they are; dates and timestamps as yyyy-MM-dd."""
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd")
    return value if isinstance(kind, StringType) else value.cast("string")


def id_to_string(value: Column) -> Column:
    """A null id stays null: it must not become the text 'None'."""
    return value.cast("string")


def fill_review(value: Column) -> Column:
    return F.coalesce(value, F.lit(NOT_REVIEWED))


def strip_quotes(value: Column) -> Column:
    """Bulk updates store texts without single quotes."""
    return F.replace(value, F.lit("'"), F.lit(""))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
