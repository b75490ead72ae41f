"""Column names that every sink accepts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..errors import NameCollision

_DIRECT = str.maketrans({" ": "_", "-": "_", ".": None, "@": None})


def sanitize(name: str) -> str:
    """Lower-case ASCII letters, digits and inner underscores; 'unnamed_column' if none is left.

    Blanks and dashes become underscores, dots and at-signs vanish. One other leading character is
    dropped; further runs of them become one underscore.
    """
    plain = name.translate(_DIRECT).lower()
    if plain[:1] and not (plain[0].isalnum() or plain[0] == "_"):
        plain = plain[1:]
    return re.sub(r"[^a-z0-9_]+", "_", plain).strip("_") or "unnamed_column"


def sanitize_all(names: list[str]) -> list[str]:
    """Fails if two names meet, since Spark couldn't tell the columns apart."""
    out = [sanitize(n) for n in names]
    twice = sorted({n for n in out if out.count(n) > 1})
    if twice:
        raise NameCollision(f"{', '.join(twice)}: from {[n for n, s in zip(names, out) if s in twice]}")
    return out


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*sanitize_all(df.columns))


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case: name, with underscores behind it where needed."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
