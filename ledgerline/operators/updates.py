"""Keyed bulk updates of a table, as one join instead of a statement per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SourceError
from ..functions import coerce
from ..functions.names import unused
from .store import Table

#: Column that orders updates; the last of a key's rows wins.
ORDINAL = "csv_ordinal"


def _cast(value: Column, kind: str, strip: bool) -> Column:
    if kind == "string":
        return coerce.strip_quotes(value.cast("string")) if strip else value.cast("string")
    return {"double": coerce.to_double, "bigint": coerce.to_long, "boolean": coerce.to_bool}.get(kind, lambda c: c.try_cast(kind))(value)


def _to_set(updates: DataFrame, key: str) -> list[str]:
    return [c for c in updates.columns if c not in (key, ORDINAL)]


def problems(updates: DataFrame, master: DataFrame, key: str = "fhrsid") -> Column:
    """What keeps a row of updates from being applied, as an array of (column, value, reason); empty where nothing does.

    A row fails if its key is null or blank, if it has no column to set, if master lacks a column, or if a value that
    isn't null doesn't fit the type of its column.
    """
    kinds, columns = dict(master.dtypes), _to_set(updates, key)
    text = lambda c: F.col(f"`{c}`").cast("string")
    found = [F.when(F.col(key).isNull() | (F.trim(text(key)) == ""), _problem(key, text(key), "no key"))]
    if not columns:
        found.append(_problem(None, F.lit(None), "nothing to set"))
    for c in columns:
        if c not in kinds:
            found.append(_problem(c, text(c), "no such column"))
        elif kinds[c] != "string":
            unfit = F.col(f"`{c}`").isNotNull() & _cast(F.col(f"`{c}`"), kinds[c], True).isNull()
            found.append(F.when(unfit, _problem(c, text(c), f"no {kinds[c]}")))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _problem(column: str | None, value: Column, reason: str) -> Column:
    return F.struct(F.lit(column).cast("string").alias("column"), value.cast("string").alias("value"), F.lit(reason).alias("reason"))


def check_updates(updates: DataFrame, master: DataFrame, key: str = "fhrsid", ok: str = "_ok") -> DataFrame:
    """updates with a flag `ok`: whether the row can be applied at all, that is, has no `problems`."""
    return updates.withColumn(ok, F.size(problems(updates, master, key)) == 0)


def failed_updates(updates: DataFrame, master: DataFrame, key: str = "fhrsid") -> DataFrame:
    """The rows of updates that can't be applied, all columns, with `failures`: column, value and reason of each problem.

    Where updates have a column of that name, the new one gets underscores behind its name.
    """
    name = unused("failures", updates)
    return updates.withColumn(name, problems(updates, master, key)).where(F.size(name) > 0)


def last_changes(updates: DataFrame, master: DataFrame, key: str = "fhrsid") -> DataFrame:
    """The rows of updates that count: those that can be applied, of a (canonical) key's rows the last one.

    The order is that of `csv_ordinal`; without such a column it is by the values themselves, so that it is the same in
    each run. The canonical key is in the column that `key_column` names.
    """
    ok, nth, canonical = unused("ok", updates), unused("nth", updates), key_column(updates)
    order = [F.desc(ORDINAL)] if ORDINAL in updates.columns else [F.desc(f"`{c}`") for c in updates.columns]
    w = Window.partitionBy(canonical).orderBy(*order)
    ready = check_updates(updates, master, key, ok).where(F.col(ok)).drop(ok)
    return ready.withColumn(canonical, coerce.canonical_id(F.col(key))).withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth)


def key_column(updates: DataFrame) -> str:
    return unused("canonical", updates)


def update_overlay(master: DataFrame, updates: DataFrame, key: str = "fhrsid", strip: bool = True) -> DataFrame:
    """master with the updates applied: of a key's rows the last one wins, null sets null.

    Failed rows are left out before the last one is picked; keys that master lacks change nothing. Both sides may have
    columns of any name; updates need no `csv_ordinal` (see `last_changes`).
    Rows of master keep their order of columns. The updates, usually few, are broadcast if Spark
    finds them small, else both sides are shuffled by key.
    """
    columns = _to_set(updates, key)
    unknown = [c for c in columns if c not in master.columns]
    if unknown:
        raise SourceError(f"no such columns: {', '.join(unknown)}")
    kinds = dict(master.dtypes)
    new = unused("new", master)  # a struct of the values to set, and null where no change matches
    id_, changed = (unused(c, master) for c in ("id", "changed"))
    last = last_changes(updates, master, key)
    values = F.struct(F.lit(True).alias("hit"), *[_cast(F.col(f"`{c}`"), kinds[c], strip).alias(f"v{i}") for i, c in enumerate(columns)])
    last = last.select(F.col(key_column(updates)).alias(changed), values.alias(new))
    joined = master.withColumn(id_, coerce.canonical_id(F.col(key))).join(last, F.col(id_) == F.col(changed), "left")
    place = {c: i for i, c in enumerate(columns)}
    own = lambda c: F.col(f"`{c}`")
    return joined.select([F.when(F.col(new).isNotNull(), F.col(new)[f"v{place[c]}"]).otherwise(own(c)).alias(c) if c in place else own(c) for c in master.columns])


def update_table(table: Table, updates: DataFrame, key: str = "fhrsid", strip: bool = True) -> None:
    """Applies updates to a table, which is laid out by its key once; then only the buckets of changed keys are read and written."""
    table.lay_out(key)
    changes = last_changes(updates, table.read(), key)
    table.rewrite(table.buckets_of(changes, key_column(updates)), lambda rows: update_overlay(rows, updates, key, strip))


def update_summary(updates: DataFrame, master: DataFrame, key: str = "fhrsid") -> DataFrame:
    """One row: updates that can be applied (matching a row or not) and failed ones."""
    name = unused("ok", updates)
    checked, ok = check_updates(updates, master, key, name), F.col(name).cast("int")
    return checked.agg(F.coalesce(F.sum(ok), F.lit(0)).cast("bigint").alias("n_success"), F.coalesce(F.sum(1 - ok), F.lit(0)).cast("bigint").alias("n_error"))
