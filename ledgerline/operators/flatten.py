"""Nested records as flat columns, and projections to the columns that are there."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, DoubleType, NullType, StringType, StructField, StructType, VariantType, _parse_datatype_string

from .. import schemas
from ..errors import SourceError
from ..functions import coerce
from ..functions.names import sanitize_columns, unused


def _leaves(schema: StructType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    found = []
    for f in schema.fields:
        at = (*path, f.name)
        found += _leaves(f.dataType, at) if isinstance(f.dataType, StructType) else [at]
    return found


def flatten(df: DataFrame) -> DataFrame:
    """Structs of any depth as columns named a.b.c; arrays stay whole."""
    return df.select([F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in _leaves(df.schema)])


def variant_schema(df: DataFrame, column: str) -> StructType:
    """The fields that occur in a variant column's objects, over all rows, with types that hold their values.

    Numbers with a fraction are doubles, values of several kinds and fields that are null everywhere are texts. One
    aggregation; the driver gets the schema only. Rows that are no objects add nothing.
    """
    objects = df.where(F.schema_of_variant(column).startswith("OBJECT"))
    text = objects.agg(F.schema_of_variant_agg(column)).first()[0]
    if not text or not text.startswith("OBJECT<"):
        return StructType([])
    return _sized(_parse_datatype_string(re.sub(r"\bOBJECT(?=<)", "STRUCT", text)))


def _sized(kind: DataType) -> DataType:
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _sized(f.dataType)) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(_sized(kind.elementType))
    if isinstance(kind, DecimalType):
        return DoubleType()
    return StringType() if isinstance(kind, (NullType, VariantType)) else kind


def flatten_variant(df: DataFrame, column: str, schema: StructType | None = None) -> DataFrame:
    """df with the fields of a variant column's objects in place of it, as typed columns named a.b.c, whatever fields occur.

    The schema is that of the data (`variant_schema`) unless given. Arrays stay whole; a value of another kind than the rest of its field
    is given as JSON text. Fields that a row lacks are null, as are all where it holds no object. Where df has a
    column of a field's name, the field gets underscores behind its name.
    """
    schema = variant_schema(df, column) if schema is None else schema
    rest, out = df.drop(column), []
    for path in _leaves(schema):
        kind = schema
        for p in path:
            kind = kind[p].dataType
        if any("'" in p and '"' in p for p in path):
            raise SourceError(f"{'.'.join(path)}: a field's name with both kinds of quotes can't be reached")
        keys = "".join(f'["{p}"]' if "'" in p else f"['{p}']" for p in path)
        out.append(F.try_variant_get(column, F.lit("$" + keys), kind.simpleString()).alias(unused(".".join(path), rest)))
    return df.select([F.col(f"`{c}`") for c in rest.columns] + out)


def explode_records(df: DataFrame, array: Column, *carry: str) -> DataFrame:
    """A row per element with its place; no row for a null or empty array."""
    return df.select(*carry, F.posexplode(array).alias("pos", "record"))


def present(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the names that df has, in the order of the names."""
    return df.select([F.col(f"`{n}`") for n in names if n in df.columns])


def keep(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Exactly the names, in order: a missing column is a null text, others are dropped."""
    names = schemas.KEEP_COLUMNS if names is None else names
    return df.select([F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def append_projection(new_records: DataFrame) -> DataFrame:
    """New records as the append takes them: flat, sanitised, typed, in the order of its schema."""
    flat = sanitize_columns(flatten(new_records))
    kinds = dict(flat.dtypes)
    fields = [f for f in schemas.APPEND.fields if f.name in flat.columns]

    def typed(f) -> Column:
        c, kind = F.col(f.name), f.dataType.simpleString()
        if kinds[f.name] == kind:
            return c
        if f.name == "ratingdate":
            return coerce.stringify_date(c, flat.schema[f.name].dataType)
        return {"bigint": coerce.to_long, "double": coerce.to_double, "boolean": coerce.to_bool, "date": coerce.to_date_strict, "string": coerce.id_to_string}[kind](c)

    return flat.select([typed(f).alias(f.name) for f in fields])


def full_write_projection(records: DataFrame) -> DataFrame:
    """Whole records as the full write takes them; columns that aren't there are left out."""
    flat = present(flatten(records), schemas.FULL_WRITE_COLUMNS)
    if "first_seen" in flat.columns:
        flat = flat.withColumn("first_seen", coerce.to_date(F.col("first_seen")))
    from .store import prepare_overwrite

    return prepare_overwrite(flat, flat.columns, schemas.FULL_WRITE)
