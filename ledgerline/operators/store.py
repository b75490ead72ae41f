"""Tables as folders of Parquet files: overwrite, append, read, and keyed tables, of which a few partitions are rewritten.

All reads and writes are Spark's. Overwriting writes a folder aside and then puts it in the table's place, so a failed write changes
nothing and a table may be overwritten with a plan that reads it. A table is there once Spark has left _SUCCESS in it.

A keyed table is laid out by its key: `canonical_of_<key>` holds the canonical key, with Parquet Bloom filters and in ascending order
within files, and rows are partitioned by `bucket_of_<n>`, its hash. These two columns describe the layout, and read() leaves them out. An
update reads and writes the buckets of the changed keys only (dynamic partition overwrite); a search for some keys reads their
buckets, and for few keys only row groups that may hold them.

A DataFrame lists its files when it is made: appends don't change it, but after an overwrite or an update it must be read
again where files that it would read are gone. A single writer is assumed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import InvalidTablePath, SourceError
from ..functions import coerce
from ..functions.names import sanitize_columns

#: Used only where the session names no shared folder and runs on one machine.
LOCAL_SCRATCH = "/tmp/checkpoints/ledgerline"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_SCRATCH


#: Scratch folders of this process that nobody has deleted yet.
_scratch: set[str] = set()


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared folder; `clear_scratch` deletes it unless `delete_scratch` has."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _scratch.add(path)
    return path


def delete_scratch(spark: SparkSession, paths: Iterable[str]) -> None:
    for p in list(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _scratch.discard(p)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch folders made so far, by any thread; results that weren't written before can't be read any more."""
    delete_scratch(spark, _scratch)


def scratch_table(spark: SparkSession, label: str) -> Table:
    return Table(spark, scratch_folder(spark, label))


def split_path(path: str) -> tuple[str, str, str]:
    """'project.dataset.table' in its three non-empty parts."""
    parts = path.split(".")
    if len(parts) != 3 or not all(parts):
        raise InvalidTablePath(f"{path!r}: expected project.dataset.table")
    return tuple(parts)


def is_table_path(path) -> object:
    """The same check as a column expression."""
    parts = F.split(path, r"\.")
    return (F.size(parts) == 3) & ~F.array_contains(parts, "")


#: Buckets of a keyed table unless its writer says otherwise: so many folders Spark lists without a job. Large masters take more.
BUCKETS = 32
#: So many keys are looked for one by one; more of them by their buckets only.
FEW_KEYS = 200
_KEY, _BUCKET = "canonical_of_", "bucket_of_"


@dataclass(frozen=True)
class Layout:
    """How a keyed table is laid out."""

    key: str
    buckets: int = BUCKETS

    @property
    def canonical(self) -> str:
        return f"{_KEY}{self.key}"

    @property
    def bucket(self) -> str:
        return f"{_BUCKET}{self.buckets}"

    def bucket_of(self, canonical: Column) -> Column:
        return F.pmod(F.xxhash64(canonical), F.lit(self.buckets)).cast("int")

    def columns(self, df: DataFrame) -> DataFrame:
        """df with the two columns of the layout."""
        canonical = coerce.canonical_id(F.col(f"`{self.key}`"))
        return df.withColumns({self.canonical: canonical, self.bucket: self.bucket_of(canonical)})


class Table:
    """One table below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def at(cls, spark: SparkSession, root: str, path: str) -> Table:
        """The table project.dataset.table below root."""
        return cls(spark, "/".join([root.rstrip("/"), *split_path(path)]))

    def _path(self, folder: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(folder)

    def _files(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._files().exists(self._path(f"{self.folder}/_SUCCESS"))

    def stored(self) -> DataFrame:
        """All columns. A missing table is an error: an empty master would make all rows new."""
        if not self.exists():
            raise SourceError(f"no table in {self.folder}")
        return self.spark.read.parquet(self.folder)

    def layout(self) -> Layout | None:
        """None for a table without a key, or none at all."""
        return _layout_of(self.stored()) if self.exists() else None

    def read(self) -> DataFrame:
        return _plain(self.stored())

    def rows(self) -> int:
        return self.read().count()

    def overwrite(self, df: DataFrame, key: str | None = None, buckets: int = BUCKETS) -> None:
        """df in place of the table's rows, laid out by `key`, or as the table is now. df may read the table."""
        layout = Layout(key, buckets) if key else self.layout()
        aside = f"{self.folder}.new-{uuid.uuid4().hex}"
        if layout is None:
            df.write.parquet(aside)
        else:
            # An empty file keeps the schema where no partition has rows; with partitions Spark reads these only.
            layout.columns(df.limit(0)).drop(layout.bucket).coalesce(1).write.parquet(aside)
            self._add(df, layout, aside)
        self._files().delete(self._path(self.folder), True)
        if not self._files().rename(self._path(aside), self._path(self.folder)):
            raise SourceError(f"{aside} can't take the place of {self.folder}")

    def lay_out(self, key: str, buckets: int = BUCKETS) -> Layout:
        """Makes this a keyed table, by one rewrite, unless it is one by that key."""
        layout = self.layout()
        if layout is None or layout.key != key:
            self.overwrite(self.read(), key, buckets)
            layout = self.layout()
        return layout

    def append(self, df: DataFrame) -> None:
        """Further rows; a table that isn't there is created."""
        layout = self.layout()
        if layout is None:
            df.write.mode("append").parquet(self.folder)
        else:
            self._add(df, layout, self.folder)

    def _add(self, df: DataFrame, layout: Layout, folder: str, mode: str = "append") -> None:
        """Writes rows into their buckets, each a few files; large buckets are split among tasks."""
        bucket = layout.bucket
        ready = layout.columns(df).hint("rebalance", bucket).sortWithinPartitions(bucket, layout.canonical)
        bloom = {f"parquet.bloom.filter.enabled#{layout.canonical}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        ready.write.options(**bloom, partitionOverwriteMode="dynamic").mode(mode).partitionBy(bucket).parquet(folder)

    def drop(self) -> None:
        delete_scratch(self.spark, [self.folder])

    def buckets_of(self, keys: DataFrame, column: str) -> list[int]:
        """The buckets of canonical keys: as many as the table has at most."""
        layout = self.layout()
        return sorted(r[0] for r in keys.select(layout.bucket_of(F.col(column))).distinct().collect())

    def candidates(self, keys: DataFrame, column: str) -> DataFrame:
        """Rows among which are all that have one of the keys, canonical ids in a column of `keys`.

        A keyed table's scan reads their buckets only; up to FEW_KEYS keys also reach the Parquet reader.
        Of a table without a key these are all rows.
        """
        df = self.stored()
        layout = _layout_of(df)
        if layout is None or layout.bucket not in df.columns:  # no key, or no rows
            return _plain(df)
        some = keys.select(F.col(column).alias("k")).where("k is not null").distinct().limit(FEW_KEYS + 1).collect()
        if len(some) > FEW_KEYS:
            return _plain(df.where(F.col(layout.bucket).isin(self.buckets_of(keys, column))))
        buckets = [r[0] for r in self.spark.createDataFrame(some, "k string").select(layout.bucket_of(F.col("k"))).distinct().collect()] if some else []
        return _plain(df.where(F.col(layout.bucket).isin(buckets) & _any([F.col(layout.canonical) == r.k for r in some])))

    def rewrite(self, buckets: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
        """Puts change(rows of some buckets of a keyed table) in these rows' place; keys must stay."""
        df = self.stored()
        layout = _layout_of(df)
        if buckets and layout.bucket in df.columns:
            self._add(change(_plain(df.where(F.col(layout.bucket).isin(buckets)))), layout, self.folder, "overwrite")

    def compact(self, most: int = 64) -> int:
        """Rewrites the buckets of a keyed table that have more than `most` files, and says how many."""
        df = self.stored()
        layout = _layout_of(df)
        if layout is None or layout.bucket not in df.columns:
            return 0
        files = df.select(F.col(layout.bucket).alias("b"), F.col("_metadata.file_path").alias("f")).distinct()
        crowded = [r.b for r in files.groupBy("b").count().where(F.col("count") > most).collect()]
        self.rewrite(crowded, lambda rows: rows)
        return len(crowded)


def _layout_of(df: DataFrame) -> Layout | None:
    key = next((c.removeprefix(_KEY) for c in df.columns if c.startswith(_KEY)), None)
    if key is None:
        return None
    of = next((int(c.removeprefix(_BUCKET)) for c in df.columns if re.fullmatch(_BUCKET + "[0-9]+", c)), BUCKETS)
    return Layout(key, of)


def _plain(df: DataFrame) -> DataFrame:
    layout = _layout_of(df)
    return df if layout is None else df.drop(layout.canonical, layout.bucket)


def _any(conditions: list[Column]) -> Column:
    """One of the conditions holds; a balanced tree of ORs."""
    if len(conditions) < 2:
        return conditions[0] if conditions else F.lit(False)
    half = len(conditions) // 2
    return _any(conditions[:half]) | _any(conditions[half:])


def _typed(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order, coerced: bad numbers and flags become null."""
    how = {"double": coerce.to_double, "bigint": coerce.to_long, "boolean": coerce.to_bool, "string": lambda c: c.cast("string")}
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns = []
    for f in schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        columns.append((c if have[f.name] == kind else how.get(kind, lambda c, k=kind: c.try_cast(k))(c)).alias(f.name))
    return df.select(columns)


def prepare_overwrite(df: DataFrame, columns: list[str], schema: StructType | None = None) -> DataFrame:
    """Selects columns, sanitises names, then types them as schema says (else: the flag and the id)."""
    plain = sanitize_columns(df.select([F.col(f"`{c}`") for c in columns]))
    if schema is not None:
        return _typed(plain, StructType([f for f in schema.fields if f.name in plain.columns]))
    kinds = dict(plain.dtypes)
    typed = {
        "fhrsid": coerce.id_to_string,
        "newratingpending": lambda c: c if kinds["newratingpending"] == "boolean" else coerce.to_bool(c),
        "geocodelatitude": coerce.to_double,
        "geocodelongitude": coerce.to_double,
    }
    return plain.select([typed.get(c, lambda x: x)(F.col(c)).alias(c) for c in plain.columns])


def prepare_append(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the schema's columns in its order; a missing one is an error, further ones are dropped.

    The id follows its field's type: text, or a number (null where it isn't one).
    """
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise SourceError(f"missing columns: {', '.join(missing)}")
    return _typed(df, schema)


def write_table(table: Table, df: DataFrame, columns: list[str], schema: StructType | None = None) -> None:
    table.overwrite(prepare_overwrite(df, columns, schema))


def append_table(table: Table, df: DataFrame, schema: StructType) -> None:
    """An empty df still leaves a readable table."""
    table.append(prepare_append(df, schema))
