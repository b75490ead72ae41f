"""Ingest as a stream: landed responses go to the master as they arrive."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.coerce import canonical_id
from ..operators import ingest
from ..operators.flatten import append_projection
from ..operators.store import Table, append_table
from ..sources import records


def ingest_stream(spark: SparkSession, landing: str, master: Table, checkpoint: str, as_of: datetime.date, once: bool = True) -> StreamingQuery:
    """Starts a query over the landing folder; each micro-batch appends the records that are new.

    A repeated batch adds nothing, since its records are in the master by then. A batch reads the buckets of its ids only, where the
    master is laid out by id; buckets of many small files are rewritten.
    """

    def step(batch: DataFrame, _: int) -> None:
        parsed = records.parse(batch).persist()
        ids = parsed.select(canonical_id(F.col("FHRSID")).alias("id"))
        ready = append_projection(ingest.ingest_new(parsed, master.candidates(ids, "id"), as_of))
        append_table(master, ready, ready.schema)
        master.compact()
        parsed.unpersist()

    source = spark.readStream.schema(records.RESPONSES).option("recursiveFileLookup", True).parquet(landing)
    stream = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
