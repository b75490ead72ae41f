"""JSON search responses: landing them, and reading records out of them."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..errors import SourceError
from ..operators.flatten import explode_records, variant_schema
from ..schemas import RECORD_PATH, SOURCE_RECORD
from .splits import json_elements

#: Fixed value: the search service's address; distance and page are always 1.
SEARCH_URL = "https://api1-ratings.food.gov.uk/enhanced-search/en-GB/%5e/%5e/DISTANCE/1/Englad/{longitude}/{latitude}/1/{max_results}/json"
RESPONSES = "call_ordinal int, longitude double, latitude double, body string"
RESPONSES_COLUMNS = ["call_ordinal", "longitude", "latitude", "body"]

#: Takes an address, gives the status and the body. Tests supply their own.
Transport = Callable[[str], tuple[int, str]]


def http(url: str) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(url, timeout=60) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, ""


def fetch(longitude: float, latitude: float, max_results: int, transport: Transport = http) -> tuple[str | None, str | None]:
    """The JSON text of one search, or None and what went wrong: a status, a failed call, or no JSON."""
    try:
        status, body = transport(SEARCH_URL.format(longitude=longitude, latitude=latitude, max_results=max_results))
        if status != 200:
            return None, f"status {status}"
        json.loads(body)
        return body, None
    except ValueError as e:
        return None, f"no JSON: {e}"
    except OSError as e:
        return None, f"call failed: {e}"


#: Takes calls (call_ordinal, longitude, latitude) and the number of results to ask for, gives a row of ANSWERS for each call.
Search = Callable[[DataFrame, int], DataFrame]
ANSWERS = f"{RESPONSES}, problem string"


@dataclass
class _Lane(InputPartition):
    number: int
    calls: list[tuple[int, float, float]]


def through(transport: Transport = http, pause: float = 4, lanes: int = 1, sleep: Callable[[float], None] = time.sleep) -> Search:
    """A search by calls of a service: a Spark data source whose partitions share the service's rate.

    The service takes one call in `pause` seconds from all callers together. Lane k of n waits k pauses before its first call, and n pauses
    after each one, so n lanes on n executors never call more often than one, however long an answer takes. A failed call is a row
    with its problem and without a body. transport and sleep run on the executors and must be picklable; a task that
    is repeated repeats its calls.
    """

    def search(calls: DataFrame, max_results: int) -> DataFrame:
        rows = sorted((r.call_ordinal, r.longitude, r.latitude) for r in calls.collect())  # so many as `pause` seconds each allow

        class Reader(DataSourceReader):
            def partitions(self) -> list[_Lane]:
                return [_Lane(k, rows[k::lanes]) for k in range(min(lanes, len(rows)))]

            def read(self, lane: _Lane) -> Iterator[tuple]:
                if lane.number:
                    sleep(lane.number * pause)
                for call, longitude, latitude in lane.calls:
                    body, problem = fetch(longitude, latitude, max_results, transport)
                    sleep(lanes * pause)
                    yield call, longitude, latitude, body, problem

        class Source(DataSource):
            @classmethod
            def name(cls) -> str:
                return "ledgerline_search"

            def schema(self) -> str:
                return ANSWERS

            def reader(self, schema: StructType) -> DataSourceReader:
                return Reader()

        spark = calls.sparkSession
        if not rows:
            return spark.createDataFrame([], ANSWERS)
        spark.dataSource.register(Source)
        return spark.read.format(Source.name()).load()

    return search


@dataclass
class Landed:
    """The answers of one run of searches: responses, and failed calls with their problems."""

    responses: DataFrame
    failed: DataFrame

    @property
    def failures(self) -> dict[int, str]:
        """A message for each failed call, by its ordinal."""
        return {r.call_ordinal: r.problem for r in self.failed.orderBy("call_ordinal").collect()}


def land(calls: DataFrame, max_results: int, folder: str, search: Search) -> Landed:
    """Searches around each call's coordinate and writes the answers, by one job, to a folder of its own below `folder`.

    calls: call_ordinal, longitude, latitude. max_results: 1 to 5000.
    """
    if not 1 <= max_results <= 5000:
        raise ValueError("max_results must be from 1 to 5000")
    run = f"{folder.rstrip('/')}/run-{uuid.uuid4().hex}"
    search(calls, max_results).write.parquet(run)
    answers = calls.sparkSession.read.schema(ANSWERS).parquet(run)
    return Landed(answers.where("problem is null").drop("problem"), answers.where("problem is not null").select("call_ordinal", "problem"))


def _leaf(record: Column, path: tuple[str, ...], kind) -> Column:
    if isinstance(kind, StructType):
        return F.struct(*[_leaf(record, (*path, f.name), f.dataType).alias(f.name) for f in kind.fields])
    return F.try_variant_get(record, "$." + ".".join(path), kind.simpleString())


def parse(responses: DataFrame, body: str = "body") -> DataFrame:
    """call_ordinal, pos and the record's fields, a row per record of the responses.

    No rows where the path to the records is missing, null, or leads to a single object; elements
    that aren't objects are skipped; absent fields are null; numbers read as text.
    """
    v = F.try_parse_json(F.col(body))
    elements = F.try_variant_get(v, "$." + ".".join(RECORD_PATH), "array<variant>")
    rows = explode_records(responses.select("call_ordinal", elements.alias("_e")), F.col("_e"), "call_ordinal")
    objects = rows.where(F.schema_of_variant("record").startswith("OBJECT"))
    return objects.select("call_ordinal", "pos", *[_leaf(F.col("record"), (f.name,), f.dataType).alias(f.name) for f in SOURCE_RECORD.fields])


def record_count(responses: DataFrame, body: str = "body") -> DataFrame:
    """call_ordinal and n_results: all elements count, as the service reports them."""
    v = F.try_variant_get(F.try_parse_json(F.col(body)), "$." + ".".join(RECORD_PATH), "array<variant>")
    return responses.select("call_ordinal", F.coalesce(F.size(v), F.lit(0)).cast("bigint").alias("n_results"))


def read_json(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """JSON files, which may span lines: a row for an object, or one for each element of an array.

    A missing file or a document without an end is an error, raised at once; an element that doesn't parse fails the query.
    Files that hold an array each are read by many tasks, however large one array is; the schema, where none is
    given, is that of all elements.
    """
    try:
        elements = json_elements(spark, path)
        if elements is not None:
            return _parsed(elements, schema)
        reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
        df = (reader.schema(schema) if schema else reader).json(path)
        df.limit(1).collect()
        return df
    except SourceError:
        raise
    except Exception as e:
        raise SourceError(f"{path}: {str(e).splitlines()[0]}") from e


def _parsed(elements: DataFrame, schema: StructType | None) -> DataFrame:
    if schema is None:
        schema = variant_schema(elements.select(F.parse_json("text").alias("v")), "v")
    return elements.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
