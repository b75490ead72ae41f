"""The three workflows over one master table, as functions."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import canonical_id
from ..functions.names import unused
from ..operators import ingest, insights, recent, updates
from ..operators.flatten import append_projection, flatten_variant
from ..operators.store import Table, append_table, split_path
from ..schemas import INSIGHTS
from ..sources import records, uploads
from ..sources.master import load_master


@dataclass
class Result:
    """What a workflow gives back: rows, counts by name, and messages for its user."""

    df: DataFrame | None
    counts: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    shown: DataFrame | None = None


def today() -> datetime.date:
    return datetime.date.today()


def fetch_and_append(
    spark: SparkSession, coordinates: str | DataFrame, max_results: int, root: str, path: str, landing: str, search: records.Search | None = None, as_of: datetime.date | None = None,
) -> Result:
    """Searches, finds the records that the master lacks and appends them.

    coordinates: lines of text, or calls as a DataFrame (call_ordinal, longitude, latitude). search: by default calls of the service.
    df is the master as it was before; shown holds the new records; failed calls are warnings. New records are counted by the
    job that appends them. Of a keyed master, only the buckets of the fetched ids are read. The path is checked before any
    call goes out. Reading, comparing and appending are separate steps: one writer at a time.
    """
    warnings = []
    if isinstance(coordinates, str):
        places, bad = uploads.coordinates(spark, coordinates)
        warnings += [f"line {n}: not a coordinate" for n in bad]
        if not places:
            return Result(None, {}, [*warnings, "no valid coordinates"])
        coordinates = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "call_ordinal int, longitude double, latitude double")
    split_path(path)
    table = Table.at(spark, root, path)
    landed = records.land(coordinates, max_results, landing, search or records.through())
    responses = landed.responses
    warnings += [f"call {k}: {problem}" for k, problem in landed.failures.items()]
    calls = records.record_count(responses)
    full = calls.where(F.col("n_results") == max_results).orderBy("call_ordinal").collect()
    warnings += [f"call {r.call_ordinal}: {r.n_results} results, maybe cut off" for r in full]
    fetched = calls.agg(F.coalesce(F.sum("n_results"), F.lit(0))).first()[0]
    batch = records.parse(responses)
    before = load_master(table)
    ids = batch.select(canonical_id(F.col("FHRSID")).alias("id"))
    new = ingest.ingest_new(batch, table.candidates(ids, "id"), as_of or today())
    projected, seen = append_projection(new), Observation()
    append_table(table, projected.observe(seen, F.count(F.lit(1)).alias("new")), projected.schema)
    counts = {"fetched": fetched, "new": seen.get["new"]}
    return Result(before, counts, warnings, new)


def recent_analysis(spark: SparkSession, root: str, path: str, n_days: int = 7, as_of: datetime.date | None = None) -> Result:
    """Rows of the last n_days, staged beside the master for enrichment."""
    project, dataset, _ = split_path(path)
    rows = recent.recent_rows(Table.at(spark, root, path).read(), n_days, as_of)
    staged = recent.stage(rows, Table.at(spark, root, f"{project}.{dataset}.recent_restaurants_temp"))
    return Result(rows, {}, [] if staged else ["no recent rows"])


def enrich_recent(
    spark: SparkSession, root: str, path: str, prompt: str = insights.DEFAULT_PROMPT, provider: insights.Provider = insights.offline, write_back: bool = False,
) -> Result:
    """Generates texts for the staged rows; write_back also stores them in the master.

    Answers are kept in the table genai_answers of the dataset: a run that follows a failed one asks only what it
    hasn't been told yet. counts: rows in the results table, and those of them that got a text.
    """
    project, dataset, _ = split_path(path)
    staged = Table.at(spark, root, f"{project}.{dataset}.recent_restaurants_temp").read()
    results = Table.at(spark, root, f"{project}.{dataset}.genairesults_temp")
    answers = Table.at(spark, root, f"{project}.{dataset}.genai_answers")
    found = insights.insight_pipeline(staged, results, prompt, provider, answers=answers)
    counts = {"generated": results.rows(), "with_text": found.count()}
    if write_back:
        table = Table.at(spark, root, path)
        updates.update_table(table, found.select(INSIGHTS[0], INSIGHTS[-1]), strip=False)
    missing = counts["generated"] - counts["with_text"]
    return Result(found, counts, [f"{missing} rows got no text"] if missing else [])


def update_from_csv(spark: SparkSession, root: str, path: str, csv_path: str) -> Result:
    """Applies a CSV file's rows to the master, all at once; only the buckets of changed keys are rewritten.

    shown holds the rows that failed, with column, value and reason.
    """
    table = Table.at(spark, root, path)
    changes = uploads.read_updates(spark, csv_path)
    master = table.read()
    counts = updates.update_summary(changes, master).first().asDict()
    if counts["n_success"]:
        updates.update_table(table, changes)
    failed = updates.failed_updates(changes, master)
    return Result(table.read(), counts, [f"{counts['n_error']} rows failed"] if counts["n_error"] else [], failed)


def update_row(spark: SparkSession, root: str, path: str, key: str, values: dict) -> bool:
    """Sets columns of one row; an empty dict does nothing and gives False, an unknown key is no error."""
    if not values:
        return False
    table = Table.at(spark, root, path)
    text = {k: None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for k, v in values.items()}
    change = spark.createDataFrame([(key, *text.values(), 0)], ", ".join([f"`{c}` string" for c in ("fhrsid", *text)] + ["csv_ordinal bigint"]))
    master = table.read()
    if updates.update_summary(change, master).first().n_error:
        return False
    updates.update_table(table, change)
    return True


def displayed(elements: DataFrame, text: str = "text") -> DataFrame:
    """What a user is shown of JSON elements (texts): those that are objects, flattened by the fields that occur."""
    v = unused("v", elements)
    objects = elements.withColumn(v, F.try_parse_json(text)).drop(text).where(F.schema_of_variant(v).startswith("OBJECT"))
    return flatten_variant(objects, v)


def display(df: DataFrame, rows: int = 20) -> str:
    """The first rows as text."""
    return df._show_string(rows, False)
