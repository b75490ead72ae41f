"""CSV files with keyed updates, and coordinate lists."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from ..functions.coerce import to_double
from .splits import csv_records

ID = "fhrsid"


#: A cell's quote is doubled inside it; lines may break in quoted cells.
CSV = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}


def read_updates(spark: SparkSession, path: str, id_column: str = ID) -> DataFrame:
    """The rows of a file, or of a folder's files by name, as texts, with csv_ordinal, their file and
    place in it; the id column is `fhrsid`.

    Blank cells are null, and so are the missing cells of short rows. Errors: no data, a header only,
    no column with the id's name in any case (the first one counts), a row with more cells than the
    header, a quoted cell without an end. Quotes in a quoted cell are doubled. The header is the first line of each file. A large
    file is read by many tasks, also where lines of quoted cells break.
    """
    try:
        head = spark.read.text(path).limit(1).collect()
    except Exception as e:
        raise SourceError(f"{path}: {str(e).splitlines()[0]}") from e
    if not head or not head[0][0].strip():
        raise SourceError(f"{path}: empty or contains no data")
    names = next(csv.reader([head[0][0].removeprefix("\ufeff")]))
    at = next((i for i, n in enumerate(names) if n.strip().lower() == id_column), None)
    if at is None:
        raise SourceError(f"{path}: the column {id_column!r} is missing")
    names[at] = id_column
    schema = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    cells = F.from_csv("text", schema, CSV).alias("cells")
    rows = csv_records(spark, path).select(F.struct("file", "block", "place").alias("csv_ordinal"), cells)
    state = rows.agg(F.count("*").alias("n"), F.count(F.col("cells")[f"c{len(names)}"]).alias("long")).first()
    if not state.n:
        raise SourceError(f"{path}: empty")
    if state.long:
        raise SourceError(f"{path}: {state.long} rows have more cells than the header")
    return rows.select(*[F.col("cells")[f"c{i}"].alias(n) for i, n in enumerate(names)], "csv_ordinal")


def parse_coordinates(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with longitude, latitude and ok: exactly two numbers with a comma between them.

    Blank lines are dropped. The range isn't checked.
    """
    parts = F.split(F.col(line), ",")
    lon, lat = (to_double(F.get(parts, F.lit(i))) for i in (0, 1))
    ok = (F.size(parts) == 2) & lon.isNotNull() & lat.isNotNull()
    return lines.where(F.trim(line) != "").select("*", F.when(ok, lon).alias("longitude"), F.when(ok, lat).alias("latitude"), ok.alias("ok"))


def coordinates(spark: SparkSession, text: str) -> tuple[list[tuple[float, float]], list[int]]:
    """The valid coordinates of a text in order, and the numbers (from 1) of its bad lines.

    Numbers count lines after the whole text is stripped.
    """
    lines = list(enumerate(text.strip().split("\n"), 1))
    rows = parse_coordinates(spark.createDataFrame(lines, "number int, line string")).orderBy("number").collect()
    return [(r.longitude, r.latitude) for r in rows if r.ok], [r.number for r in rows if not r.ok]
