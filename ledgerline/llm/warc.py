"""WARC archives as chunked record tables.

A page becomes one WARC/1.1 record. Spark cuts its payload into rows of (record, chunk number), CHUNK bytes at
most; Python sees one chunk after the other and carries the running SHA-1 of the payload so far, so no task
holds a record beside the cell it was read from. A chunk is a WARC segment, later ones are `continuation`
records. Spark's text writer and reader move the bytes, so archives may be in any store that Spark reaches.

The reader separates records at the version line. The writer ends a segment inside any payload bytes
that look like that line, alone or with the record end behind them, and puts a blank behind a url that
ends so; thus the line stands before records only. Reading back sorts segments by record and
number and folds them one by one: memory holds one chunk and a digest.

Of payloads of `least` bytes or more that are equal, the record with the largest page_id is a response
and the others revisit it, without a payload; they carry length and digest of the full one. Which digests
occur more than once is found without the payloads, as a table, which Spark broadcasts if it is small.

Defined results: a null html is an empty payload; rows with the same page_id and payload are responses
alike; a null page_id is below all others and, alone among equals, a response; a null url is an empty
one; control characters in a url become blanks; extra columns are not read. page_id may have any type that
casts to text and back; `read` is told the type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, materialize, utf8

CHUNK = 1 << 20
LEAST = 1000
#: Of all pages with a repeated payload; see `decide`.
SHARE = 1e-3
NAME = b"WARC/1.1"
VERSION = NAME + b"\r\n"
END = "\r\n\r\n"


def cuts(payload: bytes, chunk: int) -> list[int]:
    """Where the segments of a payload end: after a chunk, or inside what looks like a version line.

    A segment that ends in the version would become such a line by the record end behind it.
    """
    ends, start = [], 0
    while True:
        end = min(start + chunk, len(payload))
        seen = payload.find(VERSION, start, end)
        if seen >= 0:
            end = seen + 4
        elif payload.endswith(NAME, start, end):
            end -= 4
        ends.append(end)
        if end >= len(payload):
            return ends
        start = end


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, kind (response or revisit) and keeper, the response's page_id.

    Digests with more than SHARE of all repeated pages, fewer than 1 / SHARE by their share, are broadcast with their
    keepers. Where the other ones need a shuffle, pages that need no look-up, short ones included, are spread by
    their ids, so no digest, and no lack of one, brings many pages to one task.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), utf8(F.col("html")).alias("payload"))
    digest = F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256)))
    keys = rows.select("page_id", digest.alias("key")).where("key is not null")
    several = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("top")).where("n > 1 and top is not null")
    several = materialize(several.select("key", "top", "n"), "repeated")
    least_hot = SHARE * (several.agg(F.sum("n")).first()[0] or 0)
    hot = several.where(F.col("n") > least_hot).select("key", F.col("top").alias("hot"))
    rest = several.where(F.col("n") <= least_hot).select(F.col("key").alias("place"), F.col("top").alias("rare"))
    known = rows.withColumn("key", digest).join(F.broadcast(hot), "key", "left")
    apart = F.xxhash64("page_id", F.octet_length("payload")).cast("string").cast("binary")  # shorter than any digest
    place = F.when(F.col("hot").isNull(), F.coalesce("key", apart)).otherwise(apart)
    joined = known.withColumn("place", place).join(rest, "place", "left").withColumn("top", F.coalesce("hot", "rare"))
    revisit = F.expr("top is not null and (page_id is null or page_id < top)")
    return joined.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("top")).alias("keeper"))


def chunk_rows(decided: DataFrame, chunk: int = CHUNK, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """record_id, chunk_no, running_sha1 and record: header and bytes of each segment."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, number, total = hashlib.sha1(), 0, 0
        for b in batches(it):
            out, held = [], 0
            for r in b.to_pylist():
                if r["chunk"] == 0:
                    running, number, total = hashlib.sha1(), 0, 0
                start, ends = 0, cuts(r["data"], chunk)
                for end in ends:
                    data = r["data"][start:end]
                    running.update(data)
                    number, total, start = number + 1, total + len(data), end
                    last = end == ends[-1] and r["chunk"] == r["chunks"] - 1
                    out.append((r["record_id"], number, running.hexdigest(), segment(r, data, number, running.hexdigest(), total, last, date)))
                    held += len(out[-1][-1])
                if held >= 4 << 20:
                    yield _rows(out)
                    out, held = [], 0
            yield _rows(out)

    text = lambda c: F.url_encode(F.col(c).cast("string"))
    known = decided.select(
        F.uuid().alias("record_id"), text("page_id").alias("page_id"), text("keeper").alias("keeper"), "kind",
        F.regexp_replace("url", r"[\x00-\x1f\x7f]", " ").alias("url"), F.octet_length("payload").alias("full"),
        F.when(F.col("kind") == "revisit", F.sha1("payload")).alias("sha1"), F.when(F.col("kind") == "response", F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
    )
    counted = known.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk).cast("int")))
    rows = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("data", F.expr(f"substring(payload, chunk * {chunk} + 1, {chunk})")).drop("payload")
    return rows.mapInArrow(run, "record_id string, chunk_no int, running_sha1 string, record binary")


def segment(r: dict, data: bytes, number: int, running: str, total: int, last: bool, date: str) -> bytes:
    """The bytes of a WARC segment, without the end of the record."""
    record, url = r["record_id"], r["url"]
    head = [
        f"WARC-Type: {r['kind'] if number == 1 else 'continuation'}",
        f"WARC-Record-ID: <urn:uuid:{record}{'' if number == 1 else f'-{number}'}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}{' ' if url.endswith(NAME.decode()) else ''}",
        f"WARC-Segment-Number: {number}",
        f"WARC-Segment-Origin-ID: <urn:uuid:{record}>",
        f"WARC-Running-Digest: sha1:{running}",
        f"Content-Length: {len(data)}",
    ]
    if r["page_id"] is not None:
        head.append(f"WARC-Page-ID: ={r['page_id']}")
    if last:
        head.append(f"WARC-Segment-Total-Length: {total if r['sha1'] is None else r['full']}")
        head.append(f"WARC-Payload-Digest: sha1:{r['sha1'] or running}")
    if r["keeper"] is not None:
        head.append(f"WARC-Refers-To-Page-ID: ={r['keeper']}")
    return VERSION + ("\r\n".join(head) + END).encode() + data


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["record_id", "chunk_no", "running_sha1", "record"])


def write(pages: DataFrame, folder: str, chunk: int = CHUNK, least: int = LEAST) -> None:
    """Writes gzip-compressed archives into a new folder."""
    records = chunk_rows(decide(pages, least), chunk).select(F.col("record").cast("string"))
    records.write.option("lineSep", END).option("compression", "gzip").text(folder)


SEGMENT = pa.schema([
    ("record_id", pa.string()), ("number", pa.int32()), ("page_id", pa.string()), ("kind", pa.string()), ("keeper", pa.string()), ("running_sha1", pa.string()),
    ("payload_sha1", pa.string()), ("total", pa.int64()), ("length", pa.int64()), ("sha1", pa.string()), ("data", pa.binary()),
])
FIELDS = (
    "record_id string, number int, page_id string, kind string, keeper string, running_sha1 string, "
    "payload_sha1 string, total bigint, length bigint, sha1 string, data binary"
)


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of a folder's archives, a row each; ids as texts.

    A record of one segment is digested where it is read and goes on without its bytes.
    """
    raw = spark.read.option("lineSep", VERSION.decode()).text(folder).where("value != ''").select(F.col("value").cast("binary").alias("value"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            yield pa.RecordBatch.from_pylist([parsed(value) for value in b.column("value").to_pylist()], SEGMENT)

    return raw.mapInArrow(run, FIELDS)


def parsed(value: bytes) -> dict:
    """Header fields and bytes of a segment behind its version line."""
    head, _, rest = value.partition(END.encode())
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n") if ": " in line)
    data, number, total = rest[: int(h["Content-Length"])], int(h["WARC-Segment-Number"]), h.get("WARC-Segment-Total-Length")
    alone = number == 1 and total is not None
    id_of = lambda k: unquote_plus(h[k][1:]) if k in h else None
    return {
        "record_id": h["WARC-Segment-Origin-ID"], "number": number, "page_id": id_of("WARC-Page-ID"), "kind": h["WARC-Type"], "keeper": id_of("WARC-Refers-To-Page-ID"),
        "running_sha1": h["WARC-Running-Digest"][5:], "payload_sha1": h.get("WARC-Payload-Digest", "")[5:] or None, "total": None if total is None else int(total),
        "length": len(data), "sha1": hashlib.sha1(data).hexdigest() if alone else None, "data": None if alone else data,
    }


PAGE = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])


def read(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: a row per record.

    Lengths and digests are those of the bytes read; where they differ from the record's own, the
    read fails.
    """
    parts = segments(spark, folder).repartition("record_id").sortWithinPartitions("record_id", "number")

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, digest, size, expect = None, None, 0, 1
        for b in batches(it):
            out = []
            for r in b.to_pylist():
                if r["number"] == 1:
                    first, digest, size, expect = r, hashlib.sha1(), 0, 1
                if first is None or r["record_id"] != first["record_id"] or r["number"] != expect:
                    raise ValueError(f"{r['record_id']}: segment {expect} is missing")
                size, expect = size + r["length"], expect + 1
                if r["data"] is not None:
                    digest.update(r["data"])
                running = r["sha1"] or digest.hexdigest()
                if running != r["running_sha1"]:
                    raise ValueError(f"{r['record_id']}: wrong digest after segment {r['number']}")
                if r["total"] is not None:
                    revisit = first["kind"] == "revisit"
                    if not revisit and (size != r["total"] or running != r["payload_sha1"]):
                        raise ValueError(f"{r['record_id']}: wrong length or digest")
                    sha1 = r["payload_sha1"] if revisit else running
                    out.append({"page_id": r["page_id"], "payload_bytes": r["total"], "payload_digest": sha1, "record_type": first["kind"], "refers_to": first["keeper"]})
                    first = None
            yield pa.RecordBatch.from_pylist(out, PAGE)

    pages = parts.mapInArrow(fold, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return pages.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
