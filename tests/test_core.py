"""Behaviour of the core library: coercion, names, sources, ingest, store, updates, insights, workflows."""

import csv
import datetime
import io
import json
import random
import uuid
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import schemas
from ledgerline.errors import InvalidTablePath, NameCollision, SourceError
from ledgerline.functions import coerce
from ledgerline.functions.names import sanitize, sanitize_all
from ledgerline.operators import flatten, ingest, insights, recent, store, updates
from ledgerline.plans import queries, workflows
from ledgerline.sources import records, splits, uploads
from ledgerline.sources.master import load_master
from ledgerline.streaming.landing import ingest_stream

DAY = datetime.date(2024, 5, 6)


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[0] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_canonical_id(spark):
    raw = ["0123", " 12 ", "+5", "-0", "1_000", "12.0", "", "00", "-007", "9" * 23, "_1", "1__0", "ABC", "\t7\n", None, "0"]
    assert values(spark, raw, coerce.canonical_id) == ["123", "12", "5", "0", "1000", "12.0", "", "0", "-7", "9" * 23, "_1", "1__0", "ABC", "7", None, "0"]


def test_numbers_flags_dates(spark):
    assert values(spark, ["1", " 2.5 ", "1d", "nan", "inf", "", "0x10", "1_0", ".5", "1e2", None], coerce.to_double) == [1.0, 2.5, None, None, None, None, None, None, 0.5, 100.0, None]
    assert values(spark, ["1", "2.0", "2.5", "x", "1e30", "1e3", " +7 ", "1.00000000001", None], coerce.to_long) == [1, 2, None, None, None, 1000, 7, None, None]
    large = ["9007199254740993", "-9007199254740993.0", "9007199254740993.5", str(2**63 - 1), str(2**63), str(-(2**63)), "9223372036854775807.0", "9223372036854775808.0"]
    assert values(spark, large, coerce.to_long) == [2**53 + 1, -(2**53) - 1, None, 2**63 - 1, None, -(2**63), 2**63 - 1, None]
    assert values(spark, ["true", "FALSE", "True", "yes", "1", " true ", None], coerce.to_bool) == [True, False, True, None, None, None, None]
    assert values(spark, ["2024-01-02", "2024-01-02 03:04:05", "soon", None], coerce.to_date) == [datetime.date(2024, 1, 2)] * 2 + [None, None]
    assert values(spark, ["val'ue", "x", None], coerce.strip_quotes) == ["value", "x", None]
    assert values(spark, [None, "already_reviewed"], coerce.fill_review) == ["not reviewed", "already_reviewed"]
    assert values(spark, [None, "1"], coerce.id_to_string) == [None, "1"]
    nan = spark.createDataFrame([(float("nan"),), (1.5,), (None,)], "x double").select(coerce.nan_to_null(F.col("x"))).collect()
    assert [r[0] for r in nan] == [None, 1.5, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        values(spark, ["soon"], coerce.to_date_strict)
    stamp = spark.createDataFrame([(datetime.datetime(2024, 9, 12, 3),)], "x timestamp_ntz")
    assert stamp.select(coerce.stringify_date(F.col("x"), T.TimestampNTZType())).first()[0] == "2024-09-12"
    assert values(spark, ["12 September 2024"], lambda c: coerce.stringify_date(c, T.StringType())) == ["12 September 2024"]


def test_names():
    names = {"Scores.Hygiene": "scoreshygiene", "?xml": "xml", "@version": "version", "Post Code": "post_code", "___": "unnamed_column", "first_seen": "first_seen", "a - b": "a___b", "": "unnamed_column", "x!!y": "x_y", "Geocode.Latitude": "geocodelatitude"}
    assert {n: sanitize(n) for n in names} == names
    with pytest.raises(NameCollision):
        sanitize_all(["a.b", "AB"])


def test_type_names(spark):
    schema = T.StructType([T.StructField(n, k) for n, k in [("id", T.LongType()), ("name", T.StringType()), ("day", T.TimestampType()), ("score", T.DoubleType()), ("is_new", T.BooleanType()), ("d", T.DateType()), ("s", T.ShortType())]])
    assert schemas.infer_schema(schema) == [("id", "INTEGER"), ("name", "STRING"), ("day", "TIMESTAMP"), ("score", "FLOAT"), ("is_new", "BOOLEAN"), ("d", "STRING"), ("s", "INTEGER")]


def envelope(array):
    return json.dumps({"FHRSEstablishment": {"EstablishmentCollection": {"EstablishmentDetail": array}}})


def test_parsing_responses(spark):
    record = {"FHRSID": 1, "BusinessName": "A", "Scores": {"Hygiene": "5"}, "Geocode": None, "Unknown": [1]}
    bodies = [envelope([record, 7, {"FHRSID": "2"}, None, "x"]), envelope([]), envelope(None), envelope({"FHRSID": "9"}), json.dumps({"FHRSEstablishment": {}}), json.dumps({}), "no json", json.dumps({"FHRSEstablishment": None})]
    responses = spark.createDataFrame(list(enumerate(bodies)), "call_ordinal int, body string")
    rows = records.parse(responses).orderBy("pos").collect()
    assert [(r.call_ordinal, r.pos, r.FHRSID, r.BusinessName, r.Scores.Hygiene, r.Scores.Structural) for r in rows] == [(0, 0, "1", "A", "5", None), (0, 2, "2", None, None, None)]
    assert [r.n_results for r in records.record_count(responses).orderBy("call_ordinal").collect()] == [5, 0, 0, 0, 0, 0, 0, 0]


def batch(spark, rows):
    return spark.createDataFrame([(i, n, 0, k, "dropped") for k, (i, n) in enumerate(rows)], "FHRSID string, BusinessName string, call_ordinal int, pos int, extra string")


def master(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "fhrsid string")


@pytest.mark.parametrize(
    ("known", "incoming", "new"),
    [
        (["123", "ABC"], [("123", "a"), ("789", "b"), ("ABC", "c"), ("XYZ", "d")], {"789": "b", "XYZ": "d"}),
        ([], [("1", "a")], {"1": "a"}),
        (["1"], [("789", "A"), ("101", "x"), ("789", "B")], {"789": "A", "101": "x"}),
        (["123", "456", "ABC", "M1X", None], [("0123", ""), ("456", ""), ("ABC", ""), ("M1X", ""), ("0789", ""), ("DEF", ""), ("A2Y", ""), (None, "")], {"789": "", "DEF": "", "A2Y": ""}),
        (["0007"], [("7", "x"), (" 7 ", "y")], {}),
    ],
)
def test_new_records(spark, known, incoming, new):
    rows = ingest.ingest_new(batch(spark, incoming), master(spark, known), DAY)
    assert rows.columns == schemas.KEEP_COLUMNS
    found = rows.collect()
    assert {r.FHRSID: r.BusinessName for r in found} == new and len(found) == len(new)
    assert all((r.first_seen, r.manual_review, r.gemini_insights) == (DAY, "not reviewed", None) for r in found)


def test_flattening_and_projection(spark):
    nested = spark.createDataFrame([(1, ((2, "x"), 3), [1])], "a int, b struct<c: struct<d int, e string>, f int>, g array<int>")
    assert flatten.flatten(nested).columns == ["a", "b.c.d", "b.c.e", "b.f", "g"]
    assert tuple(flatten.flatten(nested).first()) == (1, 2, "x", 3, [1])
    new = ingest.ingest_new(batch(spark, [("5", "n")]), master(spark, []), DAY)
    projected = flatten.append_projection(new)
    assert projected.columns == ["fhrsid", "businessname", "addressline1", "addressline2", "addressline3", "postcode", "ratingvalue", "localauthorityname", "newratingpending", "first_seen", "manual_review"]
    assert flatten.present(new, ["postcode", "FHRSID", "none"]).columns == ["FHRSID"]


def test_whole_records_are_typed(spark):
    rows = spark.createDataFrame([("1", ("5", "x"), ("1.5", "bad"), "TRUE", "soon")], "FHRSID string, Scores struct<Hygiene string, Structural string>, Geocode struct<Longitude string, Latitude string>, NewRatingPending string, first_seen string")
    assert flatten.full_write_projection(rows).first().asDict() == {"fhrsid": "1", "scoreshygiene": 5, "scoresstructural": "x", "newratingpending": True, "geocodelongitude": 1.5, "geocodelatitude": None, "first_seen": None}


def test_store(spark, tmp_path):
    table = store.Table.at(spark, str(tmp_path), "proj.dset.t")
    with pytest.raises(SourceError):
        table.read()
    df = spark.createDataFrame([(1, "a", "false", "1.5"), (2, None, "true", "x")], "fhrsid int, `Business Name` string, NewRatingPending string, `Geocode.Latitude` string")
    store.write_table(table, df, df.columns)
    assert sorted(map(tuple, table.read().collect())) == [("1", "a", False, 1.5), ("2", None, True, None)]
    store.write_table(table, df.limit(1), df.columns[:2])
    assert table.read().columns == ["fhrsid", "business_name"] and table.rows() == 1
    wide = spark.createDataFrame([("x", "extra", "7")], "business_name string, extra_field string, fhrsid string")
    schema = T.StructType([T.StructField("fhrsid", T.StringType()), T.StructField("business_name", T.StringType())])
    store.append_table(table, wide, schema)
    store.append_table(table, wide.limit(0), schema)
    assert table.rows() == 2
    numeric = store.prepare_append(spark.createDataFrame([("5",), ("x",)], "fhrsid string"), T.StructType([T.StructField("fhrsid", T.LongType())]))
    assert [r[0] for r in numeric.collect()] == [5, None]
    with pytest.raises(SourceError, match="missing"):
        store.prepare_append(wide.drop("business_name"), schema)
    for bad in ("proj.dset", "invalid", "", "proj..table", ".dset.table", "a.b.c.d"):
        with pytest.raises(InvalidTablePath):
            store.split_path(bad)


MASTER = [("1", "a", 5, True), ("2", "b", 6, False), ("test'x", "c", 7, None), (None, "d", 8, None)]


def test_updates(spark):
    base = spark.createDataFrame(MASTER, "fhrsid string, name string, n bigint, flag boolean")
    change = spark.createDataFrame(
        [("001", "val'ue", "100", "True", 0), ("2", "first", "1", "false", 1), ("2", "last", None, None, 2), ("2", "bad", "x", None, 3), ("test'x", None, "9", "FALSE", 4), ("77", "none", "1", None, 5), (None, "z", "1", None, 6)],
        "fhrsid string, name string, n string, flag string, csv_ordinal bigint",
    )
    out = {r.fhrsid: (r.name, r.n, r.flag) for r in updates.update_overlay(base, change).collect()}
    assert out == {"1": ("value", 100, True), "2": ("last", None, None), "test'x": (None, 9, False), None: ("d", 8, None)}
    assert updates.update_summary(change, base).first().asDict() == {"n_success": 5, "n_error": 2}
    assert updates.update_summary(change.select("fhrsid", "csv_ordinal"), base).first().n_error == 7
    with pytest.raises(SourceError):
        updates.update_overlay(base, change.withColumn("nope", F.lit("")))


@pytest.mark.parametrize(
    ("content", "expect"),
    [
        ("fhrsid,colA\n1,x\n2,y\n", [("1", "x"), ("2", "y")]),
        ("FHRSID,colA\n7,\n", [("7", None)]),
        ("fhrsid,colA\n1\n", [("1", None)]),
        ("fhrsid,colA\n,x\n", [(None, "x")]),
        ('fhrsid,colA\n1,"a,\nb"\n', [("1", "a,\nb")]),
        ("other,colA\n1,x\n", "missing"),
        ("", "empty"),
        ("fhrsid,colA\n", "empty"),
        ("fhrsid,colA\n1,x,3\n", "more cells"),
    ],
)
def test_csv(spark, tmp_path, content, expect):
    path = tmp_path / "u.csv"
    path.write_text(content)
    if isinstance(expect, str):
        with pytest.raises(SourceError, match=expect):
            uploads.read_updates(spark, str(path))
    else:
        assert [(r.fhrsid, r.colA) for r in uploads.read_updates(spark, str(path)).orderBy("csv_ordinal").collect()] == expect
    with pytest.raises(SourceError):
        uploads.read_updates(spark, str(tmp_path / "none.csv"))


def test_json_files_and_coordinates(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":\n 1}')
    (tmp_path / "b.json").write_text('{"a":')
    assert records.read_json(spark, str(tmp_path / "a.json")).first().a == 1
    for bad in ("b.json", "none.json"):
        with pytest.raises(SourceError):
            records.read_json(spark, str(tmp_path / bad))
    assert uploads.coordinates(spark, "\n\n1.0,1.0\n\na,b\n1\n1,2,3\n -0.5 , 51 \nnan,1\n") == ([(1.0, 1.0), (-0.5, 51.0)], [3, 4, 5, 7])


def test_recent(spark, tmp_path):
    days = [DAY - datetime.timedelta(d) for d in (0, 6, 7, -3)]
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "first_seen date")
    assert {r[0] for r in recent.recent_rows(df, 7, DAY).collect()} == {days[0], days[1], days[3]}
    df.write.parquet(str(tmp_path / "d"))
    plan = recent.recent_rows(spark.read.parquet(str(tmp_path / "d")), 7, DAY)._jdf.queryExecution().toString()
    assert "GreaterThan(first_seen" in plan
    for n in (0, 366):
        with pytest.raises(ValueError):
            recent.recent_rows(df, n)
    table = store.Table(spark, str(tmp_path / "staged"))
    assert not recent.stage(None, table) and not recent.stage(df.limit(0), table) and not table.exists()
    assert recent.stage(df, table) and table.rows() == 5


def test_insights(spark, tmp_path):
    rows = [("1", "N", "a", None, "c", "P", None), ("2", "M", "a", "b", "c", "P", ""), ("3", "K", None, None, None, None, "done"), ("4", "L", None, None, None, None, None)]
    staged = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in schemas.INSIGHTS))
    said = lambda prompts, options: [None if " in " not in p or p.startswith("Q: L") else f"{options.seed}|{p}" for p in prompts]
    table = store.Table(spark, str(tmp_path / "results"))
    out = {r.fhrsid: r.gemini_insights for r in insights.insight_pipeline(staged, table, "Q: ", said).collect()}
    assert out == {"1": "0|Q: N in a  c P" + insights.PROMPT_END, "2": "0|Q: M in a b c P" + insights.PROMPT_END}
    assert table.rows() == 3
    assert {r.fhrsid for r in insights.insight_pipeline(staged, table, "Q: ").collect()} == {"1", "2", "4"}


class Answers:
    """A service that fails once for each prompt, then answers; prompts with 'never' fail for good."""

    def __init__(self):
        self.seen = set()

    def __call__(self, url, headers, body):
        call = json.loads(body)
        assert url == "http://model" and headers["X-Key"] == "k" and call["seed"] == 0 and call["model"] == "gemini-2.0-flash-001"
        if "never" in call["prompt"]:
            return 400, ""
        if call["prompt"] not in self.seen:
            self.seen.add(call["prompt"])
            raise OSError("down")
        return 200, json.dumps({"candidates": [{"text": "about " + call["prompt"]}]})


def test_model_service(spark):
    service = insights.Service("http://model", ("candidates", 0, "text"), lambda: {"X-Key": "k"}, Answers(), pause=0)
    rows = spark.createDataFrame([("a",), ("never",), ("b",)], "p string").coalesce(1)
    assert [r.gemini_insights for r in insights.generate(rows, F.col("p"), service).collect()] == ["about a", None, "about b"]
    for answer in ((200, "no json"), (200, "{}"), (500, ""), (429, "")):
        assert insights.Service("http://model", post=lambda *_, a=answer: a, pause=0)(["x"], insights.ModelOptions()) == [None]


def test_keys_and_values(spark):
    rows = spark.createDataFrame([("1",), ("01",), (" 1 ",), ("-0",), ("x",), ("1.0",), (None,)], "k string")
    for ids, expect in ((["+0_1"], ["1", "01", " 1 "]), (["0"], ["-0"]), (["x", "1.0"], ["x", "1.0"]), (["-5", "1__0"], [])):
        assert [r.k for r in ingest.find_keys(rows, "k", *ids).collect()] == expect
    assert {r.k for r in ingest.distinct_values(rows.union(rows), "k").collect()} == {r.k for r in rows.collect()}


def spoil(table, keep):
    """Overwrites the rows in all files of the buckets that aren't in `keep`: whoever reads one of them fails. Footers stay."""
    spoiled = 0
    for d in Path(table.folder).glob("bucket_of_*=*"):
        if int(d.name.split("=")[1]) not in keep:
            for f in d.glob("*.parquet"):
                whole = f.read_bytes()
                footer = len(whole) - 8 - int.from_bytes(whole[-8:-4], "little")
                f.write_bytes(whole[:4] + b"\xff" * (footer - 4) + whole[footer:])
                (d / f".{f.name}.crc").unlink(missing_ok=True)
                spoiled += 1
    return spoiled


def test_an_update_rewrites_its_buckets_only(spark, tmp_path):
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.threshold", "5000")  # else each listing is a job of 1,000 tasks
    table = store.Table(spark, str(tmp_path / "t"))
    rows = spark.range(3000).select(F.format_string("%04d", "id").alias("fhrsid"), F.col("id").alias("n"), F.lit("x").alias("name"))
    table.overwrite(rows, "fhrsid", 1000)
    assert table.layout() == store.Layout("fhrsid", 1000) and table.read().columns == rows.columns and table.rows() == 3000
    change = spark.createDataFrame([("17", "5", 0), ("+0017", "6", 1), ("99999", "1", 2)], "fhrsid string, n string, csv_ordinal int")
    ids = spark.createDataFrame([("17",), ("99999",)], "k string")
    touched = table.buckets_of(ids, "k")
    assert 1 <= len(touched) <= 2
    assert spoil(table, touched) > 900
    files = {f: f.stat().st_mtime_ns for f in Path(table.folder).rglob("*.parquet")}
    updates.update_table(table, change)
    after = {f: f.stat().st_mtime_ns for f in Path(table.folder).rglob("*.parquet")}
    assert 1 <= len(files.items() - after.items()) <= 2  # of all files only those of the touched buckets are new
    assert [tuple(r) for r in table.candidates(ids, "k").where("fhrsid = '0017'").collect()] == [("0017", 6, "x")]
    batch_ = spark.createDataFrame([("17", "a"), ("99999", "b")], "id string, v string")
    assert [r.id for r in ingest.new_records(batch_, table.candidates(batch_, "id"), "id", "fhrsid").collect()] == ["99999"]
    spark.conf.unset("spark.sql.sources.parallelPartitionDiscovery.threshold")


def test_keyed_tables(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "t"))
    schema = "fhrsid string, name string"
    table.overwrite(spark.createDataFrame([], schema), "fhrsid", 8)
    assert table.rows() == 0 and table.layout().key == "fhrsid" and table.read().columns == ["fhrsid", "name"]
    assert table.candidates(spark.createDataFrame([("1",)], "k string"), "k").count() == 0
    for rows in ([("1", "a"), (None, "b")], [], [("01", "c"), ("x'y", "d")]):
        table.append(spark.createDataFrame(rows, schema))
    assert sorted(r.name for r in table.read().collect()) == list("abcd")
    before = table.read()
    table.append(spark.createDataFrame([("9", "e")], schema))
    assert before.count() == 4 and table.rows() == 5  # appends don't change what was read
    keys = lambda *k: spark.createDataFrame([(i,) for i in k], "k string")
    assert {r.name for r in table.candidates(keys("1"), "k").collect()} == {"a", "c"}
    assert table.candidates(keys(None), "k").count() == 0 and table.candidates(keys().limit(0), "k").count() == 0
    many = keys(*map(str, range(store.FEW_KEYS + 5)))
    assert {"a", "c", "e"} <= {r.name for r in table.candidates(many, "k").collect()}
    plan = table.candidates(keys("1", "2"), "k")._jdf.queryExecution().toString()
    assert "EqualTo(canonical_of_fhrsid,1)" in plan and "PartitionFilters: [" in plan
    table.overwrite(table.read().where("name != 'b'"))  # reads what it overwrites, and stays keyed
    assert table.rows() == 4 and table.layout() is not None
    for i in range(5):
        table.append(spark.createDataFrame([("1", f"f{i}")], schema))
    assert table.compact(3) >= 1 and table.compact(3) == 0 and table.rows() == 9
    plain = store.Table(spark, str(tmp_path / "p"))
    plain.append(spark.createDataFrame([("1", "a")], schema))
    assert plain.layout() is None and plain.candidates(keys("7"), "k").count() == 1 and plain.compact() == 0
    updates.update_table(plain, spark.createDataFrame([("001", "z")], schema))
    assert plain.layout().key == "fhrsid" and [tuple(r) for r in plain.read().collect()] == [("1", "z")]


def test_a_failed_overwrite_changes_nothing(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "t"))
    table.overwrite(spark.range(3))
    with pytest.raises(Exception):
        table.overwrite(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")))
    assert table.rows() == 3


CLASHES = ["_id", "_key", "_nth", "_ok", "nth", "NTH", "ok", "id", "changed", "new", "canonical", "known_key", "failures", "hit", "v0", "call", "pos_"]


def test_clashing_columns(spark):
    own = {c: F.lit(f"own {c}") for c in CLASHES if c != "NTH"}
    base = spark.createDataFrame([("1", "a"), ("2", "b")], "fhrsid string, name string").withColumns(own)
    change = spark.createDataFrame([("01", "z", "x")], "fhrsid string, name string, changed string").withColumns({c: F.lit("set") for c in CLASHES if c not in ("NTH", "changed")})
    out = {r.fhrsid: r for r in updates.update_overlay(base, change).collect()}
    assert out["1"].name == "z" and out["1"]["_id"] == "set" and out["1"].changed == "x" and out["2"]["_key"] == "own _key" and list(out["2"].asDict()) == base.columns
    assert updates.update_summary(change, base).first().asDict() == {"n_success": 1, "n_error": 0}
    failed = updates.failed_updates(change.withColumn("fhrsid", F.lit(" ")), base)
    assert failed.columns == [*change.columns, "failures_"] and tuple(failed.first()["failures_"][0]) == ("fhrsid", " ", "no key")
    fresh = spark.createDataFrame([("1", 1), ("7", 2), ("7", 3), (None, 4)], "FHRSID string, n int").withColumns(own)
    got = ingest.new_records(fresh, base, "FHRSID", "fhrsid")
    assert got.columns == fresh.columns and {r.n for r in got.collect()} == {2, 3, 4}
    first = ingest.first_wins(fresh, "FHRSID", "n")
    assert first.columns == fresh.columns and {r.n for r in first.collect()} == {1, 2, 4}
    assert ingest.first_wins(fresh.withColumnRenamed("nth", "NTH"), "FHRSID", "n").columns[2:] == [c.replace("nth", "NTH") if c == "nth" else c for c in own]


def test_failures_are_named(spark):
    base = spark.createDataFrame([("1", 5, True, "a")], "fhrsid string, n bigint, flag boolean, name string")
    change = spark.createDataFrame([("1", "x", "maybe", "q"), ("", "1", None, None), ("2", "7", "true", None), (None, "y", None, None)], "fhrsid string, n string, flag string, name string")
    found = {r.fhrsid: [tuple(f) for f in r.failures] for r in updates.failed_updates(change, base).collect()}
    assert found == {"1": [("n", "x", "no bigint"), ("flag", "maybe", "no boolean")], "": [("fhrsid", "", "no key")], None: [("fhrsid", None, "no key"), ("n", "y", "no bigint")]}
    assert [tuple(f) for f in updates.failed_updates(change.select("fhrsid", F.lit("v").alias("nope")).limit(1), base).first().failures] == [("nope", "v", "no such column")]
    assert updates.failed_updates(change.select("fhrsid").limit(1), base).first().failures[0].reason == "nothing to set"
    # Without csv_ordinal the result is the same in each run.
    twice = spark.createDataFrame([("1", "1"), ("01", "2")], "fhrsid string, n string")
    assert [r.n for r in updates.update_overlay(base, twice).collect()] == [r.n for r in updates.update_overlay(base, twice.orderBy("n")).collect()]


def serve(pages):
    def transport(url):
        if "/1.0/1.0/" in url:
            return 200, envelope(pages)
        if "/2.0/2.0/" in url:
            return 500, ""
        raise OSError("no network")

    return transport


def test_lanes_share_the_rate(spark, tmp_path):
    """Each lane writes down when it waits and calls; together they make a call in a pause, in any number of lanes."""
    for lanes in (1, 3):
        log = tmp_path / f"log{lanes}"
        log.mkdir()
        note = lambda what, log=log: (log / uuid.uuid4().hex).write_text(json.dumps(what)) and None
        calls = spark.createDataFrame([(k, float(k), 0.5) for k in range(7)], "call_ordinal int, longitude double, latitude double")
        transport = lambda url, note=note: (note(["call", url.split("/")[-5]]), (500, "") if "/3.0/" in url else (200, "{}"))[1]
        landed = records.land(calls, 10, str(tmp_path / "landing"), records.through(transport, 4, lanes, lambda s, note=note: note(["wait", s])))
        said = [json.loads(f.read_text()) for f in log.iterdir()]
        assert sorted(w for k, w in said if k == "wait") == sorted([4.0 * lanes] * 7 + [4.0 * k for k in range(1, lanes)])
        assert sorted(w for k, w in said if k == "call") == [f"{k}.0" for k in range(7)]
        assert landed.failures == {3: "status 500"} and sorted(r.call_ordinal for r in landed.responses.collect()) == [0, 1, 2, 4, 5, 6]
    none = records.land(calls.limit(0), 10, str(tmp_path / "landing"), records.through())
    assert none.failures == {} and none.responses.count() == 0
    with pytest.raises(ValueError):
        records.land(calls, 5001, str(tmp_path), records.through())


def test_prompts_are_asked_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def count(prompts, options, down=None):
        for p in prompts:
            if p == down:
                raise OSError("down")
            (log / uuid.uuid4().hex).write_text(p)
        return [None if p == "p7" else f"about {p}" for p in prompts]

    asked = lambda: sorted(f.read_text() for f in log.iterdir())
    rows = spark.createDataFrame([(i, f"p{i % 20}", "own") for i in range(200)] + [(200, None, "own")], "i int, p string, digest string")
    answers = store.Table(spark, str(tmp_path / "answers"))
    with pytest.raises(Exception, match="down"):
        insights.generate_once(rows, F.col("p"), answers, lambda p, o: count(p, o, "p3"), batches=5)
    before = {r.text for r in answers.read().collect()}
    first = asked()
    out = insights.generate_once(rows, F.col("p"), answers, count, batches=5)
    assert out.columns == ["i", "p", "digest", "gemini_insights"]
    assert {(r.p, r.gemini_insights) for r in out.collect()} == {(None, None)} | {(f"p{i}", None if i == 7 else f"about p{i}") for i in range(20)}
    again = asked()
    for text in before:  # what was committed isn't asked again
        assert again.count(text.removeprefix("about ")) == first.count(text.removeprefix("about ")) == 1
    insights.generate_once(rows, F.col("p"), answers, count, batches=5)
    assert asked() == sorted([*again, "p7"])  # only what has no answer


def test_workflows(spark, tmp_path):
    root, path = str(tmp_path / "root"), "proj.dset.master_table"
    table = store.Table.at(spark, root, path)
    empty = spark.createDataFrame([], schemas.MASTER).drop("gemini_insights")
    pages = [{"FHRSID": "0123", "BusinessName": "A", "NewRatingPending": "true"}, {"FHRSID": 5, "BusinessName": "B"}, {"FHRSID": "5"}]
    search = records.through(serve(pages), 0)
    run = lambda landing, text="1.0,1.0\n2.0,2.0\n3.0,3.0\nbad": workflows.fetch_and_append(spark, text, 3, root, path, str(tmp_path / landing), search, DAY)
    with pytest.raises(SourceError):
        run("l0")  # no master yet: never taken for an empty one
    table.overwrite(empty)
    first = run("l1")
    assert first.counts == {"fetched": 3, "new": 2} and first.df.count() == 0
    assert first.warnings == ["line 4: not a coordinate", "call 1: status 500", "call 2: call failed: no network", "call 0: 3 results, maybe cut off"]
    assert run("l2").counts["new"] == 0 and table.rows() == 2
    again = run("l1")  # the same folder: earlier responses don't count again
    assert again.counts == {"fetched": 3, "new": 0}
    assert run("l3", "x").warnings[-1] == "no valid coordinates"
    assert run("l4", "2.0,2.0").counts == {"fetched": 0, "new": 0}
    with pytest.raises(InvalidTablePath):
        workflows.fetch_and_append(spark, "1.0,1.0", 3, root, "proj..table", "x", search)
    table.overwrite(load_master(table).withColumn("gemini_insights", F.lit(None).cast("string")))
    assert workflows.recent_analysis(spark, root, path, 7, DAY).df.count() == 2
    assert workflows.recent_analysis(spark, root, path, 7, DAY + datetime.timedelta(30)).warnings == ["no recent rows"]
    enriched = workflows.enrich_recent(spark, root, path, write_back=True)
    assert enriched.counts == {"generated": 2, "with_text": 2} and not enriched.warnings
    found = enriched.df.collect()
    assert {r.fhrsid for r in found} == {"123", "5"} and table.read().where("gemini_insights is null").isEmpty()
    (tmp_path / "u.csv").write_text("FHRSID,postcode,newratingpending\n00123,N1 'x,FALSE\n5,N2,maybe\n99,N3,true\n")
    done = workflows.update_from_csv(spark, root, path, str(tmp_path / "u.csv"))
    assert done.counts == {"n_success": 2, "n_error": 1} and done.warnings == ["1 rows failed"]
    assert [(r.fhrsid, *r.failures[0]) for r in done.shown.collect()] == [("5", "newratingpending", "maybe", "no boolean")]
    assert {(r.fhrsid, r.postcode, r.newratingpending) for r in table.read().collect()} == {("123", "N1 x", False), ("5", None, None)}
    assert workflows.update_row(spark, root, path, "5", {"postcode": "Z", "newratingpending": True}) and not workflows.update_row(spark, root, path, "5", {})
    assert {(r.fhrsid, r.postcode, r.newratingpending) for r in table.read().collect()} == {("123", "N1 x", False), ("5", "Z", True)}
    assert "postcode" in workflows.display(table.read())


def test_stream(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "m"))
    table.overwrite(spark.createDataFrame([("1",)], "fhrsid string").select("fhrsid", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.MASTER.fields[1:-1]]))
    landing = str(tmp_path / "landing")
    spark.createDataFrame([(0, 0.0, 0.0, envelope([{"FHRSID": "1"}, {"FHRSID": "2"}]))], records.RESPONSES).write.parquet(landing)
    for _ in range(2):
        ingest_stream(spark, landing, table, str(tmp_path / "state"), DAY).awaitTermination()
    assert sorted(r.fhrsid for r in table.read().collect()) == ["1", "2"]


def test_caps_and_counts(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "call int, x int")
    assert {r.call: (r.n_results, r.maybe_capped) for r in ingest.cap_check(df, "call", 2).collect()} == {0: (2, True), 1: (1, False)}
    b = batch(spark, [("1", "a"), ("2", "b")])
    assert tuple(ingest.ingest_summary(b, ingest.ingest_new(b, master(spark, ["1"]), DAY)).first()) == (2, 1)


@pytest.fixture
def split(spark):
    """Sets the bytes of a block; what was set before comes back."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("size", [90, 97, 400])
def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path, split, size):
    rnd = random.Random(size)
    rows = [(str(i), "".join(rnd.choice(["a", '"', ",", "\n", "\r\n", "é", 'x"y']) for _ in range(rnd.randint(0, 25)))) for i in range(120)]
    rows[50] = ("50", "line\n" * 150)  # longer than several blocks
    with open(tmp_path / "u.csv", "w", newline="") as f:
        w = csv.writer(f, lineterminator="\r\n" if size == 97 else "\n")
        w.writerows([("FhrsID", "v"), *rows])
    split(size)
    got = uploads.read_updates(spark, str(tmp_path / "u.csv"))
    assert got.rdd.getNumPartitions() > 10
    assert [(r.fhrsid, r.v) for r in got.orderBy("csv_ordinal").collect()] == [(i, v or None) for i, v in rows]
    (tmp_path / "open.csv").write_text('fhrsid,v\n1,x\n2,"y\n' + "z\n" * 100)
    with pytest.raises(SourceError, match="doesn't end"):
        uploads.read_updates(spark, str(tmp_path / "open.csv"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text('a",\n', max_size=6), min_size=1, max_size=3), min_size=1, max_size=4))
def test_open_cells_are_followed(rows):
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    is_open, ends = False, 0
    for line in text.getvalue().split("\n")[:-1]:
        is_open = splits.open_after(line, is_open)
        ends += not is_open
    assert not is_open and ends == len(rows)


def odd_value(rnd, depth=0):
    kind = rnd.randint(0, 5)
    if kind == 0:
        return "".join(rnd.choice('a"\\{}[],:\n é') for _ in range(rnd.randint(0, 12)))
    if kind == 1 and depth < 3:
        return {f"k{i}": odd_value(rnd, depth + 1) for i in range(rnd.randint(0, 3))}
    if kind == 2 and depth < 3:
        return [odd_value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    return rnd.choice([None, True, -1.5, "x", 7])


@pytest.mark.parametrize(("size", "indent"), [(150, None), (400, 1)])
def test_one_json_array_is_read_by_many_tasks(spark, tmp_path, split, size, indent):
    rnd = random.Random(size)
    values = [*(odd_value(rnd) for _ in range(100)), {"long": "} ]" * 500}, [], "", None]
    (tmp_path / "a.json").write_text(json.dumps(values, indent=indent))
    split(size)
    found = splits.json_elements(spark, str(tmp_path / "a.json"))
    assert found.rdd.getNumPartitions() > 5
    assert [json.loads(r.text) for r in found.orderBy("file", "block", "place").collect()] == values
    records_ = [{"id": i, "n": {"a": i / 2, "t": "}"}} for i in range(60)]
    (tmp_path / "r.json").write_text(json.dumps(records_, indent=indent))
    df = records.read_json(spark, str(tmp_path / "r.json"))
    assert df.schema.simpleString() == "struct<id:bigint,n:struct<a:double,t:string>>"
    assert sorted(map(tuple, flatten.flatten(df).collect())) == [(i, i / 2, "}") for i in range(60)]
    (tmp_path / "r.json").write_text(json.dumps(records_)[:-1])
    with pytest.raises(SourceError, match="doesn't end"):
        records.read_json(spark, str(tmp_path / "r.json"))
    for bad in ("[1] [2]", "[1]x"):
        (tmp_path / "r.json").write_text(bad)
        with pytest.raises(Exception, match="more than one array|follows the array"):
            splits.json_elements(spark, str(tmp_path / "r.json")).collect()


def test_flattening_by_what_occurs(spark):
    rows = ['{"a": 1, "b": {"c": "x", "d.e": true}}', '{"a": 2.5, "b": {"f": [1, 2]}}', '{"b": 7, "g": null, "A b": {"c\'d": 1}}', "[1]", None]
    df = spark.createDataFrame([(i, r, "own") for i, r in enumerate(rows)], "i int, r string, a string").select("i", "a", F.parse_json("r").alias("v"))
    out = flatten.flatten_variant(df, "v")
    assert out.columns == ["i", "a", "A b.c'd", "a_", "b", "g"]
    assert [tuple(r) for r in out.orderBy("i").collect()] == [
        (0, "own", None, 1.0, '{"c":"x","d.e":true}', None), (1, "own", None, 2.5, '{"b":1}'.replace('"b":1', '"f":[1,2]'), None), (2, "own", 1, None, "7", None),
        (3, "own", None, None, None, None), (4, "own", None, None, None, None),
    ]
    nested = flatten.flatten_variant(df.where("i < 2"), "v")
    assert nested.columns == ["i", "a", "a_", "b.c", "b.d.e", "b.f"] and [tuple(r)[3:] for r in nested.orderBy("i").collect()] == [("x", True, None), (None, None, [1, 2])]
    assert flatten.flatten_variant(df.where("i > 2"), "v").columns == ["i", "a"]


def test_what_is_shown(spark):
    elements = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}', 1), ("7", 2), ("no json", 3), (None, 4), ('{"d": [1]}', 5)], "text string, v int")
    shown = workflows.displayed(elements)
    assert shown.columns == ["v", "a", "b.c", "d"] and sorted(map(tuple, shown.collect())) == [(1, 1, "x", None), (5, None, None, [1])]


def test_csv_of_several_files(spark, tmp_path):
    rows = spark.range(0, 400, 1, 8).select(F.col("id").alias("FhrsID"), F.format_string("a,\n%d", "id").alias("name"))
    rows.write.option("header", True).csv(str(tmp_path / "parts"))
    got = uploads.read_updates(spark, str(tmp_path / "parts"))
    assert got.rdd.getNumPartitions() > 1
    assert [(r.fhrsid, r.name) for r in got.orderBy("csv_ordinal").collect()] == [(str(i), f"a,\n{i}") for i in range(400)]


def test_responses_are_bounded_pages(spark, tmp_path):
    spark.range(1, 5001).selectExpr("cast(id as int) c_custkey", "concat('n', id) c_name", "cast(id % 3 % 2 as int) c_nationkey", "1.5D c_acctbal").write.parquet(str(tmp_path / "customer.parquet"))
    assert records.record_count(queries._responses(spark, str(tmp_path))).agg(F.max("n_results")).first()[0] <= 1000
    of = {n: [i for i in range(1, 5001) if i % 3 % 2 == n] for n in (0, 1)}
    expect = sorted((n, pos, False, str(i), f"n{i}") for n, ids in of.items() for pos, i in enumerate(ids) if i % 7)
    assert sorted(tuple(r) for r in queries.fetch_union(spark, str(tmp_path)).collect()) == expect
    assert {tuple(r) for r in queries.record_count(spark, str(tmp_path)).collect()} == {(n, len(ids)) for n, ids in of.items()}
