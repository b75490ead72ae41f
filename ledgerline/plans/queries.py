"""The registered queries of the core library, each with the SQL that gives the same rows.

The driver's tables have no nulls and no badly typed values, so both sides derive some.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import coerce
from ..functions.names import sanitize_columns
from ..operators import flatten, ingest, insights, recent, store, updates
from ..sources import records, uploads
from ..sources.master import load_master
from . import workflows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DAY = datetime.date(2001, 8, 1)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# What several pieces of SQL share.
def _canon(x: str) -> str:
    d = rf"regexp_replace(regexp_replace({x}, '[_+\s]', '', 'g'), '^(-?)0+([0-9])', '\1\2')"
    return rf"CASE WHEN regexp_full_match({x}, '\s*[+-]?[0-9]+(_[0-9]+)*\s*') THEN CASE WHEN {d} = '-0' THEN '0' ELSE {d} END ELSE {x} END"


def _number(x: str) -> str:
    return rf"CASE WHEN regexp_full_match({x}, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


RAW_ID = (
    "CASE {0} % 8 WHEN 0 THEN concat('00', {0}) WHEN 1 THEN concat(' ', {0}, ' ') WHEN 2 THEN concat('+', {0}) WHEN 3 THEN concat({0}, '.0') WHEN 4 "
    "THEN concat('1_', {0}) WHEN 5 THEN concat('A', {0}) WHEN 6 THEN '-00' ELSE CAST({0} AS {1}) END"
)
RAW_NUMBER = (
    "CASE {0} % 9 WHEN 0 THEN '1d' WHEN 1 THEN 'nan' WHEN 2 THEN '' WHEN 3 THEN '0x10' WHEN 4 THEN concat({0}, '.5') WHEN 5 THEN concat({0}, 'e2') "
    "WHEN 6 THEN ' 7 ' WHEN 7 THEN concat({0}, '.0') ELSE NULL END"
)
BATCH_ID = (
    "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN concat('00', user_id) WHEN event_id % 3 = 1 THEN concat(' ', user_id, ' ') "
    "ELSE CAST(user_id AS {0}) END"
)
EVENT_BATCH = f"(SELECT {_canon('raw')} AS id, event_type, event_id FROM (SELECT {BATCH_ID.format('VARCHAR')} AS raw, event_type, event_id FROM events))"
EVEN = "(SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 2 = 0)"


def _events(spark, sf_dir) -> DataFrame:
    """Events as a batch of incoming records: raw ids, some null, and their order."""
    e = _t(spark, sf_dir, "events")
    return e.select(
        F.expr(BATCH_ID.format("STRING")).alias("FHRSID"), F.col("event_type").alias("BusinessName"), F.col("event_id").alias("pos"),
        F.lit(0).alias("call_ordinal"),
    )


def _even_customers(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("fhrsid"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_master(spark, sf_dir):
    table = store.scratch_table(spark, "scan")
    table.overwrite(_t(spark, sf_dir, "customer"))
    return table.read()


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'not reviewed') AS manual_review FROM orders")
def default_fill(spark, sf_dir):
    return load_master(lambda: _t(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("manual_review")))


@query(f"SELECT c_custkey, raw, {_canon('raw')} AS id FROM (SELECT c_custkey, {RAW_ID.format('c_custkey', 'VARCHAR')} AS raw FROM customer)")
def canonical_id(spark, sf_dir):
    raw = _t(spark, sf_dir, "customer").select("c_custkey", F.expr(RAW_ID.format("c_custkey", "STRING")).alias("raw"))
    return raw.withColumn("id", coerce.canonical_id(F.col("raw")))


@query(f"SELECT id, event_type, event_id FROM {EVENT_BATCH} WHERE id IS NOT NULL")
def valid_ids(spark, sf_dir):
    rows = ingest.valid_ids(_events(spark, sf_dir), "FHRSID")
    return rows.select(coerce.canonical_id(F.col("FHRSID")).alias("id"), F.col("BusinessName").alias("event_type"), F.col("pos").alias("event_id"))


@query(f"SELECT id, event_type, event_id FROM {EVENT_BATCH} b WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {EVEN} m WHERE m.id = b.id)")
def new_records(spark, sf_dir):
    batch = ingest.valid_ids(_events(spark, sf_dir), "FHRSID").withColumn("FHRSID", coerce.canonical_id(F.col("FHRSID")))
    return ingest.new_records(batch, _even_customers(spark, sf_dir), "FHRSID", "fhrsid").select(
        F.col("FHRSID").alias("id"), F.col("BusinessName").alias("event_type"), F.col("pos").alias("event_id"),
    )


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1")
def first_wins(spark, sf_dir):
    return ingest.first_wins(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


_NEW = (
    f"SELECT id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id) AS n FROM {EVENT_BATCH} WHERE id IS NOT "
    f"NULL) b WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM {EVEN} m WHERE m.id = b.id)"
)
_NONE = "CAST(NULL AS VARCHAR)"


@query(
    f'SELECT id AS "FHRSID", event_type AS "BusinessName", {_NONE} AS "AddressLine1", {_NONE} AS "AddressLine2", {_NONE} AS "AddressLine3", {_NONE} AS "PostCode", {_NONE} AS "LocalAuthorityName", {_NONE} AS "RatingValue", '
    f"{_NONE} AS \"NewRatingPending\", DATE '2001-08-01' AS first_seen, 'not reviewed' AS manual_review, {_NONE} AS gemini_insights FROM ({_NEW})"
)
def ingest_new(spark, sf_dir):
    return ingest.ingest_new(_events(spark, sf_dir), _even_customers(spark, sf_dir), DAY)


@query(f"SELECT (SELECT count(*) FROM events)::BIGINT AS n_batch, (SELECT count(*) FROM ({_NEW}))::BIGINT AS n_new")
def ingest_summary(spark, sf_dir):
    batch = _events(spark, sf_dir)
    return ingest.ingest_summary(batch, ingest.ingest_new(batch, _even_customers(spark, sf_dir), DAY))


@query(
    f'SELECT CAST(c_custkey AS VARCHAR) AS "FHRSID", c_name AS "BusinessName", {_NONE} AS "AddressLine1", {_NONE} AS "AddressLine2", {_NONE} AS "AddressLine3", {_NONE} AS "PostCode", c_mktsegment AS "LocalAuthorityName", '
    f'{_NONE} AS "RatingValue", {_NONE} AS "NewRatingPending", {_NONE} AS first_seen, {_NONE} AS manual_review, {_NONE} AS gemini_insights FROM customer'
)
def keep_columns(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return flatten.keep(c.select(
        F.col("c_custkey").cast("string").alias("FHRSID"), F.col("c_name").alias("BusinessName"), F.col("c_mktsegment").alias("LocalAuthorityName"),
        F.col("c_acctbal").alias("extra"),
    ))


@query('SELECT p_partkey AS part_key, p_name AS name, p_brand AS scoreshygiene, p_type AS post_code, p_size AS a___b, p_retailprice AS xml FROM part')
def sanitize_names(spark, sf_dir):
    return sanitize_columns(_t(spark, sf_dir, "part").toDF("Part Key", "@Name", "Scores.Hygiene", "Post-Code", "a - b", "?xml"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS \"p.k\", event_type AS \"p.more.type\" FROM events")
def json_flatten(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    nested = e.select(
        "event_id",
        F.struct(F.from_json("props", "k bigint").getField("k").alias("k"), F.struct(F.col("event_type").alias("type")).alias("more")).alias("p"),
    )
    return flatten.flatten(nested)


#: Customer keys, and so records at most, of a response.
PAGE = 1000


def _responses(spark, sf_dir) -> DataFrame:
    """Search responses of a nation's customers, page by page; every seventh element is no object.

    call_ordinal holds the nation above the page.
    """
    c = _t(spark, sf_dir, "customer")
    record = F.to_json(F.struct(F.col("c_custkey").alias("FHRSID"), F.col("c_name").alias("BusinessName"), F.struct(F.col("c_acctbal").cast("string").alias("Hygiene")).alias("Scores")))
    element = F.when(F.col("c_custkey") % 7 == 0, F.lit("7")).otherwise(record)
    body = F.concat(F.lit('{"FHRSEstablishment": {"EstablishmentCollection": {"EstablishmentDetail": ['), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", element.alias("e")))), lambda x: x["e"]), ", "), F.lit("]}}}"))
    call = F.shiftleft(F.col("c_nationkey").cast("bigint"), 32) + F.floor(F.col("c_custkey") / PAGE)
    return c.groupBy(call.alias("call_ordinal")).agg(body.alias("body"))


def _nation(call_ordinal: str):
    return F.shiftright(call_ordinal, 32).cast("int")


@query(
    'SELECT c_nationkey AS call_ordinal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS pos, c_custkey % 7 = 0 AS skipped, CAST(c_custkey AS VARCHAR) AS "FHRSID", c_name AS "BusinessName" FROM customer QUALIFY NOT skipped'
)
def fetch_union(spark, sf_dir):
    responses = _responses(spark, sf_dir)
    before = Window.partitionBy(_nation("call_ordinal")).orderBy("call_ordinal").rowsBetween(Window.unboundedPreceding, -1)
    starts = records.record_count(responses).select("call_ordinal", F.coalesce(F.sum("n_results").over(before), F.lit(0)).alias("start"))
    rows = records.parse(responses).join(starts, "call_ordinal")
    return rows.select(
        _nation("call_ordinal").alias("call_ordinal"), (F.col("start") + F.col("pos")).cast("int").alias("pos"), F.lit(False).alias("skipped"),
        "FHRSID", "BusinessName",
    )


@query("SELECT c_nationkey AS call_ordinal, count(*)::BIGINT AS n_results FROM customer GROUP BY 1")
def record_count(spark, sf_dir):
    pages = records.record_count(_responses(spark, sf_dir))
    return pages.groupBy(_nation("call_ordinal").alias("call_ordinal")).agg(F.sum("n_results").alias("n_results"))


@query(
    'SELECT c_custkey AS "FHRSID", c_name AS "BusinessName", CAST(c_acctbal AS VARCHAR) AS "Scores.Hygiene" FROM customer WHERE c_custkey % 7 <> 0'
)
def displayed_records(spark, sf_dir):
    """What is shown of the responses' elements: objects only, flat."""
    elements = F.from_json(F.get_json_object("body", "$." + ".".join(schemas.RECORD_PATH)), "array<string>")
    return workflows.displayed(_responses(spark, sf_dir).select(F.explode(elements).alias("text")))


@query("SELECT user_id, count(*)::BIGINT AS n_results, count(*) = 60 AS maybe_capped FROM events GROUP BY 1")
def cap_check(spark, sf_dir):
    return ingest.cap_check(_t(spark, sf_dir, "events"), "user_id", 60)


_PARTS = f"(SELECT p_partkey, {RAW_NUMBER.format('p_partkey')} AS raw FROM part)"


def _parts(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", F.expr(RAW_NUMBER.format("p_partkey")).alias("raw"))


@query(f"SELECT p_partkey, raw, {_number('raw')} AS number FROM {_PARTS}")
def numeric_coerce(spark, sf_dir):
    return _parts(spark, sf_dir).withColumn("number", coerce.to_double(F.col("raw")))


@query(f"SELECT p_partkey, raw, coalesce(CASE WHEN n = floor(n) THEN CAST(n AS BIGINT) END, -1) AS number FROM (SELECT *, {_number('raw')} AS n FROM {_PARTS})")
def int_coerce(spark, sf_dir):
    return _parts(spark, sf_dir).withColumn("number", F.coalesce(coerce.to_long(F.col("raw")), F.lit(-1).cast("bigint")))


_FLAGS = "CASE o_orderkey % 6 WHEN 0 THEN 'True' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'yes' WHEN 3 THEN ' true ' WHEN 4 THEN '1' ELSE NULL END"


@query(f"SELECT o_orderkey, CASE lower({_FLAGS}) WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS flag FROM orders")
def bool_coerce(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", coerce.to_bool(F.expr(_FLAGS)).alias("flag"))


@query(f"SELECT DISTINCT {_FLAGS} AS flag FROM orders")
def distinct_flag_values(spark, sf_dir):
    return ingest.distinct_values(_t(spark, sf_dir, "orders").withColumn("flag", F.expr(_FLAGS)), "flag")


@query("SELECT o_orderkey, CAST(nullif(o_custkey, 5) AS VARCHAR) AS id FROM orders")
def id_to_string(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", coerce.id_to_string(F.expr("nullif(o_custkey, 5)")).alias("id"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def date_coerce(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 4 == 0, "12 September").otherwise(F.col("o_orderdate").cast("string"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", coerce.to_date(text).alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def stringify_date(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", coerce.stringify_date(F.col("o_orderdate"), o.schema["o_orderdate"].dataType).alias("day"))


@query("SELECT p_partkey, replace(concat(p_name, '''', p_brand), '''', '') AS name FROM part")
def strip_quotes(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", coerce.strip_quotes(F.concat("p_name", F.lit("'"), "p_brand")).alias("name"))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') < 7")
def recent_rows(spark, sf_dir):
    return recent.recent_rows(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), 7, DAY, "o_orderdate")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE date_diff('day', CURRENT_DATE - CAST(o_orderkey % 20 AS INTEGER), CURRENT_DATE) < 7")
def recent_today(spark, sf_dir):
    """Orders of the last twenty days, as seen from the current date."""
    day = F.date_sub(F.current_date(), (F.col("o_orderkey") % 20).cast("int"))
    return recent.recent_rows(_t(spark, sf_dir, "orders").withColumn("first_seen", day), 7).select("o_orderkey", "o_custkey")


_TEXTS = "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE source END"


@query(f"SELECT doc_id, {_TEXTS} AS gemini_insights FROM documents WHERE {_TEXTS} IS NULL OR {_TEXTS} = ''")
def needs_insight(spark, sf_dir):
    return insights.needs_insight(_t(spark, sf_dir, "documents").select("doc_id", F.expr(_TEXTS).alias("gemini_insights")))


@query(f"SELECT doc_id, {_TEXTS} AS gemini_insights FROM documents WHERE {_TEXTS} <> ''")
def insights_nonempty(spark, sf_dir):
    return insights.has_insight(_t(spark, sf_dir, "documents").select("doc_id", F.expr(_TEXTS).alias("gemini_insights")))


_PROMPT = "concat('About ', {0}, ' in ', {1}, ' ', {2}, ' ', {3}, ' ', {4}, '" + insights.PROMPT_END + "')"


@query("SELECT p_partkey, " + _PROMPT.format("p_name", "coalesce(nullif(p_brand, 'Brand#11'), '')", "p_type", "''", "CAST(p_size AS VARCHAR)") + " AS prompt FROM part")
def build_prompt(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        insights.build_prompt("About ", F.col("p_name"), F.expr("nullif(p_brand, 'Brand#11')"), F.col("p_type"), F.lit(None), F.col("p_size")).alias("prompt"),
    )


_STAGED = (
    "SELECT CAST(c_custkey AS VARCHAR) AS fhrsid, c_name AS businessname, c_mktsegment AS addressline1, CAST(NULL AS {0}) AS addressline2, '' AS "
    "addressline3, CAST(c_nationkey AS {0}) AS postcode, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'known' END AS gemini_insights "
    "FROM customer"
)


@query(
    "SELECT fhrsid, businessname, addressline1, addressline2, addressline3, postcode, md5(" + _PROMPT.format("businessname", "addressline1", "''", "addressline3", "postcode") + f") AS gemini_insights FROM ({_STAGED.format('VARCHAR')}) WHERE gemini_insights IS NULL OR gemini_insights = ''"
)
def insight_pipeline(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    known = F.expr("CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'known' END")
    staged = c.select(
        F.col("c_custkey").cast("string").alias("fhrsid"), F.col("c_name").alias("businessname"), F.col("c_mktsegment").alias("addressline1"),
        F.lit(None).cast("string").alias("addressline2"), F.lit("").alias("addressline3"), F.col("c_nationkey").cast("string").alias("postcode"),
        known.alias("gemini_insights"),
    )
    return insights.insight_pipeline(staged, store.scratch_table(spark, "insights"), "About ")


def _new_customers(spark, sf_dir) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return flatten.keep(c.select(
        F.col("c_custkey").cast("string").alias("FHRSID"), F.col("c_name").alias("BusinessName"),
        F.col("c_acctbal").cast("string").alias("RatingValue"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' ELSE 'false' END").alias("NewRatingPending"), F.lit(DAY).alias("first_seen"),
        F.lit(schemas.NOT_REVIEWED).alias("manual_review"),
    ))


_APPENDED = (
    f"SELECT CAST(c_custkey AS VARCHAR) AS fhrsid, c_name AS businessname, {_NONE} AS addressline1, {_NONE} AS addressline2, {_NONE} AS "
    f"addressline3, {_NONE} AS postcode, CAST(c_acctbal AS VARCHAR) AS ratingvalue, {_NONE} AS localauthorityname, CASE c_custkey % 3 WHEN 0 THEN "
    f"TRUE WHEN 2 THEN FALSE END AS newratingpending, DATE '2001-08-01' AS first_seen, 'not reviewed' AS manual_review FROM customer"
)


@query(_APPENDED)
def append_projection(spark, sf_dir):
    return flatten.append_projection(_new_customers(spark, sf_dir))


@query(_APPENDED)
def append_readback(spark, sf_dir):
    rows = flatten.append_projection(_new_customers(spark, sf_dir))
    table = store.scratch_table(spark, "append")
    for half in (0, 1):
        store.append_table(table, rows.where(F.col("fhrsid").cast("bigint") % 2 == half).withColumn("extra", F.lit(half)), rows.schema)
    return table.read()


@query(
    "SELECT CAST(p_partkey AS VARCHAR) AS fhrsid, p_name AS businessname, TRY_CAST(CASE WHEN p_size % 2 = 0 THEN CAST(p_retailprice AS VARCHAR) END "
    "AS DOUBLE) AS geocodelatitude, p_size % 2 = 0 AS newratingpending FROM part"
)
def write_truncate_readback(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    even = F.col("p_size") % 2 == 0
    rows = p.select(
        F.col("p_partkey").alias("fhrsid"), F.col("p_name").alias("BusinessName"),
        F.when(even, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("Geocode.Latitude"),
        F.when(even, "True").otherwise("FALSE").alias("NewRatingPending"), F.lit(1).alias("dropped"),
    )
    table = store.scratch_table(spark, "truncate")
    for df in (rows.limit(3), rows):  # the second write replaces the first
        store.write_table(table, df, rows.columns[:4])
    return table.read()


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10")
def ctas_readback(spark, sf_dir):
    table = store.scratch_table(spark, "ctas")
    table.overwrite(_t(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", "p_name", "p_size"))
    return table.read()


@query(
    "SELECT CAST(p_partkey AS VARCHAR) AS fhrsid, p_name AS businessname, CAST(p_size AS BIGINT) AS scoreshygiene, CAST(p_size AS VARCHAR) AS "
    "scoresstructural, p_retailprice AS geocodelatitude, CASE WHEN p_size % 2 = 0 THEN DATE '2001-08-01' END AS first_seen FROM part"
)
def full_write_projection(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    nested = p.select(
        F.col("p_partkey").alias("FHRSID"), F.col("p_name").alias("BusinessName"),
        F.struct(size.alias("Hygiene"), size.alias("Structural")).alias("Scores"),
        F.struct(F.col("p_retailprice").cast("string").alias("Latitude")).alias("Geocode"),
        F.expr("CASE WHEN p_size % 2 = 0 THEN '2001-08-01' ELSE 'soon' END").alias("first_seen"),
    )
    return flatten.full_write_projection(nested)


_CHANGES = (
    "(SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'bad' ELSE CAST(o_custkey AS VARCHAR) END AS balance, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE "
    "concat(o_orderpriority, '''') END AS segment FROM orders WHERE o_orderkey % 3 = 0)"
)


def _changes(spark, sf_dir) -> DataFrame:
    o = _t(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    return o.select(
        F.concat(F.lit("0"), "o_custkey").alias("c_custkey"),
        F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'bad' ELSE CAST(o_custkey AS STRING) END").alias("c_acctbal"),
        F.expr("CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat(o_orderpriority, '\\'') END").alias("c_mktsegment"),
        F.col("o_orderkey").alias("csv_ordinal"),
    )


@query(
    f"SELECT c_custkey, c_name, c_nationkey, CASE WHEN o_custkey IS NULL THEN c_acctbal ELSE CAST(balance AS DOUBLE) END AS c_acctbal, CASE WHEN "
    f"o_custkey IS NULL THEN c_mktsegment ELSE replace(segment, '''', '') END AS c_mktsegment "
    f"FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM {_CHANGES} "
    f"WHERE balance <> 'bad') WHERE n = 1) ON c_custkey = o_custkey"
)
def update_overlay(spark, sf_dir):
    return updates.update_overlay(_t(spark, sf_dir, "customer"), _changes(spark, sf_dir), "c_custkey")


@query(f"SELECT count(*) FILTER (balance <> 'bad')::BIGINT AS n_success, count(*) FILTER (balance = 'bad')::BIGINT AS n_error FROM {_CHANGES}")
def update_summary(spark, sf_dir):
    return updates.update_summary(_changes(spark, sf_dir), _t(spark, sf_dir, "customer"), "c_custkey")


@query(
    f"SELECT concat('0', o_custkey) AS c_custkey, o_orderkey AS csv_ordinal, 'c_acctbal' AS \"column\", 'bad' AS value, 'no double' AS reason FROM {_CHANGES} "
    f"WHERE balance = 'bad'"
)
def update_failures(spark, sf_dir):
    failed = updates.failed_updates(_changes(spark, sf_dir), _t(spark, sf_dir, "customer"), "c_custkey")
    return failed.select("c_custkey", "csv_ordinal", F.inline("failures"))


_LAST_ORDER = "(SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)"


@query(
    f"SELECT c_custkey, c_name, c_nationkey, coalesce(o_totalprice, c_acctbal) AS c_acctbal, coalesce(o_orderpriority, c_mktsegment) AS c_mktsegment "
    f"FROM customer LEFT JOIN {_LAST_ORDER} ON c_custkey = o_custkey"
)
def keyed_update_readback(spark, sf_dir):
    """Customers, laid out by key, take balance and segment from their last order."""
    table = store.scratch_table(spark, "keyed")
    table.overwrite(_t(spark, sf_dir, "customer"), "c_custkey")
    changes = _t(spark, sf_dir, "orders").select(
        F.concat(F.lit("00"), "o_custkey").alias("c_custkey"), F.col("o_totalprice").cast("string").alias("c_acctbal"),
        F.col("o_orderpriority").alias("c_mktsegment"), F.col("o_orderkey").alias("csv_ordinal"),
    )
    updates.update_table(table, changes, "c_custkey")
    return table.read()


@query(f"SELECT id, event_type, event_id FROM {EVENT_BATCH} b WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {EVEN} m WHERE m.id = b.id)")
def keyed_new_records(spark, sf_dir):
    """new_records against a keyed table, of which the buckets of the batch's ids are read."""
    batch = ingest.valid_ids(_events(spark, sf_dir), "FHRSID").withColumn("FHRSID", coerce.canonical_id(F.col("FHRSID")))
    table = store.scratch_table(spark, "known")
    table.overwrite(_even_customers(spark, sf_dir), "fhrsid")
    return ingest.new_records(batch, table.candidates(batch, "FHRSID"), "FHRSID", "fhrsid").select(
        F.col("FHRSID").alias("id"), F.col("BusinessName").alias("event_type"), F.col("pos").alias("event_id"),
    )


_LINES = (
    "CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'a,b' WHEN 2 THEN '1' WHEN 3 THEN '1,2,3' WHEN 4 THEN concat(s_acctbal, ', ', s_nationkey) ELSE "
    "concat('-', s_nationkey, '.5,', s_suppkey) END"
)


@query(
    f"SELECT s_suppkey, line, CASE WHEN s_suppkey % 6 > 3 THEN TRY_CAST(trim(split_part(line, ',', 1)) AS DOUBLE) END AS longitude, CASE WHEN "
    f"s_suppkey % 6 > 3 THEN TRY_CAST(trim(split_part(line, ',', 2)) AS DOUBLE) END AS latitude, s_suppkey % 6 > 3 AS ok FROM (SELECT s_suppkey, "
    f"{_LINES} AS line FROM supplier) WHERE line <> ''"
)
def parse_coordinates(spark, sf_dir):
    return uploads.parse_coordinates(_t(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_LINES).alias("line")))


_PATHS = (
    "CASE n_nationkey % 5 WHEN 0 THEN concat('p.', n_name) WHEN 1 THEN concat('p..', n_name) WHEN 2 THEN '' WHEN 3 THEN concat('.d.', n_name) ELSE "
    "concat('p.d.', n_name) END"
)


@query(
    f"SELECT n_nationkey, path, len(string_split(path, '.')) = 3 AND NOT list_contains(string_split(path, '.'), '') AS valid FROM (SELECT "
    f"n_nationkey, {_PATHS} AS path FROM nation)"
)
def path_validate(spark, sf_dir):
    paths = _t(spark, sf_dir, "nation").select("n_nationkey", F.expr(_PATHS).alias("path"))
    return paths.withColumn("valid", store.is_table_path(F.col("path")))


@query(
    "SELECT * FROM (VALUES ('l_orderkey', 'INTEGER'), ('l_partkey', 'INTEGER'), ('l_suppkey', 'INTEGER'), ('l_linenumber', 'INTEGER'), "
    "('l_quantity', 'FLOAT'), ('l_extendedprice', 'FLOAT'), ('l_discount', 'FLOAT'), ('l_tax', 'FLOAT'), "
    "('l_returnflag', 'STRING'), ('l_linestatus', 'STRING'), ('l_shipdate', 'TIMESTAMP')) t(name, type)"
)
def infer_schema(spark, sf_dir):
    return spark.createDataFrame(schemas.infer_schema(_t(spark, sf_dir, "lineitem").schema), "name string, type string")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_acctbal > 0 AND CAST(s_suppkey AS VARCHAR) = '7' OR s_suppkey = 9")
def key_lookup(spark, sf_dir):
    suppliers = _t(spark, sf_dir, "supplier")
    found = ingest.find_keys(suppliers.where("s_acctbal > 0"), "s_suppkey", " 007 ").unionByName(ingest.find_keys(suppliers, "s_suppkey", "9"))
    return found.select("s_suppkey", "s_name", "s_nationkey")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS fhrsid, s_name AS name FROM supplier")
def csv_roundtrip(spark, sf_dir):
    folder = store.scratch_table(spark, "upload").folder
    _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("FhrsID"), F.col("s_name").alias("name")).write.option("header", True).csv(folder)
    return uploads.read_updates(spark, folder).select("fhrsid", "name")


@query("SELECT count(*)::BIGINT AS n_rows FROM customer")
def table_rows(spark, sf_dir):
    table = store.scratch_table(spark, "rows")
    table.overwrite(_t(spark, sf_dir, "customer"))
    return spark.createDataFrame([(table.rows(),)], "n_rows bigint")


_LONGS = (
    "CASE p_partkey % 6 WHEN 0 THEN concat('900719925474', 1000000 + p_partkey) WHEN 1 THEN concat('900719925474', 1000000 + p_partkey, '.0') WHEN "
    "2 THEN concat('900719925474', 1000000 + p_partkey, '.5') "
    "WHEN 3 THEN '9223372036854775807' WHEN 4 THEN '-9223372036854775809' ELSE concat(' +', p_partkey, ' ') END"
)


@query(
    "SELECT p_partkey, coalesce(CASE p_partkey % 6 WHEN 0 THEN 9007199254740000000 + 1000000 + p_partkey WHEN 1 THEN 9007199254740000000 + 1000000 + p_partkey "
    "WHEN 3 THEN 9223372036854775807 WHEN 5 THEN p_partkey END, -1)::BIGINT AS number FROM part"
)
def long_ids(spark, sf_dir):
    raw = _t(spark, sf_dir, "part").select("p_partkey", F.expr(_LONGS).alias("raw"))
    return raw.select("p_partkey", F.coalesce(coerce.to_long(F.col("raw")), F.lit(-1)).alias("number"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_retailprice END AS price FROM part")
def nan_values(spark, sf_dir):
    price = F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice")).otherwise(F.lit(float("nan")))
    return _t(spark, sf_dir, "part").select("p_partkey", coerce.nan_to_null(price).alias("price"))


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS fhrsid, o_orderstatus AS business_name, o_orderdate AS first_seen FROM orders WHERE date_diff('day', "
    "CAST(o_orderdate AS DATE), DATE '2001-08-01') < 30"
)
def staged_readback(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("fhrsid"), F.col("o_orderstatus").alias("Business Name"), F.col("o_orderdate").alias("first_seen"),
    )
    table = store.scratch_table(spark, "staged")
    recent.stage(recent.recent_rows(rows, 30, DAY), table)
    return table.read()


MASTER_PATH = "project.dataset.master"


def _workflow_master(spark, sf_dir, rows: DataFrame) -> str:
    """A new folder of tables with `rows` as its master."""
    root = store.scratch_table(spark, "workflow").folder
    store.Table.at(spark, root, MASTER_PATH).overwrite(rows, "fhrsid")
    return root


def _master_rows(spark, sf_dir) -> DataFrame:
    """Customers as master rows, first seen within the last three weeks."""
    typed = {"fhrsid": F.col("c_custkey").cast("string"), "businessname": F.col("c_name"), "addressline1": F.col("c_mktsegment"), "first_seen": F.date_sub(F.lit(DAY), (F.col("c_custkey") % 20).cast("int"))}
    none = F.lit(None)
    return _t(spark, sf_dir, "customer").select([typed.get(f.name, none).cast(f.dataType).alias(f.name) for f in schemas.MASTER.fields])


def _pages(spark, sf_dir) -> tuple[DataFrame, records.Search]:
    """Calls (nation, page), and a search that answers each with that nation's customers of the page."""
    c = _t(spark, sf_dir, "customer").withColumns({"longitude": F.col("c_nationkey").cast("double"), "latitude": F.floor(F.col("c_custkey") / PAGE).cast("double")})
    found = F.collect_list(F.struct(F.concat(F.lit("00"), "c_custkey").alias("FHRSID"), F.col("c_name").alias("BusinessName")))
    body = F.concat(F.lit('{"FHRSEstablishment": {"EstablishmentCollection": {"EstablishmentDetail": '), F.to_json(found), F.lit("}}}"))
    bodies = c.groupBy("longitude", "latitude").agg(body.alias("body"))
    calls = c.select("longitude", "latitude", (F.col("longitude") * 1_000_000 + F.col("latitude")).cast("int").alias("call_ordinal")).distinct()
    return calls, lambda calls, max_results: calls.join(bodies, ["longitude", "latitude"]).select(*records.RESPONSES_COLUMNS, F.lit(None).cast("string").alias("problem"))


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS fhrsid, c_name AS businessname, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS addressline1, "
    "CASE WHEN c_custkey % 2 = 0 THEN DATE '2001-08-01' - CAST(c_custkey % 20 AS INTEGER) ELSE DATE '2001-08-01' END AS first_seen, 'not reviewed' "
    "AS manual_review FROM customer"
)
def fetch_workflow(spark, sf_dir):
    known = _master_rows(spark, sf_dir).where(F.col("fhrsid").cast("bigint") % 2 == 0).drop("gemini_insights").withColumn("manual_review", F.lit(schemas.NOT_REVIEWED))
    root = _workflow_master(spark, sf_dir, known)
    calls, search = _pages(spark, sf_dir)
    workflows.fetch_and_append(spark, calls, 5000, root, MASTER_PATH, f"{root}/landing", search, DAY)
    return store.Table.at(spark, root, MASTER_PATH).read().select("fhrsid", "businessname", "addressline1", "first_seen", "manual_review")


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS fhrsid, c_name AS businessname, CASE WHEN c_custkey % 20 < 7 THEN md5(" + _PROMPT.format("c_name", "c_mktsegment", "''", "''", "''") + ") END AS gemini_insights FROM customer"
)
def recent_workflow(spark, sf_dir):
    root = _workflow_master(spark, sf_dir, _master_rows(spark, sf_dir))
    workflows.recent_analysis(spark, root, MASTER_PATH, 7, DAY)
    workflows.enrich_recent(spark, root, MASTER_PATH, "About ", write_back=True)
    return store.Table.at(spark, root, MASTER_PATH).read().select("fhrsid", "businessname", "gemini_insights")


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS fhrsid, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE concat(c_name, ' and sons') END AS businessname, "
    "CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS addressline1, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 2 = 0 END AS newratingpending "
    "FROM customer"
)
def csv_workflow(spark, sf_dir):
    """Every row of the master has two changes in the file, of which each fifth key's fail."""
    root = _workflow_master(spark, sf_dir, _master_rows(spark, sf_dir))
    flag = F.when(F.col("c_custkey") % 5 == 0, "maybe").when(F.col("c_custkey") % 2 == 0, "TRUE").otherwise("false")
    change = lambda name, segment: _t(spark, sf_dir, "customer").select(F.concat(F.lit("0"), "c_custkey").alias("FhrsID"), name.alias("businessname"), segment.alias("addressline1"), flag.alias("newratingpending"))
    first, last = change(F.lit("replaced later"), F.col("c_mktsegment")), change(F.concat("c_name", F.lit("' and sons")), F.lit(None).cast("string"))
    for name, rows in (("a", first), ("b", last)):
        rows.write.option("header", True).csv(f"{root}/changes/{name}")
    for name in "ab":
        workflows.update_from_csv(spark, root, MASTER_PATH, f"{root}/changes/{name}")
    return store.Table.at(spark, root, MASTER_PATH).read().select("fhrsid", "businessname", "addressline1", "newratingpending")


@query("SELECT n_nationkey AS id, n_name AS \"detail.name\", n_regionkey AS \"detail.region\" FROM nation")
def json_readback(spark, sf_dir):
    """A document for each region, over several lines: an array of nested records."""
    folder = store.scratch_table(spark, "json").folder
    nested = F.struct(F.col("n_nationkey").alias("id"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("detail"))
    text = F.array_join(F.collect_list(F.to_json(nested)), ",\n")
    _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("[\n"), text, F.lit("\n]"))).write.partitionBy("n_regionkey").text(folder)
    return flatten.flatten(records.read_json(spark, folder, StructType.fromDDL("id int, detail struct<name: string, region: int>")))


@query(
    'SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS "detail.name", CASE WHEN c_custkey % 2 = 1 THEN CAST(c_acctbal AS DOUBLE) END AS "detail.balance", '
    'CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS segment FROM customer'
)
def flatten_by_data(spark, sf_dir):
    """JSON arrays of records with different keys, flattened by what occurs."""
    folder = store.scratch_table(spark, "json").folder
    even = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name")).alias("detail")))
    odd = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_acctbal").alias("balance")).alias("detail"), F.col("c_mktsegment").alias("segment")))
    record = F.when(F.col("c_custkey") % 2 == 0, even).otherwise(odd)
    pages = _t(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / PAGE).alias("page"))
    pages.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(record), ",\n"), F.lit("\n]"))).write.partitionBy("page").text(folder)
    elements = records.json_elements(spark, folder)
    return flatten.flatten_variant(elements.select(F.parse_json("text").alias("v")), "v").select("id", "`detail.name`", "`detail.balance`", "segment")


@query(
    "SELECT fhrsid, businessname, addressline1, addressline2, addressline3, postcode, md5(" + _PROMPT.format("businessname", "addressline1", "''", "addressline3", "postcode") + f") AS gemini_insights FROM ({_STAGED.format('VARCHAR')}) WHERE gemini_insights IS NULL OR gemini_insights = ''"
)
def insight_answers(spark, sf_dir):
    """insight_pipeline with a table of answers, run twice: the second run asks nothing."""
    c = _t(spark, sf_dir, "customer")
    known = F.expr("CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'known' END")
    staged = c.select(
        F.col("c_custkey").cast("string").alias("fhrsid"), F.col("c_name").alias("businessname"), F.col("c_mktsegment").alias("addressline1"),
        F.lit(None).cast("string").alias("addressline2"), F.lit("").alias("addressline3"), F.col("c_nationkey").cast("string").alias("postcode"),
        known.alias("gemini_insights"),
    )
    answers = store.scratch_table(spark, "answers")
    insights.insight_pipeline(staged, store.scratch_table(spark, "insights"), "About ", answers=answers)

    def silent(prompts: list[str], options: insights.ModelOptions) -> list[str | None]:
        return [None] * len(prompts)

    return insights.insight_pipeline(staged, store.scratch_table(spark, "insights"), "About ", silent, answers=answers)
