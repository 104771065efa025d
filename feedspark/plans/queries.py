"""The registered queries: every operator on the driver's tables, and the same in SQL."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedspark.functions import scalars as S
from feedspark.operators.collection import count_report, export_archive, load_feed, read_feed, simple_route
from feedspark.operators.trips import SEGMENT, clean_segments, clean_trips, parse_responses, total_hits
from feedspark.registry import CODES, table_spec, tables
from feedspark.sources import csvio, paging
from feedspark.sources.appended import AppendedTable
from feedspark.sources.archive import FeedError, Staged, stage_archive
from feedspark.sources.scratch import scratch, ship
from feedspark.sources.stations import read_stations, station_zones
from feedspark.streaming.consume import consume, marks

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REQUIRED = TABLES[:7]
#: Bytes of a row group of the index of events, before compression, and tasks of a carrier in a batch that is drained from it.
INDEX_BYTES = 256 << 10
STRETCHES = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, sql: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {sql} AS t({names})")


# --- Counts and validation -------------------------------------------------------------------------------------------


def q_collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table, and whether the collection must have it."""
    parts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), F.lit(t in REQUIRED).alias("required"), "row_count") for t in TABLES]
    return reduce(DataFrame.unionByName, parts)


SQL = {"q_collection_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, {str(t in REQUIRED).lower()} AS required, count(*) AS row_count FROM {t}" for t in TABLES)}

ORDERS = table_spec("orders", "o_orderkey:u64! o_custkey:u32! o_totalprice:f! o_orderpriority:s!")


def _orders_as_text(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Orders as text, with every 7th price and every 11th priority spoiled."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = F.when(key % 7 == 0, F.concat(F.col("o_totalprice").cast("string"), F.lit("d"))).otherwise(F.col("o_totalprice").cast("string"))
    rows = o.select(key.cast("string"), F.col("o_custkey").cast("string"), price.alias("o_totalprice"), F.when(key % 11 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return rows, rows.columns


def q_valid_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and invalid rows, counted over the checks of every column."""
    return csvio.check_counts(csvio.bind(*_orders_as_text(spark, sf_dir), ORDERS))


SQL["q_valid_count"] = "SELECT count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0) AS valid, count(*) FILTER (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0) AS invalid FROM orders"


def q_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csvio.valid(csvio.bind(*_orders_as_text(spark, sf_dir), ORDERS))


SQL["q_valid_rows"] = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0"


def q_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = csvio.bind(*_orders_as_text(spark, sf_dir), ORDERS)
    return bound.select(F.explode(csvio.ERRORS).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


SQL["q_error_report"] = "SELECT 'orders.o_totalprice: bad value' AS error, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'orders.o_orderpriority: no value', count(*) FROM orders WHERE o_orderkey % 11 = 0"

LINEITEM = table_spec("lineitem", "l_orderkey:u64! l_linenumber:u8! l_quantity:f! l_returnflag:s! l_shipmode:s")


def q_bind_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with its columns in another order, and more of them, bound by name; a column that it lacks is null."""
    path = scratch(spark, "lineitem")
    csvio.write_table(table(spark, sf_dir, "lineitem"), path, ["l_returnflag", "l_tax", "l_quantity", "l_linenumber", "l_comment", "l_orderkey"])
    return csvio.valid(csvio.read_table(spark, path, LINEITEM))


SQL["q_bind_by_name"] = "SELECT l_orderkey, CAST(l_linenumber AS SMALLINT) AS l_linenumber, l_quantity, l_returnflag, CAST(NULL AS VARCHAR) AS l_shipmode FROM lineitem"

PART = table_spec("part", "p_partkey:u64! p_name:s! p_type:s p_size:u8!")


def q_missing_column_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "part")
    csvio.write_table(table(spark, sf_dir, "part"), path, ["p_partkey", "p_name", "p_size"])
    return csvio.read_table(spark, path, PART).select("p_partkey", "p_name", "p_type", "p_size", F.size(csvio.ERRORS).alias("n_errors"))


SQL["q_missing_column_null"] = "SELECT p_partkey, p_name, CAST(NULL AS VARCHAR) AS p_type, CAST(p_size AS SMALLINT) AS p_size, CAST(0 AS INTEGER) AS n_errors FROM part"

CUSTOMER = table_spec("customer", "c_custkey:u64! c_name:s! c_mktsegment:s!")


def q_required_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lack a required value, with what is wrong."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    raw = c.select(key.cast("string"), F.when(key % 10 == 0, F.lit("")).otherwise(F.col("c_name")).alias("c_name"), F.when(key % 15 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    bound = csvio.bind(raw, raw.columns, CUSTOMER)
    return bound.where(F.size(csvio.ERRORS) > 0).select("c_custkey", F.array_join(csvio.ERRORS, ";").alias("errors"))


SQL["q_required_reject"] = """SELECT c_custkey, concat_ws(';', CASE WHEN c_custkey % 10 = 0 THEN 'customer.c_name: no value' END, CASE WHEN c_custkey % 15 = 0 THEN 'customer.c_mktsegment: no value' END) AS errors
FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 15 = 0"""

_TEXTS = ["12", " 12", "+12", "12.0", "256", "4294967296", "-3", "1d", "1e3", ".5", "", "NaN"]


def q_guarded_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as numbers of several types: only what is exactly such a number passes."""
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("o_orderkey") % len(_TEXTS) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", *[S.parse_number(F.col("t"), k).cast("bigint").alias(k) for k in ("u8", "u32", "i64")], F.nanvl(S.parse_number(F.col("t"), "f64"), F.lit(-1.0)).alias("f64"))


_TEXT_LIST = ", ".join(f"'{t}'" for t in _TEXTS)
SQL["q_guarded_casts"] = f"""
WITH x AS (SELECT o_orderkey, [{_TEXT_LIST}][o_orderkey % {len(_TEXTS)} + 1] AS t FROM orders)
SELECT o_orderkey, CASE WHEN regexp_full_match(t, '[+]?[0-9]+') AND TRY_CAST(t AS BIGINT) <= 255 THEN CAST(t AS BIGINT) END AS u8,
       CASE WHEN regexp_full_match(t, '[+]?[0-9]+') AND TRY_CAST(t AS BIGINT) <= 4294967295 THEN CAST(t AS BIGINT) END AS u32,
       CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN TRY_CAST(t AS BIGINT) END AS i64,
       CASE WHEN t = 'NaN' THEN -1.0 WHEN regexp_full_match(t, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?') THEN TRY_CAST(t AS DOUBLE) END AS f64
FROM x
"""

ROUTE_SIZES = table_spec("part", "p_partkey:u64! p_size:RouteType")


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string"), F.col("p_size").cast("string"))
    return csvio.bind(raw, raw.columns, ROUTE_SIZES)


_WIDE = ["127", "128", "-128", "-129", "32767", "32768", "65535", "65536", "2147483647", "2147483648", "-2147483649", "9223372036854775807", "9223372036854775808", "1.5", "-0", "+7", "x"]


def q_number_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts at the limits of the other number types."""
    text = F.element_at(F.array(*map(F.lit, _WIDE)), (F.col("o_orderkey") % len(_WIDE) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", *[S.parse_number(F.col("t"), k).cast("bigint").alias(k) for k in ("i8", "i16", "i32", "u16", "u64")], S.parse_number(F.col("t"), "f32").cast("double").alias("f32"))


_SIGNED_IF = lambda bits: f"CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') AND TRY_CAST(t AS HUGEINT) BETWEEN -{2 ** (bits - 1)} AND {2 ** (bits - 1) - 1} THEN CAST(t AS BIGINT) END AS i{bits}"
_UNSIGNED_IF = lambda bits, limit: f"CASE WHEN regexp_full_match(t, '[+]?[0-9]+') AND TRY_CAST(t AS HUGEINT) <= {limit} THEN CAST(t AS BIGINT) END AS u{bits}"
SQL["q_number_types"] = f"""
WITH x AS (SELECT o_orderkey, [{", ".join(f"'{t}'" for t in _WIDE)}][o_orderkey % {len(_WIDE)} + 1] AS t FROM orders)
SELECT o_orderkey, {", ".join(_SIGNED_IF(b) for b in (8, 16, 32))}, {_UNSIGNED_IF(16, 65535)}, {_UNSIGNED_IF(64, 2**63 - 1)}, CAST(TRY_CAST(t AS FLOAT) AS DOUBLE) AS f32 FROM x
"""


def q_enum_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a domain with their labels."""
    return csvio.valid(_coded(spark, sf_dir)).select("p_partkey", F.col("p_size").alias("code"), S.code_label(F.col("p_size"), CODES["RouteType"]).alias("label"))


_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in CODES["RouteType"].items())
_DOMAIN = ", ".join(map(str, CODES["RouteType"]))
SQL["q_enum_decode"] = f"SELECT p_partkey, CAST(p_size AS TINYINT) AS code, CASE p_size {_CASES} END AS label FROM part WHERE p_size IN ({_DOMAIN})"


def q_enum_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csvio.check_counts(_coded(spark, sf_dir))


SQL["q_enum_reject"] = f"SELECT count(*) FILTER (p_size IN ({_DOMAIN})) AS valid, count(*) FILTER (p_size NOT IN ({_DOMAIN})) AS invalid FROM part"


def q_default_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple routes of suppliers; of the random id only the length is told."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("short_name"), F.concat(F.lit("agency-"), F.col("s_nationkey")).alias("agency_id"))
    return simple_route(rows).withColumn("route_id", F.length("route_id"))


SQL["q_default_route"] = """SELECT 36 AS route_id, 'agency-' || s_nationkey AS agency_id, s_name AS route_short_name, CAST(NULL AS VARCHAR) AS route_long_name, CAST(NULL AS VARCHAR) AS route_desc, CAST(3 AS TINYINT) AS route_type,
CAST(NULL AS VARCHAR) AS route_url, 'FFFFFF' AS route_color, 'BBBBBB' AS route_text_color, CAST(NULL AS BIGINT) AS route_sort_order, CAST(1 AS TINYINT) AS continuous_pickup, CAST(1 AS TINYINT) AS continuous_drop_off,
CAST(NULL AS VARCHAR) AS ticketing_deep_link_id FROM supplier"""


# --- Archives and CSV ------------------------------------------------------------------------------------------------


def _feed_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The driver's tables dressed as a feed: five required tables and three optional ones, one of them with bad rows."""
    region, nation, supplier, customer, orders, part = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer", "orders", "part"))
    agency = region.select(F.concat(F.lit("agency-"), "r_regionkey").alias("agency_id"), F.concat("r_name", F.lit(', "transit"')).alias("agency_name"), F.lit("https://agency.example").alias("agency_url"), F.lit("Europe/Berlin").alias("agency_timezone"))
    stops = supplier.select(F.col("s_acctbal").alias("stop_lat"), F.concat(F.lit("s"), "s_suppkey").alias("stop_id"), F.col("s_name").alias("stop_name"), F.lit(1).alias("location_type"), F.lit("x").alias("unknown_column"))
    routes = nation.select(F.concat(F.lit("r"), "n_nationkey").alias("route_id"), F.concat(F.lit("agency-"), "n_regionkey").alias("agency_id"), F.lit(3).alias("route_type"), F.col("n_nationkey").alias("route_sort_order"))
    trips = customer.select(F.concat(F.lit("r"), "c_nationkey").alias("route_id"), F.col("c_mktsegment").alias("service_id"), F.concat(F.lit("t"), "c_custkey").alias("trip_id"), (F.col("c_custkey") % 2).alias("direction_id"))
    stop_times = orders.select(F.concat(F.lit("t"), "o_custkey").alias("trip_id"), F.concat(F.lit("s"), F.col("o_orderkey") % 10).alias("stop_id"), F.col("o_orderkey").alias("stop_sequence"), F.lit("25:10:00").alias("arrival_time"))
    levels = part.select(F.concat(F.lit("l"), "p_partkey").alias("level_id"), F.when(F.col("p_partkey") % 5 == 0, F.lit("ground")).otherwise(F.col("p_size").cast("string")).alias("level_index"))
    fares = part.select(F.concat(F.lit("f"), "p_partkey").alias("fare_id"), F.col("p_retailprice").alias("price"), F.lit("EUR").alias("currency_type"), F.lit(0).alias("payment_method"))
    return {"agency": agency, "stops": stops, "routes": routes, "trips": trips, "stop_times": stop_times, "fare_attributes": fares, "levels": levels}


def q_zip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed as a ZIP archive, staged, bound, checked and counted table by table."""
    path = f"{scratch(spark, 'archive')}.zip"
    export_archive(spark, _feed_frames(spark, sf_dir), path)
    return count_report(read_feed(spark, stage_archive(spark, path)), tables())


_FEED = [("agency", "true", "region", "0"), ("stops", "true", "supplier", "0"), ("routes", "true", "nation", "0"), ("trips", "true", "customer", "0"), ("stop_times", "true", "orders", "0"), ("fare_attributes", "false", "part", "0"), ("levels", "false", "part", "count(*) FILTER (p_partkey % 5 = 0)")]
SQL["q_zip_roundtrip"] = " UNION ALL ".join(f"SELECT '{n}' AS table_name, {req} AS required, count(*) - {bad} AS valid, {bad} AS invalid FROM {t}" for n, req, t, bad in _FEED)


def _staged_feed(spark: SparkSession, sf_dir: str) -> Staged:
    """The feed unpacked: a folder of CSV files for each table."""
    at = scratch(spark, "feed")
    for name, df in _feed_frames(spark, sf_dir).items():
        csvio.write_table(df, f"{at}/{name}.csv")
    return Staged(spark, {n: f"{at}/{n}.csv" for n in _feed_frames(spark, sf_dir)})


def q_load_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed under the policy of required and optional tables: rows of each table that is there, and why the others aren't."""
    feed = load_feed(spark, _staged_feed(spark, sf_dir))
    rows = [(n, feed.counts.get(n), feed.problems.get(n), df is not None) for n, df in feed.tables.items()]
    return spark.createDataFrame(rows, "table_name string, n bigint, problem string, loaded boolean")


_THERE = {n: (t, bad) for n, _, t, bad in _FEED}
SQL["q_load_feed"] = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, CAST(NULL AS BIGINT) AS n, 'missing' AS problem, false AS loaded" if n not in _THERE
    else f"SELECT '{n}' AS table_name, count(*) AS n, CAST(NULL AS VARCHAR) AS problem, true AS loaded FROM {_THERE[n][0]}" if _THERE[n][1] == "0"
    else f"SELECT '{n}' AS table_name, NULL AS n, {_THERE[n][1]} || ' of ' || count(*) || ' rows have errors' AS problem, false AS loaded FROM {_THERE[n][0]}"
    for n in tables()
)


def q_feed_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a feed without a required table, of one with bad rows in a required table, and of the latter with its bad rows left out."""
    staged = _staged_feed(spark, sf_dir)
    at = scratch(spark, "levels")
    bad = table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") > 1, F.lit("a")).otherwise(F.lit("")).alias("agency_id"), F.lit("A").alias("agency_name"), F.lit("u").alias("agency_url"), F.lit("UTC").alias("agency_timezone"))
    csvio.write_table(bad, at)
    cases = {"complete": (staged.paths, False), "no trips": ({k: v for k, v in staged.paths.items() if k != "trips"}, False), "bad agency": (staged.paths | {"agency": at}, False), "quarantine": (staged.paths | {"agency": at}, True)}
    rows = []
    for case, (paths, quarantine) in cases.items():
        try:
            feed = load_feed(spark, Staged(spark, paths), quarantine)
            rows.append((case, f"agency {feed.counts['agency']}, levels {feed.counts.get('levels')}"))
        except FeedError as e:
            rows.append((case, str(e)))
    return spark.createDataFrame(rows, "case string, outcome string")


SQL["q_feed_policy"] = """SELECT 'complete' AS "case", 'agency ' || count(*) || ', levels None' AS outcome FROM region UNION ALL SELECT 'no trips', 'required table trips: missing'
UNION ALL SELECT 'bad agency', 'required table agency: ' || count(*) FILTER (r_regionkey <= 1) || ' of ' || count(*) || ' rows have errors' FROM region
UNION ALL SELECT 'quarantine', 'agency ' || count(*) FILTER (r_regionkey > 1) || ', levels ' || (SELECT count(*) FILTER (p_partkey % 5 <> 0) FROM part) FROM region"""


def q_strict_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading all rows strictly: right for good rows; bad ones fail the job, with what is wrong."""
    bound = csvio.bind(*_orders_as_text(spark, sf_dir), ORDERS)
    good = csvio.strict(bound.where("o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0")).agg(F.count("o_totalprice").alias("n")).first().n
    try:
        csvio.strict(bound.where("o_orderkey % 77 = 0")).agg(F.count("o_totalprice")).first()
        failed = "no"
    except Exception as e:  # noqa: BLE001  Spark's own exception
        failed = "orders.o_totalprice: bad value; orders.o_orderpriority: no value" if "orders.o_totalprice: bad value; orders.o_orderpriority: no value" in str(e) else str(e)
    try:
        csvio.flat(table(spark, sf_dir, "embeddings"))
        nested = "no"
    except ValueError as e:
        nested = str(e)
    return spark.createDataFrame([(good, failed, nested)], "n bigint, failed string, nested string")


SQL["q_strict_read"] = """SELECT count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0) AS n, 'orders.o_totalprice: bad value; orders.o_orderpriority: no value' AS failed,
'CSV has no form for the columns embedding' AS nested FROM orders"""


def q_repeated_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header that names a column twice: the last counts."""
    raw = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    return csvio.valid(csvio.bind(raw, ["c_custkey", "c_name", "c_name"], table_spec("customer", "c_custkey:u64! c_name:s!")))


SQL["q_repeated_header"] = "SELECT c_custkey, c_mktsegment AS c_name FROM customer"


def q_csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as lists of fields, as CSV lines, and the lines taken apart again."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("p_name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("p_type"))
    lines = csvio.to_csv_lines(rows, ["p_name", "p_type", "p_partkey"]).select(csvio.fields_of(F.col("line")).alias("fields"))
    some = csvio.as_fields(rows, ["p_name", "p_type", "p_partkey"])
    joined = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.element_at("fields", 3).cast("bigint").alias("p_partkey"), F.array_join("fields", "|").alias("fields"), F.size("fields").alias("n"))
    return joined(some, "values").unionByName(joined(lines, "line"))


SQL["q_csv_fields"] = """SELECT kind, p_partkey, p_name || ', "' || p_brand || '"|' || CASE WHEN p_partkey % 3 <> 0 THEN p_type ELSE '' END || '|' || p_partkey AS fields, CAST(3 AS INTEGER) AS n
FROM part, (VALUES ('values'), ('line')) t(kind)"""


def q_append_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended in two batches, numbered in the order in which they came."""
    t = AppendedTable(spark, "name string, n bigint")
    t.append(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("n")).orderBy(F.desc("n_nationkey")))
    t.append(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n"), F.col("r_name").alias("name")).orderBy("r_regionkey"))
    order = Window.partitionBy("_batch").orderBy("_row")
    return t.rows().select("name", "n", F.col("_batch").alias("batch"), F.row_number().over(order).alias("place"))


SQL["q_append_order"] = """SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS n, CAST(0 AS INTEGER) AS batch, CAST(row_number() OVER (ORDER BY n_nationkey DESC) AS INTEGER) AS place FROM nation
UNION ALL SELECT r_name, CAST(r_regionkey AS BIGINT), 1, CAST(row_number() OVER (ORDER BY r_regionkey) AS INTEGER) FROM region"""


def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, commas and line breaks written as CSV and read back; an empty text comes back as null."""
    path = scratch(spark, "documents")
    csvio.write_table(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return csvio.valid(csvio.read_table(spark, path, table_spec("documents", "doc_id:u64! text:s"), multi_line=True))


SQL["q_csv_roundtrip"] = "SELECT doc_id, nullif(text, '') AS text FROM documents"


def q_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as CSV lines of a header that has a column more and one fewer."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("p_name"), "p_type", "p_size")
    return csvio.to_csv_lines(rows, ["p_size", "p_name", "p_comment", "p_partkey"])


SQL["q_csv_lines"] = """SELECT p_size || ',"' || replace(p_name || ', "' || p_brand || '"', '"', '""') || '",,' || p_partkey AS line FROM part"""

_MEMBERS = ["x/agency.txt", "trips.csv", "notes.txt", "stops.tar.txt", "deep/down/stop_times.TXT", "routes", "Stops.txt", "shapes.txt"]


def q_stem_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive members joined with the registry by their stems."""
    members = values(spark, ", ".join(f"('{m}')" for m in _MEMBERS), "member")
    known = values(spark, ", ".join(f"('{t.name}', {str(t.required).lower()})" for t in tables().values()), "table_name, required")
    return members.withColumn("stem", S.file_stem(F.col("member"))).join(F.broadcast(known), F.col("stem") == F.col("table_name"), "left").withColumn("required", F.coalesce("required", F.lit(False)))  # the registry's 19 rows


_MEMBER_ROWS = ", ".join(f"('{m}')" for m in _MEMBERS)
_TABLE_ROWS = ", ".join(f"('{t.name}', {str(t.required).lower()})" for t in tables().values())
SQL["q_stem_catalog"] = f"""
WITH m AS (SELECT member, regexp_replace(regexp_extract(member, '[^/]+$'), '[.][^.]*$', '') AS stem FROM (VALUES {_MEMBER_ROWS}) t(member))
SELECT m.member, m.stem, r.table_name, coalesce(r.required, false) AS required FROM m LEFT JOIN (VALUES {_TABLE_ROWS}) r(table_name, required) ON m.stem = r.table_name
"""


def q_duplicate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


SQL["q_duplicate_check"] = "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1"


# --- Paging ----------------------------------------------------------------------------------------------------------


def q_term_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(paging.carrier_is("BUILDING", "c_mktsegment"))


SQL["q_term_filter"] = "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'"


def _urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(paging.carrier_is("1-URGENT", "o_orderpriority"))


def q_page_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page(_urgent(spark, sf_dir), "o_orderkey", tie=[]).select("o_orderkey", "o_custkey", "o_totalprice")


SQL["q_page_first"] = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 100"


def q_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page(_urgent(spark, sf_dir), "o_orderkey", after=700, tie=[]).select("o_orderkey", "o_custkey", "o_totalprice")


SQL["q_page_after"] = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey > 700 ORDER BY o_orderkey LIMIT 100"


def q_drain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that each page of a carrier's documents holds."""
    return paging.page_bounds(_urgent(spark, sf_dir), "o_orderkey")


SQL["q_drain_pages"] = """SELECT (rn - 1) // 100 AS page, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS n
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1"""


def q_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.drain(_urgent(spark, sf_dir), "o_orderkey").select("o_orderkey", "o_totalprice")


SQL["q_drain"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'"


def q_page_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a key that many rows share, which goes on until its last key is complete; every 50th key is null and comes first."""
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderkey")
    return paging.page(rows, "o_custkey", after=(None,))


SQL["q_page_ties"] = """WITH x AS (SELECT CASE WHEN o_custkey % 50 <> 0 THEN o_custkey END AS o_custkey, o_orderkey FROM orders),
y AS (SELECT * FROM x WHERE o_custkey IS NOT NULL)
SELECT * FROM y WHERE o_custkey <= (SELECT max(o_custkey) FROM (SELECT o_custkey FROM y ORDER BY o_custkey LIMIT 100))"""


def q_page_tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a row of a key that many rows share."""
    return paging.page(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", after=(7, 30), tie=["o_orderkey"])


SQL["q_page_tie_break"] = "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey > 7 OR o_custkey = 7 AND o_orderkey > 30 ORDER BY o_custkey, o_orderkey LIMIT 100"


def q_page_bounds_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which keys each page holds where keys repeat and some are null."""
    return paging.page_bounds(table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("k")), "k")


SQL["q_page_bounds_nulls"] = """SELECT (rn - 1) // 100 AS page, CASE WHEN bool_or(k IS NULL) THEN NULL ELSE min(k) END AS first_key, max(k) AS last_key, count(*) AS n
FROM (SELECT k, row_number() OVER (ORDER BY k NULLS FIRST) AS rn FROM (SELECT CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS k FROM orders)) GROUP BY 1"""


@lru_cache(maxsize=64)
def _row_groups(path: str) -> list[tuple[str, str, str, int]]:
    """(first key, last key, file, number) of each row group of a folder of sorted Parquet files, in order of keys."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector, FileSystem

    fs, at = FileSystem.from_uri(path)
    found = []
    for f in fs.get_file_info(FileSelector(at, allow_not_found=True)):
        if f.base_name.endswith(".parquet"):
            meta = pq.read_metadata(f.path, filesystem=fs)
            keys = [meta.row_group(i).column(meta.schema.names.index(paging.KEY)).statistics for i in range(meta.num_row_groups)]
            found += [(k.min, k.max, f.path, i) for i, k in enumerate(keys)]
    return sorted(found)


class EventPages(paging.PagedDocuments):
    """``paged_documents`` over the table of events instead of a service: option path, where :func:`_event_index` has put them; a carrier is a type of event.

    A page is read from the row groups that hold it, of which one is held at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "event_pages"

    def fetch(self, carrier: str) -> paging.Fetch:
        return self._pages(carrier, [paging.KEY, "document"])

    def fetch_keys(self, carrier: str) -> paging.Fetch:
        return self._pages(carrier, [paging.KEY])

    def _pages(self, carrier: str, columns: list[str]) -> paging.Fetch:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        path = f"{self.options['path']}/n={self.carriers.index(carrier) + 1}"
        groups, fs = _row_groups(path), FileSystem.from_uri(path)[0]
        lasts = [g[1] for g in groups]
        held: tuple[int, list[list]] = (-1, [])

        def one(after: str | None) -> list[tuple[str, ...]]:
            nonlocal held
            hits: list[tuple[str, ...]] = []
            for at in range(0 if after is None else bisect_right(lasts, after), len(groups)):
                if held[0] != at:
                    with pq.ParquetFile(groups[at][2], filesystem=fs) as f:
                        rows = f.read_row_group(groups[at][3], columns=columns)
                    held = at, [rows[c].to_pylist() for c in columns]
                begin = 0 if after is None else bisect_right(held[1][0], after)
                hits += zip(*[v[begin : begin + paging.PAGE_SIZE - len(hits)] for v in held[1]], strict=True)
                if len(hits) == paging.PAGE_SIZE:
                    break
            return hits

        return one


def _event_index(spark: SparkSession, sf_dir: str, carriers: list[str]) -> str:
    """Events as an index of documents in the shared folder: a folder for each carrier, sorted by key in small row groups."""
    path = scratch(spark, "event_index")
    n = F.array_position(F.array(*map(F.lit, carriers)), F.col("event_type")).cast("int").alias("n")
    rows = table(spark, sf_dir, "events").select(n, F.format_string("%012d", "event_id").alias(paging.KEY), F.col("props").alias("document"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, "n", paging.KEY).sortWithinPartitions("n", paging.KEY)
    dealt.write.option("parquet.block.size", INDEX_BYTES).partitionBy("n").parquet(path)
    return path


def q_stream_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of all carriers as a stream, each batch passed on to a sink: what the sink has got of each carrier, and how progress was told."""
    ship(spark)
    spark.dataSource.register(EventPages)
    carriers = sorted(r.value for r in q_distinct_values(spark, sf_dir).collect())  # a row for each type of event
    sink = scratch(spark, "drained")
    options = {"path": _event_index(spark, sf_dir, carriers), "carriers": ",".join(carriers), "pages": "25", "tasks": str(STRETCHES)}
    query, progress = consume(spark.readStream.format("event_pages").options(**options).load(), lambda df: df.coalesce(len(carriers)).write.mode("append").parquet(sink))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.read.schema("carrier string, snapshot_id string, document string").parquet(sink)
    return got.groupBy("carrier").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("snapshot_id").alias("keys")).withColumns({"total": F.lit(progress.total).cast("bigint"), "told": F.lit(len(progress.told)).cast("bigint")})


def q_stream_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events from files consumed to its end: rows, and how often progress was told."""
    schema = table(spark, sf_dir, "events").schema
    query, progress = consume(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.createDataFrame([(progress.total, len(progress.told))], "n bigint, told bigint")


_MARKS = "WITH RECURSIVE m(mark) AS (SELECT CAST(0 AS BIGINT) UNION ALL SELECT mark + 5 + (mark + 5) // 5 FROM m WHERE mark < 2000000000)"
SQL["q_stream_table"] = f"{_MARKS} SELECT count(*) AS n, (SELECT count(*) FROM m WHERE mark < (SELECT count(*) FROM events)) AS told FROM events"
SQL["q_stream_drain"] = f"{_MARKS} SELECT event_type AS carrier, count(*) AS n, count(DISTINCT event_id) AS keys, (SELECT count(*) FROM events) AS total, (SELECT count(*) FROM m WHERE mark < (SELECT count(*) FROM events)) AS told FROM events GROUP BY 1"


def q_progress_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows at which progress is told, as orders are consumed."""
    n = table(spark, sf_dir, "orders").count()
    return spark.createDataFrame([(m,) for m in marks(n)], "row_number bigint")


SQL["q_progress_points"] = f"{_MARKS} SELECT mark + 1 AS row_number FROM m WHERE mark < (SELECT count(*) FROM orders)"


def q_table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.table_stats(table(spark, sf_dir, "events"), "events")


SQL["q_table_stats"] = "SELECT 'events' AS \"index\", count(*) AS docs_count FROM events"


def q_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("value")).distinct()


SQL["q_distinct_values"] = "SELECT DISTINCT event_type AS value FROM events"


# --- Scalar functions ------------------------------------------------------------------------------------------------


def q_line_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") % 5
    prefix = F.when(key == 0, F.lit(None)).when(key == 1, F.lit(" \t")).when(key == 2, F.lit("")).otherwise(F.col("p_brand"))
    suffix = F.when(key == 4, F.lit(None)).when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", S.line_id(prefix, suffix).alias("line"))


SQL["q_line_id"] = r"""
WITH x AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' || chr(9) WHEN 2 THEN '' ELSE p_brand END AS a, CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_type END AS b FROM part)
SELECT p_partkey, nullif(regexp_replace(concat_ws(' ', a, b), '^\s+|\s+$', '', 'g'), '') AS line FROM x
"""


def q_cents_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.money(cents).cast("double").alias("price"))


SQL["q_cents_decimal"] = "SELECT o_orderkey, CAST(CAST(CAST(round(o_totalprice * 100) AS BIGINT) / 100 AS DECIMAL(10, 2)) AS DOUBLE) AS price FROM orders"

_MILLIS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"


def q_epoch_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.utc_naive(F.expr(_MILLIS)).alias("at"))


SQL["q_epoch_millis"] = "SELECT event_id, date_trunc('milliseconds', ts) AS at FROM events"

_ZONES = ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Sydney", "UTC"]


def q_wallclock_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index times as the clock of each row's zone, and the instant of that clock time."""
    zone = F.element_at(F.array(*map(F.lit, _ZONES)), (F.col("user_id") % len(_ZONES) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", zone.alias("tz"), F.expr(_MILLIS).alias("ms"))
    out = rows.select("event_id", S.rebased(F.col("ms"), F.col("tz")).alias("r"))
    return out.select("event_id", F.col("r.tz").alias("tz"), F.col("r.local").alias("local"), F.col("r.instant").alias("instant"), S.clock_problem(F.col("r")).alias("problem"))


_ZONE_LIST = ", ".join(f"'{z}'" for z in _ZONES)
SQL["q_wallclock_rebase"] = f"""
WITH x AS (SELECT event_id, [{_ZONE_LIST}][user_id % {len(_ZONES)} + 1] AS tz, timezone('Europe/Berlin', timezone('UTC', date_trunc('milliseconds', ts))) AS local_ FROM events)
SELECT event_id, tz, local_ AS "local", timezone('UTC', timezone(tz, local_)) AS instant, CAST(NULL AS VARCHAR) AS problem FROM x
"""

_CLOCKS = [
    ("America/New_York", "2023-03-12 02:30:00", True, False), ("America/New_York", "2023-11-05 01:30:00", False, True), ("America/New_York", "2023-06-01 12:00:00", False, False), ("Europe/London", "2023-03-26 01:30:00", True, False),
    ("Europe/Berlin", "2023-10-29 02:30:00", False, True), ("Europe/Berlin", "2023-03-26 02:00:00", True, False), ("Asia/Kolkata", "2023-03-26 02:30:00", False, False), ("Australia/Lord_Howe", "2023-04-02 01:45:00", False, True),
]


def q_dst_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock times that a zone skips or shows twice."""
    rows = values(spark, ", ".join(f"('{z}', TIMESTAMP_NTZ '{c}')" for z, c, _, _ in _CLOCKS), "tz, clock")
    return rows.select("tz", "clock", S.is_gap(F.col("clock"), F.col("tz")).alias("gap"), S.is_overlap(F.col("clock"), F.col("tz")).alias("overlap"))


SQL["q_dst_flags"] = "SELECT tz, clock, gap, overlap FROM (VALUES " + ", ".join(f"('{z}', TIMESTAMP '{c}', {str(g).lower()}, {str(o).lower()})" for z, c, g, o in _CLOCKS) + ") t(tz, clock, gap, overlap)"


def q_credential_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey") % 4
    text = F.when(key == 3, F.lit("a:b:c")).when(key == 2, F.lit("single")).otherwise(F.concat_ws(":", F.col("s_name"), F.col("s_nationkey").cast("string")))
    coded = F.when(key == 1, F.lit("not base64!")).otherwise(F.base64(F.encode(text, "UTF-8")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.credential(coded).alias("c")).select("s_suppkey", F.col("c.id").alias("id"), F.col("c.key").alias("key"))


SQL["q_credential_split"] = "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_name END AS id, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_nationkey AS VARCHAR) END AS key FROM supplier"


def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint", {"mode": "FAILFAST"})["k"].alias("k"))


SQL["q_json_props"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"


# --- Stations and trips ----------------------------------------------------------------------------------------------

_NATION_ZONES = ["Europe/Berlin", "America/New_York", "Not/AZone", "Asia/Tokyo", "+01:00", "UTC"]


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station entries of the nations: two for each code, the later of which is valid for some only."""
    n, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    zones = F.array(*map(F.lit, _NATION_ZONES))
    code = F.concat(F.lit("st"), key).alias("code")
    first = n.select(code, F.element_at(zones, (key % 2 + 1).cast("int")).alias("time_zone"), key.cast("bigint").alias("pos"))
    second = n.where(key % 3 != 0).select(code, F.element_at(zones, (key % 6 + 1).cast("int")).alias("time_zone"), (key + 1000).cast("bigint").alias("pos"))
    bad = n.select(F.concat(F.lit("bad"), key).alias("code"), F.lit("Mars/Olympus").alias("time_zone"), (key + 2000).cast("bigint").alias("pos"))
    return first.unionByName(second).unionByName(bad)


_ENTRIES = f"""
zones AS (SELECT [{", ".join(f"'{z}'" for z in _NATION_ZONES)}] AS z),
entries AS (
  SELECT 'st' || n_nationkey AS code, z[n_nationkey % 2 + 1] AS time_zone, n_nationkey AS pos FROM nation, zones
  UNION ALL SELECT 'st' || n_nationkey, z[n_nationkey % 6 + 1], n_nationkey + 1000 FROM nation, zones WHERE n_nationkey % 3 <> 0
  UNION ALL SELECT 'bad' || n_nationkey, 'Mars/Olympus', n_nationkey + 2000 FROM nation
),
stations AS (SELECT code, arg_max(time_zone, pos) AS time_zone FROM entries WHERE time_zone IN ('Europe/Berlin', 'America/New_York', 'Asia/Tokyo', 'UTC') GROUP BY code)
"""


def q_zone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).where(S.is_zone(F.col("time_zone")))


SQL["q_zone_filter"] = f"WITH {_ENTRIES} SELECT code, time_zone, CAST(pos AS BIGINT) AS pos FROM entries WHERE time_zone IN ('Europe/Berlin', 'America/New_York', 'Asia/Tokyo', 'UTC')"


def q_station_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return station_zones(_entries(spark, sf_dir))


SQL["q_station_last_wins"] = f"WITH {_ENTRIES} SELECT code, time_zone FROM stations"


def q_station_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stations service's answer, one JSON document, read from a file: valid zones, the last entry of a code."""
    path = scratch(spark, "stations")
    entry = F.struct("pos", F.struct("code", "time_zone").alias("attributes"))
    one = _entries(spark, sf_dir).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["attributes"].alias("attributes"))).alias("data"))
    one.select(F.to_json(F.struct("data"))).coalesce(1).write.text(path)
    return station_zones(read_stations(spark, path))


SQL["q_station_payload"] = f"WITH {_ENTRIES} SELECT code, time_zone FROM stations"


def q_join_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(b, p, S.join_url(b, p)) for b in ("http://h", "http://h/") for p in ("a/b", "/a/b")], "base string, path string, url string")


SQL["q_join_url"] = "SELECT base, path, 'http://h/a/b' AS url FROM (VALUES ('http://h'), ('http://h/')) b(base), (VALUES ('a/b'), ('/a/b')) p(path)"


def q_tz_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their station's zone; every 9th names a station that there isn't."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.when(F.col("s_suppkey") % 9 == 0, F.lit("bad")).otherwise(F.lit("st")), "s_nationkey").alias("code"))
    return s.join(station_zones(_entries(spark, sf_dir)), "code", "left").select("s_suppkey", "code", "time_zone", F.col("time_zone").isNull().alias("missed"))


SQL["q_tz_lookup_join"] = f"""WITH {_ENTRIES}, s AS (SELECT s_suppkey, (CASE WHEN s_suppkey % 9 = 0 THEN 'bad' ELSE 'st' END) || s_nationkey AS code FROM supplier)
SELECT s_suppkey, s.code, time_zone, time_zone IS NULL AS missed FROM s LEFT JOIN stations t ON s.code = t.code"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items as raw trip documents."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ms = lambda c: F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})") + 12 * 3600 * 1000
    station = lambda c: F.struct(F.concat(F.lit("st"), F.col(c) % 25).alias("uid"))
    # Only what tells lines apart is shuffled, dealt to as many tasks as are set, as cleaning costs more than reading; lines take their form
    # after that and before they are collected, in generated code.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    line = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).alias("prefix"), ms("l_shipdate").alias("at"))
    lines = li.select(*line).repartition(parts, "l_orderkey")
    seg = F.struct(
        F.col("l_linenumber").cast("bigint").alias("index"), F.struct(F.lit("op").alias("uid")).alias("operating_carrier"), F.col("l_returnflag").alias("line"), F.col("prefix").alias("line_prefix"),
        F.col("at").alias("departure_time"), (F.col("at") + 3600000).alias("arrival_time"), station("l_suppkey").alias("departure_station"), station("l_partkey").alias("arrival_station"), F.struct(F.lit("BUS").alias("type")).alias("vehicle"),
    )
    fare = F.struct(F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"), F.struct(F.col("l_returnflag").alias("uid")).alias("fare_class"))
    # Rows repeat an order's line number, so the line's part and what follows break ties.
    formed = lines.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", seg.alias("segment"), fare.alias("fare")).alias("line"))
    legs = formed.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("x"))
    d = o.repartition(parts, "o_orderkey").join(legs, o.o_orderkey == legs.l_orderkey, "left")
    some = F.struct(F.lit(None).cast("string").alias("uid"))
    uid = lambda c: F.struct(c.alias("uid"))
    return d.select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("snapshot_id"), ms("o_orderdate").alias("snapshot_timestamp"), F.col("o_orderstatus").alias("snapshot_uid"), ms("o_orderdate").alias("departure_time"), (ms("o_orderdate") + 7200000).alias("arrival_time"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total_price"), F.lit("EUR").alias("currency"), (F.col("o_orderkey") % 2 == 0).alias("booked_out"), F.lit(None).cast("boolean").alias("electronic_ticket_available"), F.col("o_orderdate").cast("date").cast("string").alias("departure_date"),
        station("o_custkey").alias("departure_station"), station("o_orderkey").alias("arrival_station"), uid(F.col("o_orderpriority")).alias("marketing_carrier"), some.alias("departure_city"), some.alias("arrival_city"), some.alias("departure_area"), some.alias("arrival_area"),
        S.empty_if_null(F.col("x.segment"), f"array<{SEGMENT}>").alias("segments"), F.col("x.fare").alias("fares"),
    )


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_trips(_documents(spark, sf_dir), _entries(spark, sf_dir))


def q_nested_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned: money, zones and arrays, one row each."""
    c = _clean(spark, sf_dir)
    return c.select("snapshot_id", "snapshot_timestamp", F.col("total_price").cast("double").alias("total_price"), F.col("departure_time.tz").alias("departure_tz"), F.col("departure_time.local").alias("departure_local"), F.col("arrival_time.tz").alias("arrival_tz"), F.size("segments").alias("n_segments"), F.size("fares").alias("n_fares"), F.aggregate("fares", F.lit(0).cast("decimal(20,2)"), lambda a, f: (a + f["price"]).cast("decimal(20,2)")).cast("double").alias("fare_sum"))


SQL["q_nested_clean"] = f"""
WITH {_ENTRIES},
legs AS (SELECT l_orderkey, count(*) AS n, sum(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) / 100 AS DECIMAL(10, 2))) AS fares FROM lineitem GROUP BY 1),
o AS (SELECT *, o_orderdate + INTERVAL 12 HOUR AS t FROM orders)
SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS snapshot_id, t AS snapshot_timestamp, CAST(CAST(CAST(round(o_totalprice * 100) AS BIGINT) / 100 AS DECIMAL(10, 2)) AS DOUBLE) AS total_price,
       d.time_zone AS departure_tz, CASE WHEN d.time_zone IS NOT NULL THEN timezone('Europe/Berlin', timezone('UTC', t)) END AS departure_local, a.time_zone AS arrival_tz,
       CAST(coalesce(n, 0) AS INTEGER) AS n_segments, CAST(coalesce(n, 0) AS INTEGER) AS n_fares, CAST(CAST(coalesce(fares, 0) AS DECIMAL(20, 2)) AS DOUBLE) AS fare_sum
FROM o LEFT JOIN legs ON l_orderkey = o_orderkey LEFT JOIN stations d ON d.code = 'st' || (o_custkey % 25) LEFT JOIN stations a ON a.code = 'st' || (o_orderkey % 25)
"""


def q_nested_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean segments, one row each."""
    c = clean_segments(_documents(spark, sf_dir), _entries(spark, sf_dir))
    return c.select("snapshot_id", "line", F.col("departure_time.tz").alias("tz"), F.col("departure_time.local").alias("local"), F.col("arrival_station.uid").alias("to_station"), F.col("vehicle.type").alias("vehicle"))


SQL["q_nested_segments"] = f"""
WITH {_ENTRIES}
SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS snapshot_id, CASE WHEN l_linestatus = 'O' THEN 'O ' ELSE '' END || l_returnflag AS line, d.time_zone AS tz,
       CASE WHEN d.time_zone IS NOT NULL THEN timezone('Europe/Berlin', timezone('UTC', l_shipdate + INTERVAL 12 HOUR)) END AS "local", 'st' || (l_partkey % 25) AS to_station, 'BUS' AS vehicle
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN stations d ON d.code = 'st' || (l_suppkey % 25)
"""


def q_legacy_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals in the departure station's zone, as older documents have them."""
    c = clean_trips(_documents(spark, sf_dir), _entries(spark, sf_dir), legacy_arrival_zone=True)
    return c.select("snapshot_id", F.col("departure_time.tz").alias("departure_tz"), F.col("arrival_time.tz").alias("arrival_tz"), F.col("arrival_time.local").alias("arrival_local"))


SQL["q_legacy_arrival"] = f"""
WITH {_ENTRIES}, o AS (SELECT *, o_orderdate + INTERVAL 14 HOUR AS t FROM orders)
SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS snapshot_id, d.time_zone AS departure_tz, d.time_zone AS arrival_tz, CASE WHEN d.time_zone IS NOT NULL THEN timezone('Europe/Berlin', timezone('UTC', t)) END AS arrival_local
FROM o LEFT JOIN stations d ON d.code = 'st' || (o_custkey % 25)
"""


def q_nested_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with prices and times that don't fit: each is told of in its errors, and none stops the job."""
    key = F.col("snapshot_id").cast("bigint")
    raw = _documents(spark, sf_dir).withColumns({
        "total_price": F.when(key % 5 == 0, F.col("total_price") * 1_000_000_000).otherwise(F.col("total_price")),
        "departure_time": F.when(key % 7 == 0, F.lit(10**16)).otherwise(F.col("departure_time")),
        "snapshot_timestamp": F.when(key % 11 == 0, F.lit(2**62)).otherwise(F.col("snapshot_timestamp")),
        "fares": F.when(key % 3 == 0, F.transform("fares", lambda f: F.struct((f["price"] * 1_000_000_000).alias("price"), f["fare_class"].alias("fare_class")))).otherwise(F.col("fares")),
        "segments": F.transform("segments", lambda s: F.when(key % 4 == 0, s.withField("arrival_time", F.lit(-(10**17)))).otherwise(s)),
    })
    bad = clean_trips(raw, _entries(spark, sf_dir)).select("snapshot_id", F.col("total_price").isNull().alias("no_price"), F.filter("_errors", lambda e: e.contains("bad value") | e.contains("without a time")).alias("e"))
    return bad.where(F.size("e") > 0).select("snapshot_id", "no_price", F.array_join(F.array_sort("e"), ";").alias("errors"))


SQL["q_nested_errors"] = """
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS price, n IS NOT NULL AS legs FROM orders LEFT JOIN n ON l_orderkey = o_orderkey),
y AS (SELECT lpad(CAST(k AS VARCHAR), 12, '0') AS snapshot_id, price AS no_price, concat_ws(';', CASE WHEN k % 7 = 0 THEN 'departure_time: bad value' END, CASE WHEN k % 3 = 0 AND legs THEN 'fares: bad value' END,
  CASE WHEN k % 4 = 0 AND legs THEN 'segment without a time' END, CASE WHEN k % 11 = 0 THEN 'snapshot_timestamp: bad value' END, CASE WHEN price THEN 'total_price: bad value' END) AS errors FROM x)
SELECT * FROM y WHERE errors <> ''
"""


def q_total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each search response says there are."""
    body = table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.struct(F.struct((F.col("n_nationkey") * 7).alias("value")).alias("total")).alias("hits"))).alias("body"))
    return total_hits(body)


SQL["q_total_hits"] = "SELECT CAST(n_nationkey * 7 AS BIGINT) AS total_hits FROM nation"


def q_parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search responses of up to 100 documents each, parsed and flattened."""
    docs = _documents(spark, sf_dir).select(F.floor(F.col("snapshot_id").cast("bigint") / 100).alias("page"), F.struct(F.struct("*").alias("_source")).alias("hit"))
    body = docs.groupBy("page").agg(F.to_json(F.struct(F.struct(F.struct(F.count(F.lit(1)).alias("value")).alias("total"), F.collect_list("hit").alias("hits")).alias("hits"))).alias("body"))
    return parse_responses(body).select("snapshot_id", F.col("marketing_carrier.uid").alias("carrier"), "total_price", F.size("segments").alias("n_segments"), "booked_out")


SQL["q_parse_responses"] = """
SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS snapshot_id, o_orderpriority AS carrier, CAST(round(o_totalprice * 100) AS BIGINT) AS total_price, CAST(coalesce(n, 0) AS INTEGER) AS n_segments, o_orderkey % 2 = 0 AS booked_out
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
"""


def queries() -> dict[str, Query]:
    return {n: f for n, f in globals().items() if n.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
