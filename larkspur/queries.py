"""Registered queries of the engine and the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import Engine
from .functions import calendar, codec, crypto, ids, sequence, strings
from .operators import buckets, convert, dml, kv, monitor, select, sharding
from .operators.predicates import by_id, where
from .plans.ir import Condition as C
from .plans.ir import Field, Join, Keyset, Order, Page, Query, RangeType, TimeRange, Update, Value, ValueType
from .plans.params import FieldDefined, params_of, parse_query
from .sources.files import fresh_path, parquet, stored
from .streaming import flows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, folder) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return parquet(spark, folder, name)


def _orders(spark, folder):
    """orders with an id, for the page queries."""
    return _t(spark, folder, "orders").withColumn("id", F.col("o_orderkey"))


# ---- pages


@query("""
SELECT o.o_orderkey, o.o_totalprice, o.o_orderstatus, c.c_name
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus IN ('F', 'O') AND c.c_mktsegment LIKE '%BUILD%'
ORDER BY o.o_totalprice DESC NULLS FIRST, o.o_orderkey ASC LIMIT 50 OFFSET 0
""")
def page_left_join(spark, folder):
    """The flagship: parameters of a URL to a page of joined rows."""
    fields = {
        "statuses": FieldDefined("o_orderstatus", "in", ValueType.STRING, lambda p, k: Value.string_array(p[k].split(","))),
        "segment": FieldDefined("u.c_mktsegment", "like", ValueType.STRING),
        "price": FieldDefined("o_totalprice", ">=", ValueType.STATUS),
        "by_price": FieldDefined("o_totalprice", ">", ValueType.DOUBLE),
    }
    q = parse_query(params_of("/orders?statuses=F,O&segment=BUILD&price=0&sort=by_price&sort_by_price=desc&page_size=50"), fields)
    join = Join("customer", "o_custkey", "u.c_custkey", "u.")
    tables = {"orders": _t(spark, folder, "orders"), "customer": _t(spark, folder, "customer")}
    return select.build_query(tables, "orders", "o_orderkey,o_totalprice,o_orderstatus,u.c_name", q.with_(pk="o_orderkey"), 100, join).page


@query("SELECT count(o_orderkey) AS count FROM orders WHERE o_totalprice > 100000")
def page_total_count(spark, folder):
    q = Query((C("o_totalprice", ">", Value.double(100000.0)),), return_total=True, pk="o_orderkey")
    return select.build_query({"orders": _t(spark, folder, "orders")}, "orders", "*", q).total


@query("SELECT count(o.o_orderkey) AS count FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity < 10")
def page_total_count_join(spark, folder):
    """The count sees every joined row."""
    q = Query((C("l.l_quantity", "<", Value.double(10.0)),), return_total=True, pk="o_orderkey", join=Join("lineitem", "o_orderkey", "l.l_orderkey", "l"))
    tables = {"orders": _t(spark, folder, "orders"), "lineitem": _t(spark, folder, "lineitem")}
    return select.build_query(tables, "orders", "o_orderkey", q).total


def _filtered(name: str, table: str, conditions: list, columns: str, sql_where: str) -> None:
    def run(spark, folder):
        return select.build_query({table: _t(spark, folder, table)}, table, columns, Query(tuple(conditions))).page

    run.__name__ = name
    query(f"SELECT {columns} FROM {table} WHERE {sql_where}")(run)


_filtered("filter_in", "orders", [C("o_orderpriority", "IN", Value.string_array(["1-URGENT", "2-HIGH"]))], "o_orderkey,o_orderpriority", "o_orderpriority IN ('1-URGENT','2-HIGH')")
_filtered("filter_not_in", "lineitem", [C("l_linenumber", "not in", Value.int_array([1, 2, 3]))], "l_orderkey,l_linenumber", "l_linenumber NOT IN (1,2,3)")
_filtered("filter_like", "part", [C("p_name", "like", Value.string("e_"))], "p_partkey,p_name", "p_name LIKE '%e_%'")
_filtered("filter_cmp", "lineitem", [C("l_quantity", ">=", Value.double(45.0)), C("l_returnflag", "<>", Value.string("N"))], "l_orderkey,l_linenumber,l_quantity", "l_quantity >= 45 AND l_returnflag <> 'N'")
_filtered("filter_status", "part", [C("p_size", "=", Value.status(7)), C("p_partkey", ">", Value.status(0))], "p_partkey,p_size", "p_size = 7")
_filtered("filter_statuses", "part", [C("p_size", "in", Value.statuses([0, 5, 6]))], "p_partkey,p_size", "p_size IN (0,5,6)")
_filtered("filter_double_array", "lineitem", [C("l_discount", "in", Value.double_array([0.01, 0.02]))], "l_orderkey,l_linenumber,l_discount", "l_discount IN (0.01, 0.02)")
_filtered("filter_optional_dropped", "orders", [C("o_orderdate", ">", Value(ValueType.TIME, 0)), C("", "=", Value.int(1)), C("o_custkey", "", Value.int(1)), C("o_custkey", "=", None), C("o_orderstatus", "in", Value(ValueType.STRING_ARRAY, ())), C("o_orderstatus", "=", Value.string("F"))], "o_orderkey", "o_orderstatus = 'F'")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND event_id > 10")
def filter_time(spark, folder):
    """The time is compared with the zone-less column itself, so the range reaches the scan."""
    at = 1_705_276_800 * 1_000_000_000
    return where(_t(spark, folder, "events"), [C("ts", ">=", Value.time(at)), C("event_id", ">", Value.int(10))]).select("event_id", "ts")


@query("SELECT count(*) AS n FROM orders WHERE o_orderdate IN (TIMESTAMP '1996-01-02', TIMESTAMP '1997-01-01')")
def filter_time_array(spark, folder):
    times = Value.time_array([0, 820_540_800 * 10**9, 852_076_800 * 10**9])
    return where(_t(spark, folder, "orders"), [C("o_orderdate", "in", times)]).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 42")
def filter_by_id(spark, folder):
    return by_id(_t(spark, folder, "part"), 42, "p_partkey").select("p_partkey", "p_name")


@query("SELECT l_orderkey FROM (SELECT l_orderkey, list(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_orderkey) WHERE list_has_any(a, [6, 7])")
def array_any(spark, folder):
    sets = _t(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("a"))
    return where(sets, [C("a", "&&", Value.pg_int_array([6, 7]))]).select("l_orderkey")


@query("SELECT l_orderkey FROM (SELECT l_orderkey, list(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_orderkey) WHERE list_has_all(a, [1, 2, 3])")
def array_contains_all(spark, folder):
    sets = _t(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("a"))
    return where(sets, [C("a", "@>", Value.pg_int_array([1, 2, 3]))]).select("l_orderkey")


@query("SELECT l_orderkey FROM (SELECT l_orderkey, list(DISTINCT l_returnflag) AS a FROM lineitem GROUP BY l_orderkey) WHERE list_has_all(['A','R'], a)")
def array_contained(spark, folder):
    sets = _t(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"))
    return where(sets, [C("a", "<@", Value.pg_string_array(["A", "R"]))]).select("l_orderkey")


@query("""
SELECT o.o_orderkey, c.c_name FROM orders o
LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON o.o_custkey = c.c_custkey
""")
def left_join_null_rows(spark, folder):
    tables = {"orders": _t(spark, folder, "orders"), "customer": _t(spark, folder, "customer").where("c_mktsegment = 'BUILDING'")}
    return select.build_query(tables, "orders", "o_orderkey,u.c_name", Query(join=Join("customer", "o_custkey", "u.c_custkey", "u."))).page


@query("SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 2")
def left_join_where_right(spark, folder):
    tables = {"customer": _t(spark, folder, "customer"), "nation": _t(spark, folder, "nation")}
    q = Query((C("n.n_regionkey", "=", Value.int(2)),), join=Join("nation", "c_nationkey", "n.n_nationkey", "n"))
    return select.build_query(tables, "customer", "c_custkey,n.n_name", q).page


@query("""
SELECT o_orderkey, s FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders)
ORDER BY s DESC NULLS FIRST, o_orderkey ASC NULLS LAST LIMIT 40
""")
def order_multi_nulls(spark, folder):
    o = _t(spark, folder, "orders").withColumn("s", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    q = Query(orders=(Order("s", "desc"), Order("o_orderkey")), page=Page(40), pk="o_orderkey")
    return select.build_query({"o": o}, "o", "o_orderkey,s", q).page


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate ASC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50")
def page_second(spark, folder):
    q = Query(orders=(Order("o_orderdate"),), page=Page(25, 2), pk="o_orderkey")
    return select.build_query({"o": _t(spark, folder, "orders")}, "o", "o_orderkey", q).page


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20")
def page_clamped(spark, folder):
    q = Query(orders=(Order("o_orderkey"),), page=Page(5000, -3), pk="o_orderkey")
    return select.build_query({"o": _t(spark, folder, "orders")}, "o", "o_orderkey", q, max_page_size=20).page


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30")
def page_default_size(spark, folder):
    q = Query(orders=(Order("o_orderkey"),), page=Page(), pk="o_orderkey")
    return select.build_query({"o": _t(spark, folder, "orders")}, "o", "o_orderkey", q).page


START_ASC = {"start_id": FieldDefined("o_orderkey", ">", ValueType.STATUS)}
START_DESC = {"start_id": FieldDefined("o_orderkey", "<", ValueType.STATUS)}


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey ASC LIMIT 20")
def keyset_asc(spark, folder):
    q = parse_query(params_of("start_id=500&page_size=20"), START_ASC).with_(pk="o_orderkey")
    return select.build_query({"o": _t(spark, folder, "orders")}, "o", "o_orderkey", q).page


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def keyset_desc(spark, folder):
    q = parse_query(params_of("start_id=0&page_size=20"), START_DESC).with_(pk="o_orderkey")
    return select.build_query({"o": _t(spark, folder, "orders")}, "o", "o_orderkey", q).page


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 15")
def keyset_page(spark, folder):
    return select.keyset(_t(spark, folder, "orders"), Keyset(1000, 15), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100 OFFSET 200")
def append_limit(spark, folder):
    ordered = _t(spark, folder, "lineitem").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber")
    return select.append_limit(ordered, Page(-1, 2), 100)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def topk_price(spark, folder):
    by = [Order("l_extendedprice", "desc"), Order("l_orderkey"), Order("l_linenumber")]
    return select.top(_t(spark, folder, "lineitem"), by, 25).select("l_orderkey", "l_linenumber", "l_extendedprice")


# ---- time buckets


def _bucketed(name: str, kind: RangeType, sql: str, interval: int = 1, week_start: str = "monday", table: str = "events", col: str = "ts") -> None:
    def run(spark, folder):
        return buckets.counts_by(_t(spark, folder, table), F.col(col), kind, interval, week_start)

    run.__name__ = name
    query(f"SELECT CAST({sql} AS TIMESTAMP) AS bucket, count(*) AS n FROM {table} GROUP BY 1")(run)


_bucketed("bucket_minute", RangeType.MINUTE, "date_trunc('minute', ts)")
_bucketed("bucket_minute_n", RangeType.MINUTE_N, "date_trunc('hour', ts) + to_minutes(CAST(floor(minute(ts) / 7) * 7 AS INTEGER))", interval=7)
_bucketed("bucket_hour", RangeType.HOUR, "date_trunc('hour', ts)")
_bucketed("bucket_day", RangeType.DAY, "date_trunc('day', ts)")
_bucketed("bucket_week_mon", RangeType.WEEK, "date_trunc('week', ts)")
_bucketed("bucket_week_sun", RangeType.WEEK, "date_trunc('day', ts) - to_days(CAST(dayofweek(ts) AS INTEGER))", week_start="sunday")
_bucketed("bucket_month", RangeType.MONTH, "date_trunc('month', o_orderdate)", table="orders", col="o_orderdate")
_bucketed("bucket_year", RangeType.YEAR, "date_trunc('year', o_orderdate)", table="orders", col="o_orderdate")


@query("""
SELECT i AS point, CAST(epoch_ns(CASE WHEN i = 0 THEN TIMESTAMP '2024-01-10 05:00:00' ELSE date_trunc('month', TIMESTAMP '2024-01-10 05:00:00') + to_months(CAST(i AS INTEGER)) - INTERVAL 8 HOUR END) AS BIGINT) AS nanos
FROM range(0, 5) t(i)
""")
def bucket_boundaries(spark, folder):
    start, end = 1_704_862_800 * 10**9, 1_713_000_000 * 10**9
    points = buckets.boundaries(TimeRange(RangeType.MONTH, start, end))
    return spark.createDataFrame(list(enumerate(points)), "point long, nanos long")


@query("""
SELECT event_id, CAST(epoch_ns(date_trunc('day', ts + INTERVAL 8 HOUR) - INTERVAL 8 HOUR) AS BIGINT) AS day,
 CAST(epoch_ns(date_trunc('day', ts + INTERVAL 8 HOUR) - to_days(CAST(dayofweek(ts + INTERVAL 8 HOUR) AS INTEGER)) - INTERVAL 8 HOUR) AS BIGINT) AS week,
 CAST(epoch_ns(date_trunc('month', ts + INTERVAL 8 HOUR) - INTERVAL 8 HOUR) AS BIGINT) AS month,
 CAST(epoch_ns(date_trunc('year', ts + INTERVAL 8 HOUR) - INTERVAL 8 HOUR) AS BIGINT) AS year FROM events
""")
def calendar_starts(spark, folder):
    n = calendar.utc_micros(F.col("ts")) * 1000
    return _t(spark, folder, "events").select("event_id", *[calendar.start_col(n, u).alias(u) for u in calendar.UNITS])


def _utc(name: str):
    """A zone-less column as UTC."""
    return calendar.utc(F.col(name))


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS text FROM events")
def calendar_format(spark, folder):
    return _t(spark, folder, "events").select("event_id", calendar.format_cst(_utc("ts"), "seconds").alias("text"))


# ---- sequences

SEQ = "((epoch_us(ts) // 1000 - 1444281954363) << 18) | ((event_id % 1024) << 8) | ((user_id % 32) << 3) | (event_id % 8)"


def _seq(spark, folder):
    ms = F.floor(calendar.utc_micros(F.col("ts")) / 1000)
    return _t(spark, folder, "events").withColumn("id", sequence.pack(ms, F.col("event_id") % 1024, F.col("user_id") % 32, F.col("event_id") % 8))


@query(f"SELECT event_id, {SEQ} AS id FROM events")
def seq_pack(spark, folder):
    return _seq(spark, folder).select("event_id", "id")


@query(f'SELECT id, (id >> 18) + 1444281954363 AS "createTimeMS", (id >> 3) & 31 AS "nodeID", (id >> 8) & 1023 AS "index", id & 7 AS "dcID" FROM (SELECT {SEQ} AS id FROM events)')
def seq_parse(spark, folder):
    return _seq(spark, folder).select(sequence.parse(F.col("id")).alias("s")).select("s.*")


@query(f"SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events")
def seq_to_time(spark, folder):
    return _seq(spark, folder).select("event_id", F.unix_millis(sequence.to_time(F.col("id"))).alias("ms"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND epoch_us(ts) // 1000 <= epoch_ms(TIMESTAMP '2024-01-12')")
def seq_range_filter(spark, folder):
    """A time range as a range of a stored id column, which the scan prunes by."""
    return stored(_seq(spark, folder).select("event_id", "id"), "sequences").where(sequence.between(F.col("id"), 1_704_844_800 * 10**9, 1_705_017_600 * 10**9)).select("event_id")


@query(f"""
SELECT event_id, id AS back, strftime(ts + INTERVAL 8 HOUR, '%Y%m%d%H%M%S') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') AS head
FROM (SELECT event_id, ts, {SEQ} AS id FROM events)
""")
def seq_no_roundtrip(spark, folder):
    rows = _seq(spark, folder).select("event_id", "id").select("event_id", sequence.to_no(F.col("id")).alias("no"))
    return rows.select("event_id", sequence.from_no(F.col("no")).alias("back"), F.substring("no", 1, 17).alias("head"))


@query(f"SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y%m%d') || lower(to_hex(id)) AS text FROM (SELECT event_id, ts, {SEQ} AS id FROM events)")
def seq_format(spark, folder):
    return _seq(spark, folder).select("event_id", sequence.format_sequence("yyyyMMdd", F.col("id")).alias("text"))


@query("SELECT count(*) AS n, count(*) AS ids, CAST(1 AS BIGINT) AS least_dc, CAST(1 AS BIGINT) AS most_dc, CAST(0 AS BIGINT) AS before_now, CAST(0 AS BIGINT) AS odd FROM lineitem")
def seq_generate(spark, folder):
    """Distinct ids of one data centre, none of an earlier time, none whose parts don't make it again."""
    now = 1_704_067_200_000
    made = sequence.with_ids(_t(spark, folder, "lineitem").select("l_orderkey"), "id", now, dc=1).withColumn("p", sequence.parse(F.col("id")))
    again = sequence.pack(F.col("p.createTimeMS"), F.col("p.index"), F.col("p.nodeID"), F.col("p.dcID"))
    count = lambda c, name: F.count_if(c).alias(name)
    return made.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("p.dcID").alias("least_dc"), F.max("p.dcID").alias("most_dc"), count(F.col("p.createTimeMS") < now, "before_now"), count(again != F.col("id"), "odd"))


# ---- scalars


@query("SELECT o_orderkey, CASE WHEN v < 0 THEN '-' ELSE '' END || lower(to_hex(abs(v))) AS hex FROM (SELECT o_orderkey, CAST(o_orderkey * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) AS v FROM orders)")
def hex_id(spark, folder):
    v = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))
    return _t(spark, folder, "orders").select("o_orderkey", ids.hex_encode(v).alias("hex"))


@query("SELECT o_orderkey, CAST(o_orderkey * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) AS id, CAST(0 AS BIGINT) AS bad FROM orders")
def hex_id_decode(spark, folder):
    v = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))
    return _t(spark, folder, "orders").select("o_orderkey", ids.hex_decode_col(ids.hex_encode(v)).alias("id"), ids.hex_decode_col(F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).alias("bad"))


@query("""
SELECT o_orderkey, CAST(a * 16777216 + b * 65536 + c * 256 + d AS BIGINT) AS n FROM (
 SELECT o_orderkey, o_orderkey % 256 AS a, (o_orderkey * 7) % 256 AS b, o_custkey % 256 AS c, (o_custkey * 3) % 256 AS d FROM orders)
""")
def ip_encode(spark, folder):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return _t(spark, folder, "orders").select("o_orderkey", ids.ip_encode(F.concat_ws(".", k % 256, (k * 7) % 256, c % 256, (c * 3) % 256)).alias("n"))


@query("SELECT o_orderkey, (v >> 24) & 255 || '.' || ((v >> 16) & 255) || '.' || ((v >> 8) & 255) || '.' || (v & 255) AS ip FROM (SELECT o_orderkey, (o_orderkey * 2654435 + o_custkey) % 4294967296 AS v FROM orders)")
def ip_decode(spark, folder):
    v = (F.col("o_orderkey") * 2654435 + F.col("o_custkey")) % 4294967296
    return _t(spark, folder, "orders").select("o_orderkey", ids.ip_decode(v).alias("ip"))


@query("SELECT c_custkey, rtrim(translate(to_base64(encode(c_name || c_mktsegment)), '+/', '-_'), '=') AS b, c_name || c_mktsegment AS back FROM customer")
def base64_url(spark, folder):
    b = ids.base64_url(F.encode(F.concat("c_name", "c_mktsegment"), "UTF-8"))
    return _t(spark, folder, "customer").select("c_custkey", b.alias("b"), F.decode(ids.unbase64_url(b), "UTF-8").alias("back"))


@query("SELECT c_custkey, rtrim(to_base64(encode(c_name)), '=') AS b, c_name AS back FROM customer")
def base64_raw(spark, folder):
    b = ids.base64_raw(F.encode("c_name", "UTF-8"))
    return _t(spark, folder, "customer").select("c_custkey", b.alias("b"), F.decode(ids.unbase64_raw(b), "UTF-8").alias("back"))


@query("""
SELECT o_orderkey, array_to_string(list_reverse(regexp_extract_all(lpad(to_hex(o_orderkey), 16, '0'), '..')), '') AS hex, o_orderkey AS back FROM orders
""")
def int_bytes_le(spark, folder):
    b = ids.bytes_le(F.col("o_orderkey"))
    return _t(spark, folder, "orders").select("o_orderkey", F.hex(b).alias("hex"), ids.int_le(b).alias("back"))


@query("SELECT o_orderkey, lpad(to_hex(o_orderkey), 16, '0') AS hex, o_orderkey AS back, lpad(to_hex(o_custkey), 8, '0') AS hex4, CAST(o_custkey AS INTEGER) AS back4 FROM orders")
def int_bytes_be(spark, folder):
    b, s = codec.INT64.encode(F.col("o_orderkey")), codec.INT32.encode(F.col("o_custkey"))
    return _t(spark, folder, "orders").select("o_orderkey", F.hex(b).alias("hex"), codec.INT64.decode(b).alias("back"), F.hex(s).alias("hex4"), codec.INT32.decode(s).alias("back4"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS ids FROM lineitem GROUP BY l_orderkey")
def ids_distinct(spark, folder):
    a = _t(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("a"))
    return a.select("l_orderkey", F.array_join(F.sort_array(strings.distinct(F.col("a"))), ",").alias("ids"))


@query("""
SELECT o_orderkey, array_to_string(list_filter(s, lambda x: NOT list_contains(t, x)), ',') AS source_only, array_to_string(list_filter(t, lambda x: NOT list_contains(s, x)), ',') AS target_only
FROM (SELECT o_orderkey, [o_orderkey % 3, o_custkey % 3, 7, 7] AS s, [o_custkey % 5, o_orderkey % 5, 9] AS t FROM orders)
""")
def ids_diff(spark, folder):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    seven, nine = F.lit(7).cast("long"), F.lit(9).cast("long")
    d = strings.difference(F.array(k % 3, c % 3, seven, seven), F.array(c % 5, k % 5, nine))
    return _t(spark, folder, "orders").select("o_orderkey", d.alias("d")).select("o_orderkey", *[F.array_join(f"d.{c}", ",").alias(c) for c in ("source_only", "target_only")])


@query("SELECT o_orderkey, array_to_string(list_filter([o_orderkey, CAST(o_custkey % 2 AS BIGINT), CAST(5 AS BIGINT)], lambda x: x <> 0), ',') AS ids FROM orders")
def read_ids(spark, folder):
    a = F.array(F.col("o_orderkey").cast("string"), (F.col("o_custkey") % 2).cast("string"), F.lit("bad"), F.lit("5"))
    return _t(spark, folder, "orders").select("o_orderkey", F.array_join(strings.read_ids(a), ",").alias("ids"))


@query("""
SELECT doc_id, CAST(CASE WHEN strpos(text, 'é') = 0 THEN -1 ELSE strlen(substr(text, 1, strpos(text, 'é') - 1)) END AS INTEGER) AS at FROM documents
""")
def byte_search(spark, folder):
    return _t(spark, folder, "documents").select("doc_id", strings.byte_search(F.col("text"), F.lit("é")).alias("at"))


@query("SELECT o_orderkey, substr(m, 1, 3) || '****' || substr(m, 8) AS masked FROM (SELECT o_orderkey, '13' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS m FROM orders)")
def mask_mobile(spark, folder):
    m = F.concat(F.lit("13"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    return _t(spark, folder, "orders").select("o_orderkey", strings.mask_mobile(m).alias("masked"))


@query("SELECT o_orderkey, regexp_matches(m, '^1[3456789]\\d{9}$') AS ok FROM (SELECT o_orderkey, '1' || CAST(o_orderkey % 10 AS VARCHAR) || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS m FROM orders)")
def verify_mobile(spark, folder):
    m = F.concat(F.lit("1"), (F.col("o_orderkey") % 10).cast("string"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    return _t(spark, folder, "orders").select("o_orderkey", strings.verify_mobile(m).alias("ok"))


_MAILS = ["'user_' || k || '@mail.example.com'", "'user_' || k || 'mail.example.com'", "'a.b-c' || k || '@x-y.co.uk'", "'u' || k || '@host'", "'@x' || k || '.com'", "'u ' || k || '@x.com'", "'u' || k || '@x.com '", "'u' || k || '@x..com'"]
_MAIL = "CASE k % 8 " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(_MAILS)) + " END"


@query(f"SELECT k AS o_orderkey, regexp_full_match({_MAIL}, '{strings.EMAIL[1:-2]}') AS ok FROM (SELECT o_orderkey AS k FROM orders)")
def verify_email(spark, folder):
    """Addresses of eight shapes, whole texts against the pattern."""
    rows = _t(spark, folder, "orders").select(F.col("o_orderkey").alias("k")).select("k", F.expr(_MAIL).alias("m"))
    return rows.select(F.col("k").alias("o_orderkey"), strings.verify_email(F.col("m")).alias("ok"))


@query("SELECT c_custkey, regexp_full_match(lower(replace(c_name, '#', '')), '[a-zA-Z0-9._@-]{6,32}') AS ok, regexp_full_match(c_mktsegment, '[a-zA-Z0-9._@-]{6,32}') AS ok2 FROM customer")
def verify_username(spark, folder):
    return _t(spark, folder, "customer").select("c_custkey", strings.verify_username(F.lower(F.replace("c_name", F.lit("#"), F.lit("")))).alias("ok"), strings.verify_username(F.col("c_mktsegment")).alias("ok2"))


_WORDS = ["'a]1]abc' || lpad(CAST(k AS VARCHAR(20)), 8, '0')", "'plainPassword1'", "'a]1]'", "'short]' || k", "c_name", "'Ab1!' || k || c_name", "repeat('a]', 20)", "''"]
_WORD = "CASE k % 8 " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(_WORDS)) + " END"


@query(f"SELECT k AS c_custkey, regexp_full_match({_WORD}, '{strings.PASSWORD[1:-2]}') AS ok FROM (SELECT c_custkey AS k, c_name FROM customer)")
def verify_password(spark, folder):
    """Words of eight shapes, whole texts against the pattern."""
    rows = _t(spark, folder, "customer").select(F.col("c_custkey").alias("k"), "c_name").select("k", F.expr(_WORD).alias("p"))
    return rows.select(F.col("k").alias("c_custkey"), strings.verify_password(F.col("p")).alias("ok"))


_IDCARD = " + ".join(f"CAST(substr(s, {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate(strings.WEIGHTS))


@query(f"SELECT c_custkey, substr('10x98765432', ({_IDCARD}) % 11 + 1, 1) = 'x' AS ok FROM (SELECT c_custkey, '11010119900' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS s FROM customer)")
def verify_idcard(spark, folder):
    card = F.concat(F.lit("11010119900"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit("x"))
    return _t(spark, folder, "customer").select("c_custkey", strings.verify_id_card(card).alias("ok"))


@query("SELECT c_custkey, md5(c_name) AS h FROM customer")
def hash_md5(spark, folder):
    return _t(spark, folder, "customer").select("c_custkey", crypto.hash_hex("md5", F.col("c_name")).alias("h"))


@query("SELECT c_custkey, sha1(c_name) AS h FROM customer")
def hash_sha1(spark, folder):
    return _t(spark, folder, "customer").select("c_custkey", crypto.hash_hex("sha1", F.col("c_name")).alias("h"))


@query("SELECT c_custkey, sha256(c_name) AS h FROM customer")
def hash_sha256(spark, folder):
    return _t(spark, folder, "customer").select("c_custkey", crypto.hash_hex("sha256", F.col("c_name")).alias("h"))


@query()
def hash_sha512(spark, folder):
    return _t(spark, folder, "customer").select("c_custkey", crypto.hash_hex("sha512", F.col("c_name")).alias("h"))


@query("SELECT c_custkey, CAST(CASE WHEN n >= 9223372036854775808 THEN n - 18446744073709551616 ELSE n END AS BIGINT) AS n FROM (SELECT c_custkey, CAST(('0x' || right(md5(c_name), 16)) AS UBIGINT)::HUGEINT AS n FROM customer)")
def hash_int(spark, folder):
    return _t(spark, folder, "customer").select("c_custkey", crypto.hash_long("md5", F.col("c_name")).alias("n"))


def _key(c: str):
    return F.substring(F.unhex(F.md5(F.col(c))), 1, 16)


@query("SELECT c_custkey, c_name AS back, (strlen(c_name) // 16 + 1) * 16 AS size FROM customer")
def aes_roundtrip(spark, folder):
    key, iv = _key("c_mktsegment"), _key("c_name")
    c = crypto.cbc_encrypt(F.encode("c_name", "UTF-8"), key, iv)
    return _t(spark, folder, "customer").select("c_custkey", F.decode(crypto.cbc_decrypt(c, key, iv), "UTF-8").alias("back"), F.octet_length(c).cast("long").alias("size"))


@query("SELECT c_custkey, c_name AS back, (strlen(c_name) // 16 + 1) * 16 AS size FROM customer")
def aes_zeros_roundtrip(spark, folder):
    key, iv = _key("c_mktsegment"), _key("c_name")
    c = crypto.cbc_encrypt(F.encode("c_name", "UTF-8"), key, iv, crypto.ZEROS)
    return _t(spark, folder, "customer").select("c_custkey", F.decode(crypto.cbc_decrypt(c, key, iv, crypto.ZEROS), "UTF-8").alias("back"), F.octet_length(c).cast("long").alias("size"))


@query("SELECT c_custkey, c_name AS back, '00000000' AS head, 20 + 16 + (strlen(c_name) // 16 + 1) * 16 AS size FROM customer")
def data_encode_roundtrip(spark, folder):
    mask = crypto.DataMasker(bytes((i * 7 + 3) % 256 for i in range(255)))
    key = F.unhex(F.regexp_replace(F.hex(_key("c_mktsegment")), "FF", "FE"))
    e = crypto.data_encode(F.encode("c_name", "UTF-8"), key, _key("c_name"), mask)
    rows = _t(spark, folder, "customer").select("c_custkey", e.alias("e"))
    return rows.select("c_custkey", F.decode(crypto.data_decode(F.col("e"), mask), "UTF-8").alias("back"), F.substring(F.hex("e"), 1, 8).alias("head"), F.octet_length("e").cast("long").alias("size"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, folder):
    c = codec.json("k bigint")
    return _t(spark, folder, "events").select("event_id", c.decode(F.encode("props", "UTF-8"))["k"].alias("k"))


@query("SELECT event_id, CASE WHEN epoch_ns(ts) >= epoch_ns(TIMESTAMP '2024-01-20') THEN props END AS data FROM events")
def cache_envelope_live(spark, folder):
    cell = codec.envelope(F.encode("props", "UTF-8"), F.unix_micros(_utc("ts")) * 1000)
    return _t(spark, folder, "events").select("event_id", F.decode(codec.live(cell, 1_705_708_800 * 10**9), "UTF-8").alias("data"))


@query("SELECT c_custkey, true AS i, true AS none, true AS s, true AS b, true AS n FROM customer")
def random_values(spark, folder):
    """Whether each value lies in its range; that they differ is a test's."""
    i, none, s, b, n = crypto.random_int(5, 9, 1), crypto.random_int(7, 7, 1), crypto.random_string(8, 2), crypto.random_bytes(40, 3), crypto.random_long(4)
    rows = _t(spark, folder, "customer").select("c_custkey", i.alias("i"), none.alias("none"), s.alias("s"), b.alias("b"), n.alias("n"))
    return rows.select("c_custkey", F.col("i").between(5, 8).alias("i"), (F.col("none") == 7).alias("none"), F.col("s").rlike("^[0-9A-Za-z]{8}\\z").alias("s"), (F.octet_length("b") == 40).alias("b"), (F.col("n") >= 0).alias("n"))


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS BOOLEAN) AS in_range FROM customer")
def random_ip(spark, folder):
    """Even customers are of a province with ranges, odd ones of none."""
    from .functions.ip_ranges import flatten, random_ips

    ranges = spark.createDataFrame([("p", [("10.0.0.0", "10.0.0.9"), ("10.1.0.0", "10.1.0.5")])], "province string, ranges array<struct<min:string,max:string>>")
    asked = _t(spark, folder, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "p").otherwise("q").alias("province"))
    got = random_ips(asked, flatten(ranges), 5, F.col("province"))
    return got.select("c_custkey", F.coalesce(F.col("ip").rlike(r"^10\.[01]\.0\.[0-8]\z"), F.lit(False)).alias("in_range"))


# ---- rows: changes, conversion, shards


@query("SELECT c_custkey, CASE WHEN c_custkey = 7 AND c_mktsegment <> 'NONE' THEN 'renamed' ELSE c_name END AS c_name, CASE WHEN c_custkey = 7 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def update_whitelist(spark, folder):
    """The name and a zero balance are taken, the segment is not on the list, an empty text is skipped."""
    u = Update(7, (Field("c_name", Value.string("renamed")), Field("c_acctbal", Value.double(0.0)), Field("c_mktsegment", Value.string("X"))), (C("c_mktsegment", "<>", Value.string("NONE")),))
    return dml.apply_update(_t(spark, folder, "customer"), u, ["c_name", "c_acctbal"], "c_custkey").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("SELECT p_partkey, CASE WHEN p_partkey = 4 THEN 77 ELSE p_size END AS p_size, CASE WHEN p_partkey = 3 THEN 'B' ELSE p_brand END AS p_brand FROM part")
def update_status_guard(spark, folder):
    """A status of 0 is skipped while the field beside it is taken; one above 0 is taken."""
    none, some = Update(3, (Field("p_size", Value.status(0)), Field("p_brand", Value.string("B")))), Update(4, (Field("p_size", Value.status(77)),))
    rows = _t(spark, folder, "part")
    for u in (none, some):
        rows = dml.apply_update(rows, u, ["p_size", "p_brand"], "p_partkey")
    return rows.select("p_partkey", "p_size", "p_brand")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 4")
def delete_by_id(spark, folder):
    return dml.delete_by_id(_t(spark, folder, "nation"), 4, "n_nationkey").select("n_nationkey", "n_name")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '!' ELSE s_name END AS s_name FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name || '!' FROM supplier WHERE s_suppkey % 2 = 1")
def upsert(spark, folder):
    s = _t(spark, folder, "supplier").select("s_suppkey", "s_name")
    fresh = s.select(F.when(F.col("s_suppkey") % 2 == 1, F.col("s_suppkey") + 1_000_000).otherwise(F.col("s_suppkey")).alias("s_suppkey"), F.concat("s_name", F.lit("!")).alias("s_name"))
    return dml.upsert(s, fresh, ["s_suppkey"])


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NOWHERE'")
def insert(spark, folder):
    return dml.insert(_t(spark, folder, "region"), spark.createDataFrame([(99, "NOWHERE")], "r_regionkey int, r_name string"))


@query("""
SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '') AS o_orderstatus, CAST(coalesce(nullif(o_custkey, 5), 0) AS BIGINT) AS o_custkey, CAST(epoch_ns(o_orderdate) AS BIGINT) AS o_orderdate FROM orders
""")
def null_to_dto(spark, folder):
    o = _t(spark, folder, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"), F.nullif(F.col("o_custkey"), F.lit(5)).alias("o_custkey"), "o_orderdate")
    return convert.to_transfer(o, times=("o_orderdate",))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS s, o_orderkey % 3 AS z, CASE WHEN o_orderkey % 2 = 0 THEN CAST(epoch_us(o_orderdate) AS BIGINT) END AS us FROM orders")
def dto_to_null(spark, folder):
    o = _t(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("s"), (F.col("o_orderkey") % 3).alias("z"), F.when(F.col("o_orderkey") % 2 == 0, F.unix_micros(_utc("o_orderdate")) * 1000).otherwise(0).alias("t"))
    return convert.from_transfer(o, times=("t",)).select("o_orderkey", "s", "z", F.unix_micros("t").alias("us"))


@query("SELECT o_orderkey, CAST(2 AS BIGINT) AS n, (o_orderkey + 1) || ',' || (o_custkey + 1) AS csv FROM orders")
def ids_csv(spark, folder):
    csv = F.concat_ws(",", F.col("o_orderkey") + 1, F.lit("0"), F.lit("x"), F.col("o_custkey") + 1)
    got = convert.ids_from_csv(csv)
    return _t(spark, folder, "orders").select("o_orderkey", F.size(got).cast("long").alias("n"), convert.ids_to_csv(got).alias("csv"))


@query("SELECT c_custkey AS \"CustKey\", c_name AS \"Name\", '' AS \"Missing\" FROM (SELECT c_custkey, c_name FROM customer)")
def schema_projection(spark, folder):
    rows = _t(spark, folder, "customer").select(F.col("c_custkey").alias("cust_key"), F.col("c_name").alias("name"))
    return convert.project_to_schema(rows, T.StructType().add("CustKey", "long").add("Name", "string").add("Missing", "string"))


@query("SELECT '_' || (o_orderkey % 8) AS shard, count(*) AS n FROM orders GROUP BY 1")
def shard_mod(spark, folder):
    return sharding.with_shard(_t(spark, folder, "orders"), F.col("o_orderkey"), sharding.mod_suffix(8)).groupBy("shard").agg(F.count("*").alias("n"))


@query("SELECT '_' || (o_orderkey // 1000) AS shard, count(*) AS n FROM orders GROUP BY 1")
def shard_range(spark, folder):
    return sharding.with_shard(_t(spark, folder, "orders"), F.col("o_orderkey"), sharding.range_suffix(1000)).groupBy("shard").agg(F.count("*").alias("n"))


# ---- key-value, SQL, monitors


def _kv(spark, folder):
    return _t(spark, folder, "orders").select(kv.id_key("o", F.col("o_orderkey")).alias("key"), F.encode("o_orderpriority", "UTF-8").alias("value"), "o_orderkey")


def _id_key(n: int) -> bytes:
    return b"o\t\t\t" + n.to_bytes(8, "big")


@query("SELECT o_orderkey, o_orderpriority AS v FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300 ORDER BY o_orderkey LIMIT 50")
def kv_range(spark, folder):
    """A stored table of keys, whose bounds reach the scan."""
    return kv.scan(stored(_kv(spark, folder), "keys"), _id_key(100), _id_key(300), most=50).select("o_orderkey", F.decode("value", "UTF-8").alias("v"))


@query("SELECT o_orderkey, o_orderpriority AS v FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300 ORDER BY o_orderkey DESC LIMIT 50")
def kv_range_reverse(spark, folder):
    return kv.scan(_kv(spark, folder), _id_key(100), _id_key(300), True, 50).select("o_orderkey", F.decode("value", "UTF-8").alias("v"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey // 256 = 1")
def kv_prefix(spark, folder):
    return kv.scan_prefix(stored(_kv(spark, folder), "keys"), b"o\t\t\t" + (1).to_bytes(7, "big"), ordered=False).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < 10 OR o_orderkey >= 200")
def kv_delete_range(spark, folder):
    return kv.delete_range(_kv(spark, folder), _id_key(10), _id_key(200)).select("o_orderkey")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000.5 AND o_orderpriority <> '5-LOW' GROUP BY o_orderstatus ORDER BY o_orderstatus LIMIT 2 OFFSET 1")
def sql_passthrough(spark, folder):
    """Raw SQL of the engine, with arguments for its question marks."""
    name = f"larkspur_{uuid.uuid4().hex}"
    engine = Engine(spark).register(**{name: _t(spark, folder, "orders")})
    out = engine.sql(f"SELECT o_orderstatus, count(*) AS n FROM {name} WHERE o_totalprice > ? AND o_orderpriority <> ? GROUP BY o_orderstatus ORDER BY o_orderstatus LIMIT ? OFFSET ?", [1000.5, "5-LOW", 2, 1])
    spark.catalog.dropTempView(name)
    return out


@query("SELECT event_type AS sql, count(*) AS n FROM events GROUP BY event_type")
def sql_count_monitor(spark, folder):
    return monitor.statement_counts(_t(spark, folder, "events").withColumnRenamed("event_type", "sql"))


@query("SELECT event_id FROM events WHERE value > 50.0")
def slow_query(spark, folder):
    return monitor.slow_statements(_t(spark, folder, "events").withColumnRenamed("value", "delay"), 50.0).select("event_id")


@query("SELECT event_id FROM events WHERE epoch_ns(ts) > epoch_ns(TIMESTAMP '2024-01-15')")
def ttl_live(spark, folder):
    """A stored table of entries with their ends, which the scan prunes by."""
    rows = _t(spark, folder, "events").select("event_id", (calendar.utc_micros(F.col("ts")) * 1000).alias("exp"))
    return flows.live(stored(rows, "entries"), 1_705_276_800 * 10**9).select("event_id")


@query("SELECT event_type AS sql, count(*) AS n FROM events GROUP BY event_type")
def stream_statement_counts(spark, folder):
    """Counts over a stream of the table's file: each batch's go to a table, whose sums are the result."""
    schema = _t(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet*")
    path = fresh_path(spark, "stream")
    flows.consume(stream.withColumnRenamed("event_type", "sql"), flows.count_batches(f"{path}/counts"), f"{path}/checkpoint").awaitTermination()
    return flows.batch_counts(spark, f"{path}/counts")


from . import service_queries  # noqa: E402, F401  registers the others
