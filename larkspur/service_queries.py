"""Registered queries of sources, services, envelopes, snapshots and streams, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from .engine import Context, Engine
from .functions import cache, codec, crypto, envelope, ids, sequence
from .operators import buckets, convert, dml, kv, monitor, sharding
from .operators.predicates import QueryError
from .plans import params as P
from .plans.ir import Field, RangeType, TimeRange, Update, Value
from .queries import _id_key, _kv, _t, query
from .sources import files, jdbc, sqlite
from .streaming import flows


def _local(path: str) -> str:
    """A path of the shared folder for a library that opens files itself."""
    if not path.startswith(("file:", "/")):
        raise ValueError("a SQLite file needs a folder that is mounted")
    return "/" + path.removeprefix("file:").lstrip("/")


# ---- sources


@query("SELECT * FROM (VALUES ('mysql', 'jdbc:mysql://h:3306/d?a=b', '15', 't'), ('postgresql', 'jdbc:postgresql://h:5432/d', '15', 't'), ('sqlite', 'jdbc:sqlite:/x.db', '4', 't')) v(kind, url, parts, dbtable)")
def jdbc_options(spark, folder):
    """What a read of each kind of store is given; more parts than the pool has connections are cut to it."""
    rows = []
    for kind, how, n in (("mysql", {"params": {"a": "b"}}, 99), ("postgresql", {"max_open": 3}, 20), ("sqlite", {"path": "/x.db"}, 4)):
        o = jdbc.options(jdbc.DbConfig(kind=kind, host="h", database="d", **how), table="t", partition_column="id", lower=0, upper=9, partitions=n)
        rows.append((kind, o["url"], o["numPartitions"], o["dbtable"]))
    return spark.createDataFrame(rows, "kind string, url string, parts string, dbtable string")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 7 THEN 'changed' ELSE n_name END AS n_name FROM nation WHERE n_nationkey >= 5 AND n_nationkey <> 9")
def sqlite_statements(spark, folder):
    """Rows put in by insert, upsert and update statements, then read with a pushed filter. The table has 25 rows."""
    path = _local(files.fresh_path(spark, "sqlite")) + "/x.db"
    sqlite.execute(path, "CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT)")
    for r in _t(spark, folder, "nation").select("n_nationkey", "n_name").collect():
        text, args = dml.statement("insert", "nation", {"n_nationkey": r[0], "n_name": "none" if r[0] == 7 else r[1]})
        assert sqlite.execute(path, text, args) == (r[0], 1)
    sqlite.execute(path, *dml.statement("upsert", "nation", {"n_nationkey": 7, "n_name": "upserted"}, keys=["n_nationkey"]))
    text, args = dml.statement("update", "nation", {"n_name": "changed"}, plain_names=True)
    dml.check_rows(sqlite.execute(path, f"{text} WHERE n_nationkey = ?", [*args, 7])[1], 1)
    return sqlite.read(spark, path, "nation", 3).where("n_nationkey >= 5 and n_nationkey <> 9")


@query("SELECT true AS found, c_name, c_acctbal FROM customer WHERE c_custkey = 12 UNION ALL SELECT false, NULL, NULL")
def sql_first_row(spark, folder):
    """One row of raw SQL, and the answer where there is none."""
    name = f"larkspur_{uuid.uuid4().hex}"
    engine = Engine(spark).register(**{name: _t(spark, folder, "customer")})
    rows = [engine.one(f"SELECT c_name, c_acctbal FROM {name} WHERE c_custkey = ?", [k]) for k in (12, -1)]
    spark.catalog.dropTempView(name)
    return spark.createDataFrame([(found, *(row or (None, None))) for found, row in rows], "found boolean, c_name string, c_acctbal double")


@query("SELECT 'one' || chr(10) || 'two' || chr(10) AS text, true AS there, false AS other")
def text_file(spark, folder):
    """A whole file, and whether files are there."""
    path = files.fresh_path(spark, "text")
    spark.createDataFrame([("one\ntwo",)], "value string").coalesce(1).write.text(f"{path}/a")
    return spark.createDataFrame([(files.read_all_text(spark, f"{path}/a"), files.exists(spark, f"{path}/a"), files.exists(spark, f"{path}/b"))], "text string, there boolean, other boolean")


@query("SELECT * FROM (VALUES ('p', CAST(167772160 AS BIGINT), CAST(167772169 AS BIGINT)), ('p', 167837696, 167837701), ('q', 3232235520, 3232235775)) v(province, low, high)")
def ip_range_file(spark, folder):
    """Ranges of a JSON lines file as numbers."""
    path = files.fresh_path(spark, "ranges") + "/r"
    rows = [("p", [("10.0.0.0", "10.0.0.9"), ("10.1.0.0", "10.1.0.5")]), ("q", [("192.168.0.0", "192.168.0.255")])]
    spark.createDataFrame(rows, "province string, ranges array<struct<min:string,max:string>>").write.json(path)
    flat = files.ip_ranges(spark, path).select("province", F.explode("ranges").alias("r"))
    return flat.select("province", ids.ip_encode(F.col("r.min")).alias("low"), ids.ip_encode(F.col("r.max")).alias("high"))


# ---- key-value services


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 10 THEN 'new' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey <> 20 AND o_orderkey < 100")
def kv_put_get(spark, folder):
    """Rows set and deleted by key."""
    t = _kv(spark, folder).where("o_orderkey < 100").select("key", "value")
    fresh = _kv(spark, folder).where("o_orderkey < 10").select("key", F.lit("new").cast("binary").alias("value"))
    t = kv.delete(kv.put(t, fresh), _id_key(20))
    return t.select(kv.id_of_key("o", F.col("key")).alias("o_orderkey"), F.decode("value", "UTF-8").alias("v"))


@query("SELECT 'new' AS a, NULL AS b")
def kv_get(spark, folder):
    t = kv.put(_kv(spark, folder).select("key", "value"), _kv(spark, folder).where("o_orderkey = 3").select("key", F.lit("new").cast("binary").alias("value")))
    texts = [v and v.decode() for v in (kv.get(t, _id_key(3)), kv.get(t, b"none"))]
    return spark.createDataFrame([tuple(texts)], "a string, b string")


@query("SELECT o_orderkey, lpad(to_hex(o_custkey), 16, '0') AS stored, o_custkey AS back, upper(hex(encode('o' || chr(9) || chr(9) || chr(9) || o_orderstatus || chr(9) || chr(9) || chr(9) || o_orderkey))) AS key FROM orders")
def kv_typed(spark, folder):
    """Values through a coder, and keys of several parts."""
    key = kv.storage_key(F.lit("o"), F.col("o_orderstatus"), F.col("o_orderkey").cast("string"))
    t = kv.encoded(_t(spark, folder, "orders").select("o_orderkey", key.alias("key"), F.col("o_custkey").alias("value")), codec.INT64)
    back = kv.decoded(t.withColumn("stored", F.hex("value")), codec.INT64)
    return back.select("o_orderkey", "stored", F.col("value").alias("back"), F.hex("key").alias("key"))


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS call, o_orderkey FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 7")
def kv_each(spark, folder):
    """A handler that is called in key order until it has had enough."""
    seen: list[int] = []
    calls = kv.each(kv.scan(_kv(spark, folder).select("key", "value"), _id_key(100), most=50), lambda k, v: seen.append(int.from_bytes(k[-8:], "big")) or len(seen) < 7)
    assert calls == 7
    return spark.createDataFrame(list(enumerate(seen, 1)), "call long, o_orderkey long")


@query("SELECT 'live' AS a, NULL AS expired, NULL AS driven_out, 'kept' AS used, CAST(3 AS BIGINT) AS held")
def cache_bounded(spark, folder):
    """A cache with room for three entries and a clock of its own."""
    now = [0.0]
    c = cache.SizedCache(30, clock=lambda: now[0], share=3)
    c.set(b"e", b"short", 5)
    now[0] = 6
    expired = c.get(b"e")
    c.set(b"b", b"12345678")
    c.set(b"u", b"kept")
    c.set(b"a", b"live", 60)
    c.get(b"u")
    c.set(b"n", b"12345678")
    c.set(b"m", b"12345678")
    c.delete(b"n")
    text = lambda v: v and v.decode()
    return spark.createDataFrame([(text(c.get(b"a")), text(expired), text(c.get(b"b")), text(c.get(b"u")), len(c.held))], "a string, expired string, driven_out string, used string, held long")


# ---- functions


@query("SELECT o_orderkey, array_to_string(list_filter([o_orderkey, o_custkey], lambda x: x <> 0), ',') AS ids, array_to_string([o_orderkey, CAST(0 AS BIGINT), o_custkey], ',') AS all_ids FROM orders")
def hex_ids_decode(spark, folder):
    texts = F.array(ids.hex_encode(F.col("o_orderkey")), F.lit("none"), ids.hex_encode(F.col("o_custkey")))
    return _t(spark, folder, "orders").select("o_orderkey", *[F.array_join(ids.hex_decode_all(texts, z), ",").alias(n) for n, z in (("ids", True), ("all_ids", False))])


@query("SELECT c_custkey, '0A' || printf('%02X', strlen(c_name)) || hex(encode(c_name)) AS wire, c_name AS back FROM customer")
def protobuf_wire(spark, folder):
    """One text field, length below 128: tag, length and bytes."""
    from google.protobuf.wrappers_pb2 import StringValue

    c = codec.protobuf(StringValue, "value string")
    rows = _t(spark, folder, "customer").select("c_custkey", c.encode(F.struct(F.col("c_name").alias("value"))).alias("w"))
    return rows.select("c_custkey", F.hex("w").alias("wire"), c.decode(F.col("w"))["value"].alias("back"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type || ',' || props END AS datas FROM events")
def cache_envelope_repeated(spark, folder):
    cell = F.struct(F.array(F.encode("event_type", "UTF-8"), F.encode("props", "UTF-8")).alias("datas"), F.when(F.col("event_id") % 3 == 0, 9).otherwise(10).cast("long").alias("exp"))
    rows = _t(spark, folder, "events").select("event_id", codec.live_all(cell, 10).alias("d"))
    return rows.select("event_id", F.array_join(F.transform("d", lambda b: F.decode(b, "UTF-8")), ",").alias("datas"))


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 2 THEN 404 ELSE 200 END AS code, n_nationkey % 4 < 1 AS success, CASE WHEN n_nationkey % 4 < 1 THEN n_name END AS data,
 CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'the result could not be encoded' WHEN 2 THEN 'no ' || n_name ELSE 'the system is busy, try again later' END AS message, CAST(n_nationkey AS BIGINT) AS request_id FROM nation
""")
def response_envelope(spark, folder):
    """A success, a result that has no bytes, an error, and an error of the system."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    good = envelope.success(F.when(k % 4 == 0, name), codec.STRING, 200, k)
    bad = envelope.failure(F.concat(F.lit("no "), name), F.when(k % 4 == 2, 404).otherwise(200), k, k % 4 == 3)
    rows = _t(spark, folder, "nation").select("n_nationkey", F.when(k % 4 < 2, good).otherwise(bad).alias("r"))
    return rows.select("n_nationkey", F.col("r.code").cast("int").alias("code"), "r.success", codec.STRING.decode(F.col("r.payload")).alias("data"), "r.message", "r.request_id")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'bad ' || n_nationkey END AS error, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS data FROM nation")
def payload_response(spark, folder):
    """The error of an answer, or else its payload."""
    k = F.col("n_nationkey")
    answer = F.struct(F.when(k % 2 == 0, envelope.error(F.concat(F.lit("bad "), k.cast("string")))).alias("err"), codec.STRING.encode(F.col("n_name")).alias("payload"))
    got = envelope.payload_of(answer, codec.STRING)
    return _t(spark, folder, "nation").select("n_nationkey", got.alias("g")).select("n_nationkey", F.col("g.error.message").alias("error"), "g.data")


@query("SELECT CAST(3000 AS BIGINT) AS n, CAST(3000 AS BIGINT) AS ids, true AS ascending, true AS parts, CAST(2 AS BIGINT) AS refused")
def sequence_service(spark, folder):
    """One node's service: three milliseconds' ids from a clock that stands still, and places that are refused."""
    g = sequence.Generator(1, 2, clock=lambda: 1_704_067_200_000)
    made = [g.next_id() for _ in range(3000)]
    refused = 0
    for dc, node in ((8, 0), (0, 32)):
        try:
            sequence.Generator(dc, node)
        except ValueError:
            refused += 1
    parts = all((p["dcID"], p["nodeID"], p["index"]) == (1, 2, i % 1024) for i, p in enumerate(map(sequence.parse_id, made)))
    return spark.createDataFrame([(len(made), len(set(made)), made == sorted(made), parts, refused)], "n long, ids long, ascending boolean, parts boolean, refused long")


@query("SELECT * FROM (VALUES (lower(to_hex(68101143464510746)), '68101143464510746'), ('123', '123'), ('68101143464510746', '68101143464510746'), ('zz', '0'), ('', '0')) v(text, id)")
def id_convert(spark, folder):
    """Ids that may be hexadecimal: taken as such where that gives a time near now."""
    texts = [format(68101143464510746, "x"), "123", "68101143464510746", "zz", ""]
    return spark.createDataFrame([(t, P.id_text(t, 1_704_067_200_000)) for t in texts], "text string, id string")


@query("SELECT c_custkey, md5(md5(c_name)) AS h, CAST(CASE WHEN n >= 9223372036854775808 THEN n - 18446744073709551616 ELSE n END AS BIGINT) AS n FROM (SELECT c_custkey, c_name, CAST(('0x' || right(md5(md5(c_name)), 16)) AS UBIGINT)::HUGEINT AS n FROM customer)")
def hash_registered(spark, folder):
    """A hash that the user adds."""
    crypto.register_hash("md5md5", lambda c: F.md5(F.md5(c)))
    return _t(spark, folder, "customer").select("c_custkey", crypto.hash_hex("md5md5", F.col("c_name")).alias("h"), crypto.hash_long("md5md5", F.col("c_name")).alias("n"))


@query("SELECT * FROM (VALUES ('HOUR', CAST(3 AS BIGINT), CAST(1704863000000000000 AS BIGINT), CAST(1704870000000000000 AS BIGINT)), ('DAY', 3, 1704863000000000000, 1704988800000000000), ('WEEK', 3, 1704863000000000000, 1705766400000000000), ('MONTH', 2, 1704863000000000000, 1706716800000000000), ('YEAR', 2, 1704863000000000000, 1735660800000000000)) v(kind, n, first, last)")
def bucket_boundaries_all(spark, folder):
    """Of a range of each kind: how many points, the first and the last."""
    start, hour = 1_704_863_000 * 10**9, 3600 * 10**9
    ends = {"HOUR": 1.5 * hour, "DAY": 26 * hour, "WEEK": 200 * hour, "MONTH": 40 * hour, "YEAR": 40 * hour}
    rows = []
    for kind, size in ends.items():
        points = buckets.boundaries(TimeRange(RangeType[kind], start, start + int(size)))
        rows.append((kind, len(points), points[0], points[-1]))
    return spark.createDataFrame(rows, "kind string, n long, first long, last long")


@query("SELECT * FROM (VALUES ('ALL', true), ('DAY', false)) v(kind, refused)")
def bucket_refused(spark, folder):
    """A kind that is no bucket is an error."""
    rows = []
    for kind in (RangeType.ALL, RangeType.DAY):
        try:
            buckets.bucket(F.col("ts"), kind)
            rows.append((kind.name, False))
        except QueryError:
            rows.append((kind.name, True))
    return spark.createDataFrame(rows, "kind string, refused boolean")


# ---- parameters and requests


@query("SELECT CAST(7 AS BIGINT) AS i, CAST(0 AS BIGINT) AS bad, CAST(9223372036854775807 AS BIGINT) AS over, true AS yes, false AS no, CAST(1704067200 AS BIGINT) AS at, true AS none, '1.2.3.4' AS ip, '9.9.9.9' AS peer")
def request_facts(spark, folder):
    """Getters of a request's parameters and its remote address."""
    p = P.params_of("/x?i=7&bad=x&over=99999999999999999999&yes=1&no=on&at=2024-01-01%2000:00:00")
    at = P.time_param(p, "at")
    row = (P.int_param(p, "i"), P.int_param(p, "bad"), P.int_param(p, "over"), P.bool_param(p, "yes"), P.bool_param(p, "no"), int(at.timestamp()), P.time_param(p, "none") is None)
    row += (P.remote_ip({"X-Forwarded-For": "1.2.3.4, 5.6.7.8"}, "9.9.9.9"), P.remote_ip({}, "9.9.9.9"))
    return spark.createDataFrame([row], "i long, bad long, over long, yes boolean, no boolean, at long, none boolean, ip string, peer string")


@query("SELECT CAST(5 AS BIGINT) AS i, CAST(0 AS BIGINT) AS wide, CAST(0 AS BIGINT) AS minus, CAST(4294967295 AS BIGINT) AS u, CAST(0.5 AS DOUBLE) AS f, 'x' AS s, '' AS no_s, true AS b, CAST(0 AS BIGINT) AS at, true AS no_pointer")
def context_values(spark, folder):
    """Typed values of a context; another type gives zero."""
    c = Context({"i": 5, "wide": 2**40, "minus": -1, "u": 2**32 - 1, "f": 0.5, "s": "x", "b": True, "t": datetime(2024, 1, 1, tzinfo=timezone.utc)})
    row = (c.int32("i"), c.int32("wide"), c.uint64("minus"), c.uint32("u"), c.float32("f"), c.string("s"), c.string("i"), c.bool("b"), int(c.time("s").timestamp()), c.whole("s", "int64") is None)
    return spark.createDataFrame([row], "i long, wide long, minus long, u long, f double, s string, no_s string, b boolean, at long, no_pointer boolean")


# ---- changes


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'three' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 99, 'new'")
def snapshot_transaction(spark, folder):
    """Several changes published together; one that fails publishes nothing."""
    s = dml.Snapshots(spark, files.fresh_path(spark, "snapshots") + "/nation")
    s.write(_t(spark, folder, "nation").select("n_nationkey", "n_name"))
    with s.transaction():
        s.write(dml.apply_update(s.read(), Update(3, (Field("n_name", Value.string("three")),)), ["n_name"], "n_nationkey"))
        s.write(dml.delete_by_id(s.read(), 4, "n_nationkey"))
        with s.transaction():
            s.write(dml.insert(s.read(), spark.createDataFrame([(99, "new")], "n_nationkey int, n_name string")))
    try:
        with s.transaction():
            s.write(s.read().limit(0))
            dml.check_rows(0, 1)
    except QueryError:
        pass
    assert s.number() == 2
    return s.read()


@query("SELECT CAST(count(*) AS BIGINT) AS hit, CAST(0 AS BIGINT) AS guarded, CAST(0 AS BIGINT) AS nothing FROM customer WHERE c_custkey = 7")
def update_affected(spark, folder):
    """How many rows an update changes: by id, with a condition that fails, without accepted fields."""
    from .plans.ir import Condition

    t = _t(spark, folder, "customer")
    name = Field("c_name", Value.string("x"))
    hit = dml.affected(t, Update(7, (name,)), ["c_name"], "c_custkey")
    guarded = dml.affected(t, Update(7, (name,), (Condition("c_mktsegment", "=", Value.string("NONE")),)), ["c_name"], "c_custkey")
    return spark.createDataFrame([(hit, guarded, dml.affected(t, Update(7, (name,)), [], "c_custkey"))], "hit long, guarded long, nothing long")


@query("SELECT s_suppkey, 'all' AS s_name, CAST(0.5 AS DOUBLE) AS s_acctbal FROM supplier")
def update_all(spark, folder):
    return dml.set_columns(_t(spark, folder, "supplier"), {"s_name": "all", "s_acctbal": 0.5}).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '!' ELSE s_name END AS s_name, s_acctbal FROM supplier")
def update_by_keys(spark, folder):
    """An update statement on a frame: rows with the keys take the new columns."""
    t = _t(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return dml.changed(t, "update", t.where("s_suppkey % 2 = 0").select("s_suppkey", F.concat("s_name", F.lit("!")).alias("s_name")), ["s_suppkey"])


@query("""
SELECT * FROM (VALUES ('insert', 'INSERT INTO `t` (`a`, `b`) VALUES (?, ?)', '[1, 2]'), ('update', 'UPDATE `t` SET `a` = ?, `b` = ?', '[1, 2]'),
 ('upsert', 'INSERT INTO `t` (`a`, `b`) VALUES (?, ?) ON DUPLICATE KEY UPDATE `a` = ?, `b` = ?', '[1, 2, 1, 2]'), ('conflict', 'INSERT INTO t (a, b) VALUES (?, ?) ON CONFLICT (a) DO UPDATE SET b = excluded.b', '[1, 2]'), ('other', 'unknown', '[]')) v(kind, text, args)
""".replace("`t`", "t"))
def statement_texts(spark, folder):
    """Texts and arguments of each kind of statement; another kind is an error."""
    values, rows = {"b": 2, "a": 1}, []
    for kind in ("insert", "update", "upsert"):
        text, args = dml.statement(kind, "t", values)
        rows.append((kind, text, str(args)))
    text, args = dml.statement("upsert", "t", values, plain_names=True, keys=["a"])
    rows.append(("conflict", text, str(args)))
    try:
        dml.statement("merge", "t", values)
    except QueryError:
        rows.append(("other", "unknown", "[]"))
    return spark.createDataFrame(rows, "kind string, text string, args string")


@query("SELECT 'b,d,e' AS kept, 'a,b,c,d,e' AS given, true AS refused")
def set_values(spark, folder):
    """Which values are put in with and without empty ones, and a count that is not what was expected."""
    some, every = {}, {}
    for k, v in {"a": "", "b": "x", "c": 0, "d": 0.0, "e": False, "f": None}.items():
        dml.set_value(some, k, v, True)
        dml.set_value(every, k, v, False)
    try:
        dml.check_rows(2, 1)
        refused = False
    except QueryError:
        refused = True
    return spark.createDataFrame([(",".join(sorted(some)), ",".join(sorted(every)), refused)], "kept string, given string, refused boolean")


@query("SELECT '_' || (o_orderkey % 4) AS shard, count(*) AS n FROM orders WHERE o_orderkey % 4 IN (1, 2) GROUP BY 1 UNION ALL SELECT '', count(*) FROM orders WHERE o_orderkey > 0")
def shard_statements(spark, folder):
    """A statement sent to shards by its table's name, and to the table that is not sharded."""
    table, orders = f"larkspur_{uuid.uuid4().hex}", _t(spark, folder, "orders")
    sharding.shard_views(orders, table, F.col("o_orderkey"), sharding.mod_suffix(4), ["_1", "_2"])
    sharding.shard_views(orders, table, F.col("o_orderkey"), sharding.no_suffix(), [""])
    out = None
    for s in ("_1", "_2", ""):
        one = spark.sql(sharding.sharded_sql(f"SELECT '{s}' AS shard, count(*) AS n FROM {table} WHERE o_orderkey > 0", table, s))
        out = one if out is None else out.union(one)
    for s in ("_1", "_2", ""):
        spark.catalog.dropTempView(sharding.table_name(table, s))
    return out


@query("SELECT 'A,B,D' AS names, 'haha' AS \"A\", true AS \"B\", CAST(987 AS BIGINT) AS \"D\"")
def row_params(spark, folder):
    """A nullable row as named parameters, without nulls."""
    row = spark.createDataFrame([("haha", True, None, 987)], "A string, B boolean, C timestamp, D long").first()
    p = convert.params_of(row)
    return spark.createDataFrame([(",".join(sorted(p)), p["A"], p["B"], p["D"])], "names string, A string, B boolean, D long")


@query("""
SELECT * FROM (VALUES ('haha', true, CAST(1596527130129078 AS BIGINT), CAST(987 AS BIGINT), 75, CAST(0.123456 AS DOUBLE), 'haha', true, CAST(1596527130129078000 AS BIGINT)),
 (NULL, NULL, NULL, NULL, NULL, NULL, '', false, 0)) v("A", "B", "C", "D", "E", "F", "a2", "b2", "c2")
""")
def nullable_rows(spark, folder):
    """A full row and one of nulls, as they are and as transfer objects."""
    at = datetime.fromtimestamp(1_596_527_130, timezone.utc).replace(microsecond=129_078)
    t = spark.createDataFrame([("haha", True, at, 987, 75, 0.123456), (None,) * 6], "A string, B boolean, C timestamp, D long, E int, F double")
    dto = convert.to_transfer(t.select("A", "B", "C").withColumns({"a2": F.col("A"), "b2": F.col("B"), "c2": F.col("C"), "D": F.lit(0), "E": F.lit(0), "F": F.lit(0.0)}).select("a2", "b2", "c2"), times=("c2",))
    both = t.select("A", "B", F.unix_micros("C").alias("C"), "D", "E", "F", F.coalesce("A", F.lit("")).alias("join_a")).join(dto, F.col("join_a") == F.col("a2"))
    return both.drop("join_a")


# ---- monitors and streams


@query("SELECT * FROM (VALUES ('a', CAST(2 AS BIGINT)), ('b', 1)) v(sql, n)")
def sql_monitored(spark, folder):
    """What an engine's monitors have counted and heard."""
    heard, m, c = [], monitor.Monitors(), monitor.CountMonitor(room=2)
    m.add("count", c)
    m.add("list", heard.append)
    for text in ("a", "b", "a"):
        m.tell(monitor.Record("query", text, 0.1))
    assert len(heard) == 3 and [r.sql for r in c.recent] == ["b", "a"]
    return spark.createDataFrame(sorted(c.counts.items()), "sql string, n long")


@query("SELECT n_nationkey, n_name AS message FROM nation")
def queue_messages(spark, folder):
    """Messages put in a durable queue by two commits and taken out by two runs of a consumer."""
    path = files.fresh_path(spark, "queue")
    t = _t(spark, folder, "nation").select("n_nationkey", "n_name")
    message = F.encode(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name"), "UTF-8").alias("message")

    def handle(batch, number):
        batch.select("message").write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    for part in ("n_nationkey < 10", "n_nationkey >= 10"):
        flows.put(t.where(part).select(message), f"{path}/queue")
        flows.consume(flows.queue(spark, f"{path}/queue"), handle, f"{path}/checkpoint").awaitTermination()
    cells = F.split(F.decode("message", "UTF-8"), "\t")
    return spark.read.schema("message binary, batch long").parquet(f"{path}/out").select(cells[0].cast("int").alias("n_nationkey"), cells[1].alias("message"))


@query("SELECT event_type AS sql, count(*) AS n FROM events GROUP BY event_type")
def scheduled_counts(spark, folder):
    """A stream on a schedule, stopped once it has read what is there."""
    schema, path = _t(spark, folder, "events").schema, files.fresh_path(spark, "schedule")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet*").withColumnRenamed("event_type", "sql")
    q = flows.every(stream, 0.2, flows.count_batches(f"{path}/counts"), f"{path}/checkpoint")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return flows.batch_counts(spark, f"{path}/counts")


