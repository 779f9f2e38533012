"""Registered queries: sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicework.plans.fixtures import change_feed, all_customers, event_envelopes, with_views
from sluicework.plans.registry import query, table
from sluicework.session import staging_path
from sluicework.sinks.files import write_csv, write_envelope, write_raw
from sluicework.sources import files, generators, tables

EVENT_JSON = "event_id bigint, user_id bigint, event_type string, value double"


@query("scan_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5, lang, source FROM documents")
def scan_csv(spark, sf):
    path = staging_path(spark, "csv")
    write_csv(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), path)
    return files.read_csv(spark, path).select("doc_id", F.md5("text").alias("text_md5"), "lang", "source")


@query("scan_raw_lines", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def scan_raw_lines(spark, sf):
    path = staging_path(spark, "raw")
    write_raw(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path)
    row = F.from_json("payload", "o_orderkey bigint, o_orderpriority string, o_totalprice double")
    return files.read_raw(spark, path).select(row.alias("r")).select("r.*")


_ENVELOPE_SQL = """
SELECT CAST(event_id AS VARCHAR) AS message_id, event_id, user_id, event_type, value,
       event_type AS kind, CAST(event_id % 7 AS VARCHAR) AS retry_count FROM events"""


def _open_envelopes(df):
    return df.select(
        "message_id", F.from_json(F.col("payload").cast("string"), EVENT_JSON).alias("p"),
        F.col("metadata")["kind"].alias("kind"), F.col("metadata")["retry_count"].alias("retry_count"),
    ).select("message_id", "p.*", "kind", "retry_count")


def _envelope_round_trip(encoding):
    def run(spark, sf):
        path = staging_path(spark, f"envelope-{encoding}")
        write_envelope(event_envelopes(spark, sf), path, encoding)
        return _open_envelopes(files.read_envelope(spark, path, encoding))

    return run


for _encoding in ("json", "normal", "text"):
    query(f"scan_envelope_{_encoding}", _ENVELOPE_SQL)(_envelope_round_trip(_encoding))


@query("scan_table", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_table(spark, sf):
    return tables.read_table(spark, f"{sf}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query(
    "scan_custom_select",
    "SELECT o_orderkey, upper(o_orderpriority) AS priority, o_totalprice * 2 AS doubled FROM orders WHERE o_orderstatus = 'F'",
)
def scan_custom_select(spark, sf):
    return tables.read_query(
        spark,
        "SELECT o_orderkey, upper(o_orderpriority) AS priority, o_totalprice * 2 AS doubled "
        "FROM {orders} WHERE o_orderstatus = 'F'",
        orders=table(spark, sf, "orders"),
    )


@query(
    "scan_native_predicate",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_returnflag IN ('A', 'R')",
)
def scan_native_predicate(spark, sf):
    return tables.read_table(
        spark, f"{sf}/lineitem.parquet", "l_quantity >= 30 and l_returnflag in ['A','R']"
    ).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "scan_incremental",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) // 2 FROM orders)",
)
def scan_incremental(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    last = orders.agg(F.max("o_orderkey")).first()[0] // 2
    return tables.read_incremental(orders, "o_orderkey", last)


@query(
    "scan_objects_after_key",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE substr(o_orderpriority, 1, 1) > '2'",
)
def scan_objects_after_key(spark, sf):
    path = staging_path(spark, "objects")
    table(spark, sf, "orders").select(
        F.to_json(F.struct("o_orderkey", "o_totalprice")).alias("value"),
        F.substring("o_orderpriority", 1, 1).alias("p"),
    ).write.partitionBy("p").text(path)
    last = spark.read.text(f"{path}/p=2").select(F.max("_metadata.file_path")).first()[0]
    row = F.from_json("payload", "o_orderkey bigint, o_totalprice double")
    return files.read_objects(spark, path, last).select(row.alias("r")).select("r.*")


@query("start_all", "SELECT event_id, event_type FROM events")
def start_all(spark, sf):
    return tables.start_position(table(spark, sf, "events").select("event_id", "event_type"), "all", [])


@query(
    "start_new",
    "SELECT event_id, event_type FROM events WHERE ts > (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)",
)
def start_new(spark, sf):
    events = table(spark, sf, "events")
    middle = events.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("m")).scalar()
    return tables.start_position(events, "new", [], since=F.col("ts") > middle).select("event_id", "event_type")


@query("start_last", "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def start_last(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value", "ts")
    return tables.start_position(events, "last", ["ts", "event_id"]).drop("ts")


@query(
    "start_last_per_subject",
    """SELECT event_id, event_type, user_id, value FROM events
       QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def start_last_per_subject(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", "event_type", "user_id", "value", "ts",
        F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("subject"),
    )
    return tables.start_position(events, "last_per_subject", ["ts", "event_id"], "subject").drop("ts", "subject")


@query("scan_changes", with_views("change_feed") + "SELECT op, key, amount, lsn, ordinal FROM change_feed")
def scan_changes(spark, sf):
    raw = change_feed(spark, sf).withColumn("operation", F.upper("op")).drop("op")
    return tables.read_changes(raw, "operation", "lsn", "ordinal").select("op", "key", "amount", "lsn", "ordinal")


_SNAPSHOT_SQL = (
    with_views("change_feed", "all_customers")
    + """, snapshot AS (SELECT 'insert' AS op, key, amount, CAST(0 AS BIGINT) AS lsn, CAST(0 AS BIGINT) AS ordinal FROM all_customers),
    both_parts AS (SELECT * FROM snapshot UNION ALL SELECT op, key, amount, lsn, ordinal FROM change_feed) """
)


@query("capture_all", _SNAPSHOT_SQL + "SELECT op, key, amount, lsn, ordinal FROM both_parts")
def capture_all(spark, sf):
    snapshot = all_customers(spark, sf).select("key", "amount")
    return tables.capture("capture_all", snapshot, change_feed(spark, sf)).select("op", "key", "amount", "lsn", "ordinal")


@query("capture_snapshot", with_views("all_customers") + "SELECT key, amount FROM all_customers")
def capture_snapshot(spark, sf):
    return tables.capture("snapshot", all_customers(spark, sf), change_feed(spark, sf)).select("key", "amount")


@query(
    "capture_new",
    with_views("change_feed", "all_customers")
    + "SELECT op, key, lsn FROM change_feed WHERE lsn > (SELECT max(lsn) FROM all_customers)",
)
def capture_new(spark, sf):
    target = all_customers(spark, sf)
    since = target.agg(F.max("lsn")).first()[0]
    return tables.capture("capture_new", target, change_feed(spark, sf), since).select("op", "key", "lsn")


@query(
    "static_rows",
    """SELECT CAST(i AS VARCHAR) AS message_id, 'ping' AS payload, 'static' AS origin
       FROM range((SELECT count(*) FROM orders)) t(i)""",
)
def static_rows(spark, sf):
    n = table(spark, sf, "orders").count()
    return generators.static_rows(spark, "ping", n, {"origin": "static"}).select(
        "message_id", "payload", F.col("metadata")["origin"].alias("origin")
    )


@query(
    "bench_rows",
    """WITH ids AS (SELECT i AS id FROM range(1, (SELECT count(*) FROM orders) + 1) t(i)),
       draws AS (SELECT id,
         ('0x' || substr(md5('42:first_name:' || id), 1, 8))::BIGINT % 16 AS d_name,
         ('0x' || substr(md5('42:country:' || id), 1, 8))::BIGINT % 10 AS d_country,
         ('0x' || substr(md5('42:amount:' || id), 1, 8))::BIGINT % 999901 AS d_amount,
         ('0x' || substr(md5('42:second:' || id), 1, 8))::BIGINT % 45 AS d_second,
         ('0x' || substr(md5('42:active:' || id), 1, 8))::BIGINT % 2 AS d_active,
         ('0x' || substr(md5('42:tier:' || id), 1, 8))::BIGINT % 3 AS d_tier,
         ('0x' || substr(md5('42:score:' || id), 1, 8))::BIGINT % 100001 AS d_score,
         ('0x' || substr(md5('42:tag:' || id), 1, 8))::BIGINT % 3 AS d_tag,
         ('0x' || substr(md5('42:tags:' || id), 1, 8))::BIGINT % 3 AS d_tags FROM ids)
       SELECT id,
         printf('person%02d', d_name) AS first_name,
         'C' || d_country AS country,
         round((d_amount + 100) / 100.0, 2)::DOUBLE AS amount,
         strftime(make_timestamp((1577836800 + id * 45 + d_second) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created_at,
         CASE WHEN d_active = 1 THEN 'true' ELSE 'false' END AS active,
         (['basic','plus','team'])[d_tier + 1] AS tier,
         (d_score / 1000.0)::DOUBLE AS score,
         array_to_string(list_slice(['tag0','tag1','tag2','tag3','tag4'], d_tag + 1, d_tag + 1 + d_tags), ',') AS tags
       FROM draws""",
)
def bench_rows(spark, sf):
    rows = generators.bench_rows(spark, table(spark, sf, "orders").count())
    inner = F.from_json("attributes", "tier string, score double, tags array<string>")
    return rows.withColumn("a", inner).select(
        "id", "first_name", "country", "amount", "created_at", "active",
        "a.tier", "a.score", F.array_join("a.tags", ",").alias("tags"),
    )


@query("memory_table", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def memory_table(spark, sf):
    named = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    generators.memory_sink(named.select("n_nationkey", "n_name", "r_name"), "named_nations")
    return generators.memory_source(spark, "named_nations")


@query("source_position", "SELECT event_id, 'events.parquet' AS src_file FROM events")
def source_position(spark, sf):
    placed = files.with_source_position(table(spark, sf, "events"))
    return placed.select("event_id", F.col("metadata")["src.file"].alias("src_file"))


_TOPICS = "SELECT event_id, concat_ws('/', 'sensors', event_type, CAST(user_id AS VARCHAR)) AS topic FROM events"


def _topics(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.concat_ws("/", F.lit("sensors"), "event_type", F.col("user_id").cast("string")).alias("topic")
    )


@query("topic_one_level", f"SELECT * FROM ({_TOPICS}) WHERE regexp_full_match(topic, 'sensors/[^/]+/42')")
def topic_one_level(spark, sf):
    return generators.where_topic(_topics(spark, sf), "topic", "sensors/+/42")


@query("topic_all_below", f"SELECT * FROM ({_TOPICS}) WHERE topic LIKE 'sensors/click/%'")
def topic_all_below(spark, sf):
    return generators.where_topic(_topics(spark, sf), "topic", "sensors/click/#")
