"""Registered queries: copy jobs and streams over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicework.operators.dedup import latest_per_key
from sluicework.plans import copyjob
from sluicework.plans.fixtures import change_feed, change_target, doubled_events, with_views
from sluicework.plans.registry import query, table
from sluicework.session import staging_path
from sluicework.sinks import upsert_table
from sluicework.sinks.files import write_raw
from sluicework.streaming import change_levels, filestream, stateful


@query("copy_job", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
def copy_job(spark, sf):
    out = staging_path(spark, "copy")
    copyjob.copy(
        spark, {"kind": "table", "path": f"{sf}/orders.parquet"}, {"kind": "table", "path": out},
        filter="o_totalprice > 250000 and o_orderstatus == 'F'",
        steps=[lambda df: df.select("o_orderkey", "o_totalprice")],
    )
    return spark.read.parquet(out)


@query("copy_csv_to_lines", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders")
def copy_csv_to_lines(spark, sf):
    base = staging_path(spark, "copy-csv")
    copyjob.copy(
        spark, {"kind": "table", "path": f"{sf}/orders.parquet"}, {"kind": "csv", "path": f"{base}/in"},
        steps=[lambda df: df.select("o_orderkey", "o_orderpriority")],
    )
    copyjob.copy(
        spark, {"kind": "csv", "path": f"{base}/in", "splittable": True}, {"kind": "raw", "path": f"{base}/out"}
    )
    return spark.read.schema("o_orderkey string, o_orderpriority string").json(f"{base}/out")


@query(
    "copy_upsert_twice",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderstatus
       FROM orders""",
)
def copy_upsert_twice(spark, sf):
    """All orders, then the finished ones at twice the price, then that batch again (a replay), into one keyed table."""
    base = staging_path(spark, "upsert")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    orders.write.parquet(f"{base}/first")
    orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2).write.parquet(f"{base}/second")
    sink = {"kind": "upsert", "path": f"{base}/table", "key": "o_orderkey", "buckets": 16}
    for part in ("first", "second", "second"):
        copyjob.copy(spark, {"kind": "table", "path": f"{base}/{part}"}, sink)
    return upsert_table.read_table(spark, f"{base}/table")


@query(
    "copy_fanout_switch",
    """SELECT 'big' AS branch, o_orderkey FROM orders WHERE o_totalprice > 250000
       UNION ALL SELECT 'finished', o_orderkey FROM orders WHERE NOT (o_totalprice > 250000) AND o_orderstatus = 'F'
       UNION ALL SELECT 'all', o_orderkey FROM orders""",
)
def copy_fanout_switch(spark, sf):
    """A switch without default and a branch of every row, written by one job of the copy."""
    out = staging_path(spark, "branches")
    sink = {"kind": "branches", "path": out, "when": [["o_totalprice > 250000", "big"], ["o_orderstatus == 'F'", "finished"]], "every": ["all"]}
    copyjob.copy(spark, {"kind": "table", "path": f"{sf}/orders.parquet"}, sink)
    lines = spark.read.text(out)
    return lines.select("branch", F.get_json_object("value", "$.o_orderkey").cast("bigint").alias("o_orderkey"))


@query("copy_in_ranges", "SELECT o_orderkey, o_totalprice FROM orders")
def copy_in_ranges(spark, sf):
    """A resumable copy written in cursor ranges of about 1,000 rows, the position stored after each."""
    base = staging_path(spark, "ranges")
    source = {"kind": "table", "path": f"{sf}/orders.parquet", "cursor_column": "o_orderkey", "cursor_id": "orders", "chunk_rows": 1000}
    copyjob.copy(spark, source, {"kind": "table", "path": f"{base}/out"}, resume=True, state_dir=f"{base}/state",
                 steps=[lambda df: df.select("o_orderkey", "o_totalprice")])
    return spark.read.parquet(f"{base}/out")


@query("copy_resumed", "SELECT o_orderkey, o_totalprice FROM orders")
def copy_resumed(spark, sf):
    """The table arrives in three parts; each run copies only what is new, a fourth copies nothing."""
    base = staging_path(spark, "resume")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    top = orders.agg(F.max("o_orderkey")).first()[0]
    source = {"kind": "table", "path": f"{base}/in", "cursor_column": "o_orderkey", "cursor_id": "orders"}
    cuts = [-1, top // 3, top // 2, top]
    for low, high in [*zip(cuts, cuts[1:]), (top, top)]:
        part = orders.where((F.col("o_orderkey") > low) & (F.col("o_orderkey") <= high))
        part.write.mode("append").parquet(f"{base}/in")
        copyjob.copy(spark, source, {"kind": "table", "path": f"{base}/out"}, resume=True, state_dir=f"{base}/state")
    return spark.read.parquet(f"{base}/out")


@query(
    "copy_route_from_data",
    "SELECT l_orderkey AS id, l_quantity AS qty FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40",
)
def copy_route_from_data(spark, sf):
    out = staging_path(spark, "route")
    copyjob.run_route(spark, {"returns": {
        "input": {"kind": "table", "path": f"{sf}/lineitem.parquet"},
        "filter": "l_returnflag == 'R' and l_quantity > 40",
        "middlewares": [{"mapping": {"id": "$.l_orderkey", "qty": "$.l_quantity"}}],
        "output": {"kind": "table", "path": out},
    }})
    return spark.read.parquet(out)


@query(
    "safe_position",
    """SELECT max(o_orderkey) AS position FROM orders WHERE o_orderkey <
       (SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 499000)""",
)
def safe_position(spark, sf):
    written = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") <= 499000).alias("ok"))
    return copyjob.safe_position(written, "o_orderkey", "ok")


@query(
    "cursor_check",
    """SELECT min(l_orderkey) AS first, max(l_orderkey) AS last, max(n) AS largest_group, min(l_orderkey) > 0 AS monotonic
       FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)""",
)
def cursor_check(spark, sf):
    return copyjob.check_cursor(table(spark, sf, "lineitem"), "l_orderkey", 0)


def _drained(sdf, name):
    base = staging_path(sdf.sparkSession, name)
    writer = sdf.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(f"{base}/out")


@query("stream_growing_file", "SELECT o_orderkey, o_totalprice FROM orders")
def stream_growing_file(spark, sf):
    """Files of lines read as byte ranges by a stream that stops when it has caught up."""
    base = staging_path(spark, "growing")
    write_raw(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), base)
    lines = _drained(filestream.stream_file(spark, base, range_bytes=256 << 10), "growing-out")
    row = F.from_json("payload", "o_orderkey bigint, o_totalprice double")
    return lines.select(row.alias("r")).select("r.*")


@query("stream_copy_drained", "SELECT event_id, event_type FROM events WHERE value > 10")
def stream_copy_drained(spark, sf):
    base = staging_path(spark, "stream-copy")
    write_raw(table(spark, sf, "events").select("event_id", "event_type", "value"), f"{base}/in")
    row = F.from_json("value", "event_id bigint, event_type string, value double").alias("r")
    for _ in range(2):  # the second run finds nothing new
        copyjob.copy(
            spark, {"kind": "folder", "path": f"{base}/in"}, {"kind": "table", "path": f"{base}/out"}, resume=True,
            steps=[lambda df: df.select(row).select("r.*").where("value > 10").select("event_id", "event_type")],
            state_dir=f"{base}/state",
        )
    return spark.read.parquet(f"{base}/out")


def _as_stream(df, name):
    """A written table as a stream of its files."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@query("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, sf):
    rows = doubled_events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    sdf = _as_stream(rows, "dedup-in")
    return _drained(stateful.dedup_stream(sdf, "event_id", "ts", "20 seconds").select("event_id"), "dedup-out")


@query("stream_correlate", "SELECT user_id, count(*) // 3 AS groups, (count(*) // 3) * 3 AS members FROM events GROUP BY user_id")
def stream_correlate(spark, sf):
    events = table(spark, sf, "events").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("doc")
    )
    groups = stateful.correlate_stream(_as_stream(events, "correlate-in"), "user_id", "ts", "doc", expected_count=3)
    return _drained(groups, "correlate-out").groupBy(F.col("key").alias("user_id")).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("members")
    )


@query(
    "stream_changes_applied",
    with_views("change_feed", "change_target") + """, newest AS (SELECT * FROM change_feed
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC, ordinal DESC) = 1)
    SELECT key, amount, lsn FROM newest WHERE op <> 'delete' UNION ALL
    SELECT key, amount, lsn FROM change_target WHERE key NOT IN (SELECT key FROM newest)""",
)
def stream_changes_applied(spark, sf):
    base = staging_path(spark, "changes")
    sdf = _as_stream(change_feed(spark, sf), "changes-in")
    stateful.apply_changes_stream(sdf, base, "key", f"{base}/checkpoint").awaitTermination()
    return stateful.read_applied(spark, base, change_target(spark, sf), "key").select("key", "amount", "lsn")


@query(
    "stream_changes_levelled",
    with_views("change_feed", "change_target") + """, newest AS (SELECT * FROM change_feed
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC, ordinal DESC) = 1)
    SELECT key, amount, lsn FROM newest WHERE op <> 'delete' UNION ALL
    SELECT key, amount, lsn FROM change_target WHERE key NOT IN (SELECT key FROM newest)""",
)
def stream_changes_levelled(spark, sf):
    """The feed in twelve files, one a micro-batch, into a levelled log of four runs a level."""
    base = staging_path(spark, "levels")
    feed = change_feed(spark, sf)
    feed.repartition(12).write.parquet(f"{base}/in")
    sdf = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    change_levels.apply_changes_levelled(sdf, f"{base}/log", "key", f"{base}/checkpoint", fanout=4).awaitTermination()
    return change_levels.read_levelled(spark, f"{base}/log", change_target(spark, sf), "key").select("key", "amount", "lsn")


@query("stream_start_latest", "SELECT event_id FROM events")
def stream_start_latest(spark, sf):
    """A tail that starts at the end of the backlog sees what is appended later, and only that."""
    base, out = staging_path(spark, "tail"), staging_path(spark, "tail-out")
    write_raw(table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id")), base)
    for appended in (False, True):
        if appended:
            write_raw(table(spark, sf, "events").select("event_id"), base)
        tail = filestream.stream_file(spark, base, start="latest").writeStream.format("parquet")
        tail.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    lines = spark.read.schema("payload string").parquet(f"{out}/rows")
    return lines.select(F.get_json_object("payload", "$.event_id").cast("bigint").alias("event_id"))


@query(
    "stream_last_per_subject",
    """SELECT user_id, event_id FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def stream_last_per_subject(spark, sf):
    """The newest row per subject of what a drained stream has landed."""
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    landed = _drained(_as_stream(events, "subjects-in"), "subjects-out")
    return latest_per_key(landed, "user_id", ["ts", "event_id"]).select("user_id", "event_id")
