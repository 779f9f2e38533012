"""Registered queries: deduplication, correlation, upserts and change feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicework.functions.envelopes import strip_reserved
from sluicework.operators import correlate as joins
from sluicework.operators import dedup, upsert
from sluicework.plans.fixtures import (
    SQL, change_feed, change_target, doubled_events, event_envelopes, with_views,
)
from sluicework.plans.registry import query, table


def walk_sql(source: str, key: str, span: str | None = None, max_rows: int | None = None, required=()) -> str:
    """SQL twin of the greedy runs: a recursive walk over each key's ordered rows."""

    def closed(row: str) -> str:
        tests = [f"{row}.n >= {max_rows}"] if max_rows else []
        if required:
            tests.append("(" + " AND ".join(f"{row}.h{i}" for i in range(len(required))) + ")")
        return "(" + (" OR ".join(tests) or "false") + ")"

    fresh = closed("w") + (f" OR b.ts >= w.start_ts + INTERVAL {span}" if span else "")
    first = "".join(f", event_type = '{r}' AS h{i}" for i, r in enumerate(required))
    carry = "".join(
        f", CASE WHEN {fresh} THEN b.event_type = '{r}' ELSE w.h{i} OR b.event_type = '{r}' END"
        for i, r in enumerate(required)
    )
    same = " AND ".join(f"b.{k} = w.{k}" for k in key.split(", "))
    keys = ", ".join(f"b.{k}" for k in key.split(", "))
    return f"""WITH RECURSIVE {source},
      base AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts, tie) AS rn FROM src),
      walk AS (
        SELECT {key}, rn, tie, ts, tie AS start_id, ts AS start_ts, 1 AS n{first} FROM base WHERE rn = 1
        UNION ALL
        SELECT {keys}, b.rn, b.tie, b.ts, CASE WHEN {fresh} THEN b.tie ELSE w.start_id END,
               CASE WHEN {fresh} THEN b.ts ELSE w.start_ts END, CASE WHEN {fresh} THEN 1 ELSE w.n + 1 END{carry}
        FROM walk w JOIN base b ON {same} AND b.rn = w.rn + 1),
      runs AS (SELECT base.*, walk.start_id, {closed("walk")} AS closes
               FROM walk JOIN base USING ({key}, rn)),
      grouped AS (SELECT *, bool_or(closes) OVER (PARTITION BY {key}, start_id) AS complete FROM runs)
      """


_EVENTS_SRC = "src AS (SELECT *, event_id AS tie FROM events)"
_DOUBLED_SRC = SQL["doubled_events"] + ", src AS (SELECT *, event_id * 2 + copy AS tie FROM doubled_events)"


@query(
    "dedup_by_id",
    with_views("doubled_events")
    + """SELECT event_id, copy, user_id FROM doubled_events
         QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts, copy) = 1""",
)
def dedup_by_id(spark, sf):
    return dedup.dedup(doubled_events(spark, sf), "event_id", ["ts", "copy"]).select("event_id", "copy", "user_id")


@query(
    "dedup_by_key_columns",
    """SELECT user_id, event_type, event_id FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
)
def dedup_by_key_columns(spark, sf):
    kept = dedup.dedup(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return kept.select("user_id", "event_type", "event_id")


@query(
    "dedup_by_template",
    """SELECT CAST(event_id AS VARCHAR) AS message_id FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""",
)
def dedup_by_template(spark, sf):
    rows = event_envelopes(spark, sf).withColumn("n", F.col("message_id").cast("bigint"))
    key = dedup.key_template("${payload:user_id}-${metadata:kind}")
    return dedup.dedup(rows, key, ["n"]).select("message_id")


@query(
    "dedup_ttl",
    walk_sql(_DOUBLED_SRC, "user_id, event_type", span="10 HOUR")
    + "SELECT event_id, copy, user_id, event_type FROM grouped WHERE tie = start_id",
)
def dedup_ttl(spark, sf):
    rows = doubled_events(spark, sf).withColumn("tie", F.col("event_id") * 2 + F.col("copy"))
    kept = dedup.dedup_ttl(rows, ["user_id", "event_type"], "ts", "tie", 36_000)
    return kept.select("event_id", "copy", "user_id", "event_type")


@query(
    "dedup_ttl_hot_keys",
    walk_sql(_DOUBLED_SRC, "event_type", span="3 HOUR") + "SELECT event_id, copy, event_type FROM grouped WHERE tie = start_id",
)
def dedup_ttl_hot_keys(spark, sf):
    """Five keys hold all rows, so the range-sorted way is taken."""
    rows = doubled_events(spark, sf).withColumn("tie", F.col("event_id") * 2 + F.col("copy"))
    kept = dedup.dedup_ttl(rows, "event_type", "ts", "tie", 10_800, hot_rows=1000)
    return kept.select("event_id", "copy", "event_type")


_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE length({0}) || ':' || {0} END"
_CHANGE_ID = "sha256(concat_ws('|', {}))".format(", ".join(
    _PART.format(p) for p in ("'orders'", "CAST(key AS VARCHAR)", "op", "CAST(lsn AS VARCHAR)", "CAST(ordinal AS VARCHAR)")
))


@query("change_id", with_views("change_feed") + f"SELECT lsn, {_CHANGE_ID} AS change_id FROM change_feed")
def change_id(spark, sf):
    identity = dedup.change_id("orders", F.col("key"), F.col("op"), F.col("lsn"), F.col("ordinal"))
    return change_feed(spark, sf).select("lsn", identity.alias("change_id"))


@query(
    "lsn_order",
    """SELECT o_orderkey, CAST(o_orderkey AS DECIMAL(20,0)) * 987654321 + CAST(9223372036854775000 AS DECIMAL(20,0)) AS position
       FROM orders""",
)
def lsn_order(spark, sf):
    """Positions across 2^63, where a long would turn negative: o_orderkey * 987654321 + 9223372036854775000."""
    at = F.col("o_orderkey").cast("decimal(20,0)") * F.lit(987654321) + F.lit(9223372036854775000).cast("decimal(20,0)")
    orders = table(spark, sf, "orders").withColumn("lsn", dedup.bigint_to_lsn(at.cast("decimal(20,0)")))
    return orders.select("o_orderkey", dedup.lsn_to_bigint(F.col("lsn")).alias("position"))


_TEXT_GROUP = """SELECT user_id, start_id AS group_id, complete, count(*) AS n,
    string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, tie) AS docs FROM grouped """


def _documents(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", F.col("event_id").cast("string").alias("doc")
    )


@query(
    "correlate_count",
    walk_sql(_EVENTS_SRC, "user_id", max_rows=3) + _TEXT_GROUP + "WHERE complete GROUP BY user_id, start_id, complete",
)
def correlate_count(spark, sf):
    groups = joins.correlate(_documents(spark, sf), "user_id", "ts", "event_id", expected_count=3)
    return groups.withColumn("docs", F.array_join("docs", ","))


@query(
    "correlate_timeout_fire",
    walk_sql(_EVENTS_SRC, "user_id", span="20 HOUR", max_rows=4) + _TEXT_GROUP + "GROUP BY user_id, start_id, complete",
)
def correlate_timeout_fire(spark, sf):
    groups = joins.correlate(
        _documents(spark, sf), "user_id", "ts", "event_id", expected_count=4, timeout_seconds=72_000
    )
    return groups.withColumn("docs", F.array_join("docs", ","))


@query(
    "correlate_timeout_discard",
    walk_sql(_EVENTS_SRC, "user_id", span="20 HOUR", max_rows=2) + _TEXT_GROUP + "WHERE complete GROUP BY user_id, start_id, complete",
)
def correlate_timeout_discard(spark, sf):
    groups = joins.correlate(
        _documents(spark, sf), "user_id", "ts", "event_id", expected_count=2, timeout_seconds=72_000,
        on_timeout="discard",
    )
    return groups.withColumn("docs", F.array_join("docs", ","))


_BRANCH_GROUP = """, last AS (SELECT user_id, start_id, complete, event_type, count(*) AS n,
      arg_max(event_id, (ts, tie)) AS doc FROM grouped GROUP BY ALL)
    SELECT user_id, start_id AS group_id, complete, CAST(sum(n) AS BIGINT) AS n,
      string_agg(event_type || '=' || doc, ',' ORDER BY event_type) AS docs FROM last """


def _branch_text(groups):
    pairs = F.transform(F.map_entries("docs"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return groups.withColumn("docs", F.array_join(pairs, ","))


@query(
    "correlate_branches",
    walk_sql(_EVENTS_SRC, "user_id", required=("click", "purchase"))
    + _BRANCH_GROUP + "WHERE complete GROUP BY user_id, start_id, complete",
)
def correlate_branches(spark, sf):
    return _branch_text(joins.correlate(
        _documents(spark, sf), "user_id", "ts", "event_id", branch_by="event_type", required=["click", "purchase"]
    ))


@query(
    "correlate_branches_timeout",
    walk_sql(_EVENTS_SRC, "user_id", span="30 HOUR", required=("click", "purchase"))
    + _BRANCH_GROUP + "GROUP BY user_id, start_id, complete",
)
def correlate_branches_timeout(spark, sf):
    return _branch_text(joins.correlate(
        _documents(spark, sf), "user_id", "ts", "event_id", branch_by="event_type",
        required=["click", "purchase"], timeout_seconds=108_000,
    ))


@query(
    "batches_count_or_time",
    walk_sql(_EVENTS_SRC, "event_type", span="2 HOUR", max_rows=5)
    + "SELECT event_id, event_type, start_id AS batch_start FROM grouped",
)
def batches_count_or_time(spark, sf):
    """Batches of a few busy keys: the range-sorted way."""
    rows = _documents(spark, sf)
    batches = joins.assign_batches(rows, "event_type", "ts", "event_id", 5, 7_200, hot_rows=1500)
    return batches.select("event_id", "event_type", "batch_start")


_NEWEST = """newest AS (SELECT * FROM change_feed
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC, ordinal DESC) = 1)"""
_OLDEST = """oldest AS (SELECT * FROM change_feed
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn, ordinal) = 1)"""


def _upserted(mode, **options):
    def run(spark, sf):
        return upsert.upsert(
            change_target(spark, sf), change_feed(spark, sf), "key", mode, ["lsn", "ordinal"], **options
        ).select("key", "amount", "lsn", "ordinal")

    return run


query(
    "upsert_ignore",
    with_views("change_feed", "change_target") + f""", {_OLDEST}
    SELECT key, amount, lsn, ordinal FROM change_target UNION ALL
    SELECT key, amount, lsn, ordinal FROM oldest WHERE key NOT IN (SELECT key FROM change_target)""",
)(_upserted("ignore"))

query(
    "upsert_update",
    with_views("change_feed", "change_target") + f""", {_NEWEST}
    SELECT key, amount, lsn, ordinal FROM newest UNION ALL
    SELECT key, amount, lsn, ordinal FROM change_target WHERE key NOT IN (SELECT key FROM newest)""",
)(_upserted("update"))

query(
    "upsert_versioned",
    with_views("change_feed", "change_target") + f""", {_NEWEST}
    SELECT coalesce(s.key, t.key) AS key,
      CASE WHEN s.key IS NOT NULL AND (t.key IS NULL OR (s.lsn, s.ordinal) > (t.lsn, t.ordinal)) THEN s.amount ELSE t.amount END AS amount,
      CASE WHEN s.key IS NOT NULL AND (t.key IS NULL OR (s.lsn, s.ordinal) > (t.lsn, t.ordinal)) THEN s.lsn ELSE t.lsn END AS lsn,
      CASE WHEN s.key IS NOT NULL AND (t.key IS NULL OR (s.lsn, s.ordinal) > (t.lsn, t.ordinal)) THEN s.ordinal ELSE t.ordinal END AS ordinal
    FROM newest s FULL OUTER JOIN change_target t ON s.key = t.key""",
)(_upserted("update", version=["lsn", "ordinal"]))


@query("upsert_collapse", with_views("change_feed") + f", {_NEWEST} SELECT key, amount, lsn FROM newest")
def upsert_collapse(spark, sf):
    return upsert.collapse(change_feed(spark, sf), "key", ["lsn", "ordinal"]).select("key", "amount", "lsn")


@query(
    "require_key_rejects",
    "SELECT o_orderkey, '$.key [missing_required]: no key' AS error FROM orders WHERE o_custkey % 7 = 0",
)
def require_key_rejects(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr("if(o_custkey % 7 = 0, null, o_custkey)").alias("key"))
    return upsert.require_key(rows, "key")[1].select("o_orderkey", "error")


@query(
    "insert_strict_new",
    with_views("change_feed", "change_target") + f", {_OLDEST} SELECT key, lsn FROM oldest WHERE key NOT IN (SELECT key FROM change_target)",
)
def insert_strict_new(spark, sf):
    new, _ = upsert.insert_strict(change_target(spark, sf), change_feed(spark, sf), "key", "lsn")
    return new.select("key", "lsn")


@query(
    "insert_strict_rejects",
    with_views("change_feed", "change_target") + f""", {_OLDEST}
    SELECT key, lsn, 'duplicate key' AS error FROM change_feed WHERE lsn NOT IN
      (SELECT lsn FROM oldest WHERE key NOT IN (SELECT key FROM change_target))""",
)
def insert_strict_rejects(spark, sf):
    _, rejects = upsert.insert_strict(change_target(spark, sf), change_feed(spark, sf), "key", "lsn")
    return rejects.select("key", "lsn", "error")


@query(
    "insert_outcome",
    with_views("change_feed", "change_target") + f""", {_OLDEST}
    SELECT c.key, c.lsn, CASE WHEN o.lsn = c.lsn AND c.key NOT IN (SELECT key FROM change_target)
      THEN 'inserted' ELSE 'existed' END AS outcome
    FROM change_feed c JOIN oldest o ON o.key = c.key""",
)
def insert_outcome(spark, sf):
    return upsert.tag_outcome(change_feed(spark, sf), change_target(spark, sf), "key", "lsn").select("key", "lsn", "outcome")


@query(
    "apply_changes",
    with_views("change_feed", "change_target") + f""", {_NEWEST}
    SELECT key, amount, lsn, ordinal FROM newest WHERE op <> 'delete' UNION ALL
    SELECT key, amount, lsn, ordinal FROM change_target WHERE key NOT IN (SELECT key FROM newest)""",
)
def apply_changes(spark, sf):
    return upsert.apply_changes(change_target(spark, sf), change_feed(spark, sf), "key").select("key", "amount", "lsn", "ordinal")


@query(
    "apply_changes_truncate",
    with_views("change_feed") + f""", {_NEWEST}
    SELECT key, amount, lsn FROM newest WHERE op <> 'delete' AND lsn > (SELECT max(lsn) // 3 FROM change_feed)""",
)
def apply_changes_truncate(spark, sf):
    feed = change_feed(spark, sf)
    wipe = feed.agg(F.max("lsn").alias("m")).select(
        F.lit("truncate").alias("op"), F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("double").alias("amount"),
        F.expr("m div 3").alias("lsn"), F.lit(99).cast("bigint").alias("ordinal"),
    )
    return upsert.apply_changes(change_target(spark, sf), feed.unionByName(wipe), "key").select("key", "amount", "lsn")


@query(
    "change_log",
    with_views("change_feed") + "SELECT op AS operation, CAST(lsn AS VARCHAR) AS lsn, key, amount FROM change_feed",
)
def change_log(spark, sf):
    log = upsert.change_log(change_feed(spark, sf), ["key", "amount"])
    row = F.from_json("payload", "key bigint, amount double")
    return log.select("metadata", row.alias("r")).select(
        F.col("metadata")["operation"].alias("operation"), F.col("metadata")["lsn"].alias("lsn"), "r.key", "r.amount"
    )


@query(
    "strip_reserved_metadata",
    "SELECT CAST(event_id AS VARCHAR) AS message_id, 'correlation_id,kind,retry_count' AS keys FROM events",
)
def strip_reserved_metadata(spark, sf):
    noisy = event_envelopes(spark, sf).withColumn(
        "metadata", F.map_concat("metadata", F.create_map(F.lit("src.file"), F.lit("x"), F.lit("src.lsn"), F.lit("1")))
    )
    keys = F.array_join(F.array_sort(F.map_keys("metadata")), ",")
    return strip_reserved(noisy).select("message_id", keys.alias("keys"))
