"""Headline jobs at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every job runs once to warm the JVM and once timed.  Inputs that have to exist as files are
written before timing.  ``rows_per_sec`` is input rows over the timed run.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

from pyspark.sql import functions as F  # noqa: E402

from sluicework.operators import correlate, dedup, filtering, metrics, parity, retention, routing, shaping, upsert  # noqa: E402
from sluicework.functions.envelopes import to_envelope  # noqa: E402
from sluicework.functions.texts import payload_profile  # noqa: E402
from sluicework.plans.fixtures import change_feed, change_target, event_docs, event_envelopes  # noqa: E402
from sluicework.session import local_session  # noqa: E402
from sluicework.sinks import files as sinks  # noqa: E402
from sluicework.sources import files as sources  # noqa: E402

LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
LINE_SCHEMA = {
    "required": ["l_orderkey"],
    "properties": {
        "l_orderkey": {"type": "integer"}, "l_partkey": {"type": "integer"}, "l_suppkey": {"type": "integer"},
        "l_linenumber": {"type": "integer"}, "l_quantity": {"type": "number"}, "l_extendedprice": {"type": "number"},
        "l_discount": {"type": "number"}, "l_tax": {"type": "number"}, "l_returnflag": {"type": "string", "enum": ["A", "N", "R"]},
        "l_linestatus": {"type": "string"}, "l_shipdate": {"type": "string"},
    },
}


def main() -> None:
    spark = local_session(CPUS, "bench")
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    fresh = iter(range(10_000))

    def out() -> str:
        return f"{scratch}/out-{next(fresh)}"

    def table(name):
        return spark.read.parquet(f"{SF_DIR}/{name}.parquet")

    lines, events, orders = table("lineitem"), table("events"), table("orders")
    n_lines, n_events, n_orders = lines.count(), events.count(), orders.count()
    staged = f"{scratch}/staged"
    sinks.write_csv(lines.repartition(8), f"{staged}/csv")
    raw = lines.repartition(8)
    sinks.write_raw(raw, f"{staged}/raw")
    sinks.write_raw(raw, f"{staged}/zstd", "zstd")
    envelopes = to_envelope(raw, message_id=F.concat_ws("-", "l_orderkey", "l_linenumber"))
    for encoding in ("json", "normal", "text"):
        sinks.write_envelope(envelopes, f"{staged}/{encoding}", encoding)
    # Several files, as a table of any size has; the driver's table is a single row group.
    raw.write.parquet(f"{staged}/table")
    spread = spark.read.parquet(f"{staged}/table")

    def csv():
        return sources.read_csv(spark, f"{staged}/csv", LINE_COLUMNS, splittable=True)

    def typed():
        return shaping.split_by_error(shaping.type_columns(csv(), LINE_SCHEMA))[0]

    def documents():
        return shaping.transform(
            event_envelopes(spark, SF_DIR),
            mapping={"id": "$.event_id", "kind": "$.event_type", "amount": "$.value"},
            schema={"properties": {"id": {"type": "integer"}, "amount": {"type": "number"}}, "required": ["id"]},
        )[0]

    def routed():
        cases = [("o_totalprice > 400000", "big"), ("o_orderstatus in ['O','F']", "settled")]
        return routing.switch_when(orders, cases, "rest").groupBy("route").count()

    docs = events.select("event_id", "ts", "user_id", "event_type", F.col("event_id").cast("string").alias("doc"))
    jobs = {
        "csv_to_jsonl_untyped": (n_lines, lambda: sinks.write_raw(csv(), out())),
        "csv_to_jsonl_typed": (n_lines, lambda: sinks.write_raw(typed(), out())),
        "csv_projection_to_jsonl": (n_lines, lambda: sinks.write_raw(
            shaping.project(csv(), ["l_orderkey", "l_partkey", "l_quantity", "l_shipdate"]), out())),
        "table_to_csv": (n_lines, lambda: sinks.write_csv(spread, out())),
        "table_to_normal": (n_lines, lambda: sinks.write_envelope(to_envelope(spread, message_id=F.col("l_orderkey")), out())),
        "table_to_jsonl": (n_lines, lambda: sinks.write_raw(spread, out())),
        "read_csv": (n_lines, lambda: sinks.drain(csv())),
        "read_raw": (n_lines, lambda: sinks.drain(sources.read_raw(spark, f"{staged}/raw"))),
        "read_json_envelope": (n_lines, lambda: sinks.drain(sources.read_envelope(spark, f"{staged}/json", "json"))),
        "read_normal_envelope": (n_lines, lambda: sinks.drain(sources.read_envelope(spark, f"{staged}/normal", "normal"))),
        "read_text_envelope": (n_lines, lambda: sinks.drain(sources.read_envelope(spark, f"{staged}/text", "text"))),
        "zstd_round_trip": (n_lines, lambda: sinks.write_raw(
            sources.read_raw(spark, f"{staged}/zstd", compression="zstd"), out(), "zstd")),
        "filter_pushdown": (n_lines, lambda: sinks.drain(
            filtering.filter_rows(lines, "l_quantity >= 30 and l_returnflag in ['A','R']"))),
        "filter_documents": (n_events, lambda: sinks.drain(
            filtering.filter_rows(event_docs(spark, SF_DIR), "props.k >= 50 and number(meta.retry_count) >= 3"))),
        "transform_documents": (n_events, lambda: sinks.drain(documents())),
        "switch_and_count": (n_orders, lambda: sinks.drain(routed())),
        "dedup_first": (n_events, lambda: sinks.drain(dedup.dedup(events, ["user_id", "event_type"], ["ts", "event_id"]))),
        "dedup_ttl": (n_events, lambda: sinks.drain(dedup.dedup_ttl(docs, ["user_id", "event_type"], "ts", "event_id", 36_000))),
        "correlate_count": (n_events, lambda: sinks.drain(
            correlate.correlate(docs, "user_id", "ts", "event_id", expected_count=3))),
        "correlate_branches": (n_events, lambda: sinks.drain(correlate.correlate(
            docs, "user_id", "ts", "event_id", branch_by="event_type", required=["click", "purchase"], timeout_seconds=108_000))),
        "upsert_update": (n_orders, lambda: sinks.drain(upsert.upsert(
            change_target(spark, SF_DIR), change_feed(spark, SF_DIR), "key", "update", ["lsn", "ordinal"]))),
        "apply_changes": (n_orders, lambda: sinks.drain(
            upsert.apply_changes(change_target(spark, SF_DIR), change_feed(spark, SF_DIR), "key"))),
        "keep_last": (n_events, lambda: sinks.drain(retention.keep_last(events, 20, "event_type", ["ts", "event_id"]))),
        "parity": (2 * n_lines, lambda: sinks.drain(parity.parity(spread, spread))),
        "latency_quantiles": (n_events, lambda: sinks.drain(metrics.latency_quantiles(events, "value", ["event_type"]))),
        "payload_profile": (table("pages").count(), lambda: sinks.drain(payload_profile(table("pages"), "html"))),
    }
    only = set(sys.argv[1:])
    seconds, rates = {}, {}
    for name, (rows, job) in jobs.items():
        if only and name not in only:
            continue
        job()
        begun = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - begun, 3)
        rates[name] = round(rows / seconds[name])
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "rows_per_sec": rates, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": CPUS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
