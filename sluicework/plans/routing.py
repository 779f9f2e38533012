"""Registered queries: switches, fanout and handlers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sluicework.operators import handlers, routing
from sluicework.plans.fixtures import event_docs, event_envelopes, with_views
from sluicework.plans.registry import query, table
from sluicework.session import staging_path

_PRIORITY = {"1-URGENT": "fast", "2-HIGH": "fast", "3-MEDIUM": "normal"}
_PRIORITY_CASE = """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast'
    WHEN o_orderpriority = '3-MEDIUM' THEN 'normal' ELSE 'rest' END"""
_PRICE = [
    ("o_totalprice > 400000", "big"),
    ("o_totalprice > 200000 and o_orderstatus in ['O','F']", "settled"),
    ("o_orderstatus == 'P'", "pending"),
]
_PRICE_CASE = """CASE WHEN o_totalprice > 400000 THEN 'big'
    WHEN o_totalprice > 200000 AND o_orderstatus IN ('O', 'F') THEN 'settled'
    WHEN o_orderstatus = 'P' THEN 'pending' END"""


@query("switch_by_value", f"SELECT o_orderkey, {_PRIORITY_CASE} AS route FROM orders")
def switch_by_value(spark, sf):
    routed = routing.switch_value(table(spark, sf, "orders"), "o_orderpriority", _PRIORITY, "rest")
    return routed.select("o_orderkey", "route")


@query(
    "switch_by_metadata",
    """SELECT CAST(event_id AS VARCHAR) AS message_id, CASE event_type WHEN 'click' THEN 'ui' WHEN 'view' THEN 'ui'
       WHEN 'purchase' THEN 'sales' ELSE 'other' END AS route FROM events""",
)
def switch_by_metadata(spark, sf):
    routed = routing.switch(
        event_envelopes(spark, sf), key=F.col("metadata")["kind"],
        cases={"click": "ui", "view": "ui", "purchase": "sales"}, default="other",
    )
    return routed.select("message_id", "route")


@query("switch_by_condition", f"SELECT o_orderkey, coalesce({_PRICE_CASE}, 'rest') AS route FROM orders")
def switch_by_condition(spark, sf):
    return routing.switch_when(table(spark, sf, "orders"), _PRICE, "rest").select("o_orderkey", "route")


@query(
    "switch_branch_counts",
    f"SELECT coalesce({_PRICE_CASE}, 'rest') AS route, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
)
def switch_branch_counts(spark, sf):
    routed = routing.switch_when(table(spark, sf, "orders"), _PRICE, "rest")
    return routed.groupBy("route").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "switch_unrouted",
    f"SELECT count(*) AS rows_read, count(*) FILTER (WHERE {_PRICE_CASE} IS NULL) AS rows_unrouted FROM orders",
)
def switch_unrouted(spark, sf):
    return routing.unrouted(routing.switch_when(table(spark, sf, "orders"), _PRICE))


@query("switch_written_routes", f"SELECT o_orderkey, {_PRICE_CASE} AS route FROM orders WHERE {_PRICE_CASE} IS NOT NULL")
def switch_written_routes(spark, sf):
    path = staging_path(spark, "routes")
    routing.write_routes(routing.switch_when(table(spark, sf, "orders"), _PRICE).select("o_orderkey", "route"), path)
    return spark.read.parquet(path).select("o_orderkey", "route")


def _parquet_sink(path):
    return lambda df: df.write.mode("append").parquet(path)


@query(
    "fanout_all_sinks",
    "SELECT s.sink, o_orderkey, o_totalprice FROM orders CROSS JOIN (VALUES ('a'), ('b')) s(sink)",
)
def fanout_all_sinks(spark, sf):
    paths = {name: staging_path(spark, f"fan-{name}") for name in ("a", "b")}
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    routing.fanout(orders, {name: _parquet_sink(path) for name, path in paths.items()})
    a, b = (spark.read.parquet(paths[n]).withColumn("sink", F.lit(n)) for n in ("a", "b"))
    return a.unionByName(b).select("sink", "o_orderkey", "o_totalprice")


@query(
    "fanout_nested_switch",
    f"""SELECT 'copy' AS sink, o_orderkey FROM orders UNION ALL
        SELECT {_PRIORITY_CASE} AS sink, o_orderkey FROM orders""",
)
def fanout_nested_switch(spark, sf):
    paths = {n: staging_path(spark, f"nest-{n}") for n in ("copy", "fast", "normal", "rest")}
    sinks = {n: _parquet_sink(p) for n, p in paths.items()}
    inner = routing.switch_sink(
        lambda df: routing.switch_value(df, "o_orderpriority", _PRIORITY, "rest"),
        {n: sinks[n] for n in ("fast", "normal", "rest")},
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    routing.fanout(orders, {"copy": sinks["copy"], "switch": inner})
    written = [spark.read.parquet(p).select(F.lit(n).alias("sink"), "o_orderkey") for n, p in paths.items()]
    out = written[0]
    for part in written[1:]:
        out = out.unionByName(part)
    return out


@query(
    "branch_chain",
    f"SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE {_PRIORITY_CASE} = 'fast' AND o_totalprice > 250000",
)
def branch_chain(spark, sf):
    path = staging_path(spark, "chain")
    chain = routing.branch(
        [lambda df: df.where("o_totalprice > 250000"),
         lambda df: df.select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"))],
        _parquet_sink(path),
    )
    routed = routing.switch_value(table(spark, sf, "orders"), "o_orderpriority", _PRIORITY, "rest")
    chain(routing.branch_rows(routed, "fast"))
    return spark.read.parquet(path)


def _score(batch: pd.DataFrame) -> pd.DataFrame:
    status = (batch["value"] > 20).map({True: "200", False: "404"})
    return pd.DataFrame({"event_id": batch["event_id"], "response": batch["value"].round(0), "status": status})


@query(
    "enrich_and_route",
    """SELECT event_id, CASE WHEN value > 20 THEN 'found' ELSE 'missing' END AS route FROM events""",
)
def enrich_and_route(spark, sf):
    answered = routing.enrich(
        table(spark, sf, "events").select("event_id", "value"), _score,
        "event_id long, response double, status string",
    )
    routed = routing.switch_value(answered, "status", {"200": "found"}, "missing")
    return routed.select("event_id", "route")


@query(
    "enrich_keep_rows",
    """SELECT event_id, value, CASE WHEN value > 20 THEN 'found' ELSE 'missing' END AS route,
              CASE WHEN value > 20 THEN '200' ELSE '404' END AS status FROM events""",
)
def enrich_keep_rows(spark, sf):
    """The answer of a batch call kept as metadata beside the input columns, and routed on."""
    answered = routing.enrich_rows(table(spark, sf, "events").select("event_id", "value"), lambda b: _score(b).drop(columns=["event_id"]))
    routed = routing.switch_value(answered, F.col("metadata")["enrich.status"], {"200": "found"}, "missing")
    return routed.select("event_id", "value", "route", F.col("metadata")["enrich.status"].alias("status"))


def _keep_large(batch: pd.DataFrame) -> pd.DataFrame:
    return batch.loc[batch["value"] > 10, ["event_id", "value"]].assign(value=lambda d: d["value"] * 2)


@query("command_handler", "SELECT event_id, value * 2 AS value FROM events WHERE value > 10")
def command_handler(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    return handlers.apply_handler(events, _keep_large, "event_id long, value double")


def _tagged(tag):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_id": batch["event_id"].astype("int64"), "handled_by": tag})

    return run


@query(
    "type_handler",
    "SELECT event_id, 'on_' || event_type AS handled_by FROM events WHERE event_type IN ('click', 'purchase')",
)
def type_handler(spark, sf):
    return handlers.type_handler(
        event_envelopes(spark, sf),
        {"click": ("event_id bigint, value double", _tagged("on_click")),
         "purchase": ("event_id bigint, user_id bigint", _tagged("on_purchase"))},
        "event_id long, handled_by string",
    )


@query(
    "switch_on_documents",
    with_views("event_docs")
    + """SELECT event_id, CASE WHEN k >= 50 AND event_type = 'error' THEN 'alert'
         WHEN n_tags > 1 THEN 'tagged' WHEN note IS NULL THEN 'bare' ELSE 'rest' END AS route FROM event_docs""",
)
def switch_on_documents(spark, sf):
    return routing.switch_when(
        event_docs(spark, sf),
        [("props.k >= 50 and meta.kind == 'error'", "alert"), ("len(tags) > 1", "tagged"), ("note == null", "bare")],
        "rest",
    ).select("event_id", "route")
