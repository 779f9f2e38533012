"""Record-shaped views of the driver tables, shared by the registered queries.

Each view has a SQL twin in ``SQL``: text to put after ``WITH`` in an oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.plans.registry import table


def event_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as typed documents: nested ``props``, an array, a nullable text and metadata."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.from_json("props", "k bigint").alias("props"),
        F.array_repeat(kind, (F.col("event_id") % 3).cast("int")).alias("tags"),
        (F.col("value") > 20).alias("active"),
        F.when(F.col("event_id") % 4 != 0, F.concat(kind, F.lit("-note"))).alias("note"),
        F.create_map(
            F.lit("kind"), kind,
            F.lit("retry_count"), (F.col("event_id") % 7).cast("string"),
            F.lit("correlation_id"), F.col("user_id").cast("string"),
        ).alias("metadata"),
    )


def event_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as envelopes: the row as JSON payload, id and metadata outside."""
    docs = table(spark, sf, "events")
    return docs.select(
        F.col("event_id").cast("string").alias("message_id"),
        F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("payload"),
        F.create_map(
            F.lit("kind"), F.col("event_type"),
            F.lit("retry_count"), (F.col("event_id") % 7).cast("string"),
            F.lit("correlation_id"), F.col("user_id").cast("string"),
        ).alias("metadata"),
    )


def orders_text(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as text cells with some bad and some absent prices."""
    key = F.col("o_orderkey")
    price = (
        F.when(key % 97 == 0, F.lit("oops"))
        .when(key % 89 == 0, F.lit(None))
        .otherwise(F.col("o_totalprice").cast("string"))
    )
    return table(spark, sf, "orders").select(
        key.cast("string").alias("o_orderkey"), F.col("o_custkey").cast("string").alias("o_custkey"),
        "o_orderstatus", price.alias("o_totalprice"), "o_orderpriority",
    )


def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Several changes per customer, drawn from orders."""
    ops = F.array(F.lit("insert"), F.lit("update"), F.lit("delete"), F.lit("replace"))
    return table(spark, sf, "orders").select(
        F.element_at(ops, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("op"),
        F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderkey").alias("lsn"), (F.col("o_custkey") % 3).alias("ordinal"),
    )


def change_target(spark: SparkSession, sf: str) -> DataFrame:
    """The current table the changes go to: one row per customer, even keys only."""
    return table(spark, sf, "customer").where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"),
        (F.col("c_custkey") * 3).alias("lsn"), F.lit(0).cast("bigint").alias("ordinal"),
    )


def all_customers(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"),
        (F.col("c_custkey") * 3).alias("lsn"), F.lit(0).cast("bigint").alias("ordinal"),
    )


def doubled_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events plus a repeat of every fifth one ten seconds later."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    again = events.where("event_id % 5 = 0").withColumn("ts", F.expr("ts + interval 10 seconds"))
    return events.withColumn("copy", F.lit(0)).unionByName(again.withColumn("copy", F.lit(1)))


SQL = {
    "event_docs": """event_docs AS (
        SELECT event_id, ts, user_id, event_type, value,
               CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 3 AS n_tags,
               value > 20 AS active,
               CASE WHEN event_id % 4 <> 0 THEN event_type || '-note' END AS note,
               CAST(event_id % 7 AS VARCHAR) AS retry_count
        FROM events)""",
    "orders_text": """orders_text AS (
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
               o_orderstatus, o_orderpriority,
               CASE WHEN o_orderkey % 97 = 0 THEN 'oops' WHEN o_orderkey % 89 = 0 THEN NULL
                    ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice
        FROM orders)""",
    "change_feed": """change_feed AS (
        SELECT CASE o_orderkey % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'delete'
                    ELSE 'replace' END AS op,
               o_custkey AS key, o_totalprice AS amount, o_orderkey AS lsn, o_custkey % 3 AS ordinal
        FROM orders)""",
    "all_customers": """all_customers AS (
        SELECT c_custkey AS key, c_acctbal AS amount, c_custkey * 3 AS lsn, CAST(0 AS BIGINT) AS ordinal FROM customer)""",
    "change_target": """change_target AS (
        SELECT c_custkey AS key, c_acctbal AS amount, c_custkey * 3 AS lsn, CAST(0 AS BIGINT) AS ordinal
        FROM customer WHERE c_custkey % 2 = 0)""",
    "doubled_events": """doubled_events AS (
        SELECT event_id, ts, user_id, event_type, value, 0 AS copy FROM events
        UNION ALL
        SELECT event_id, ts + INTERVAL 10 SECOND, user_id, event_type, value, 1 FROM events
        WHERE event_id % 5 = 0)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
