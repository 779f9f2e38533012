"""Registered queries: sinks, checked by reading back what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicework.functions import codecs
from sluicework.plans.fixtures import event_envelopes, with_views
from sluicework.plans.registry import query, table
from sluicework.session import staging_path
from sluicework.sinks import files as sinks
from sluicework.sinks import records
from sluicework.sources import files as sources

KEY = bytes(range(32))


@query("sink_raw", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def sink_raw(spark, sf):
    path = staging_path(spark, "raw-out")
    sinks.write_raw(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), path)
    return spark.read.schema("l_orderkey bigint, l_linenumber int, l_quantity double, l_returnflag string").json(path)


@query("sink_envelope_json", "SELECT CAST(event_id AS VARCHAR) AS message_id, event_id, event_type AS kind FROM events")
def sink_envelope_json(spark, sf):
    path = staging_path(spark, "json-out")
    sinks.write_envelope(event_envelopes(spark, sf), path, "json")
    nested = spark.read.schema(
        "message_id string, payload struct<event_id:bigint>, metadata map<string,string>"
    ).json(path)
    return nested.select("message_id", "payload.event_id", F.col("metadata")["kind"].alias("kind"))


@query(
    "sink_envelope_normal",
    """SELECT CAST(doc_id AS VARCHAR) AS message_id, md5(text) AS payload_hex, false AS has_both FROM documents""",
)
def sink_envelope_normal(spark, sf):
    """Sixteen arbitrary bytes per row: mostly not UTF-8, so both carriers are used."""
    path = staging_path(spark, "normal-out")
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("message_id"), F.unhex(F.md5("text")).alias("payload"),
        F.expr("cast(map() as map<string,string>)").alias("metadata"),
    )
    sinks.write_envelope(rows, path, "normal")
    both = spark.read.schema("message_id string, payload string, payload_base64 string").json(path)
    carriers = both.select(
        "message_id", (F.col("payload").isNotNull() & F.col("payload_base64").isNotNull()).alias("has_both")
    )
    back = sources.read_envelope(spark, path, "normal")
    return back.join(carriers, "message_id").select(
        "message_id", F.lower(F.hex("payload")).alias("payload_hex"), "has_both"
    )


@query("sink_envelope_text", "SELECT CAST(event_id AS VARCHAR) AS message_id, user_id FROM events")
def sink_envelope_text(spark, sf):
    path = staging_path(spark, "text-out")
    sinks.write_envelope(event_envelopes(spark, sf), path, "text")
    rows = spark.read.schema("message_id string, payload string").json(path)
    return rows.select("message_id", F.get_json_object("payload", "$.user_id").cast("bigint").alias("user_id"))


@query("sink_csv", "SELECT page_id, url, md5(html) AS html_md5 FROM pages")
def sink_csv(spark, sf):
    path = staging_path(spark, "csv-out")
    sinks.write_csv(table(spark, sf, "pages").select("page_id", "url", "html"), path)
    rows = sources.read_csv(spark, path, ["page_id", "url", "html"])
    return rows.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.md5("html").alias("html_md5"))


def _compressed(compression):
    def run(spark, sf):
        path = staging_path(spark, f"{compression}-out")
        sinks.write_raw(table(spark, sf, "documents").select("doc_id", "text"), path, compression)
        back = sources.read_raw(spark, path, compression=compression)
        row = F.from_json("payload", "doc_id bigint, text string")
        return back.select(row.alias("r")).select("r.doc_id", F.md5("r.text").alias("text_md5"))

    return run


for _codec in ("gzip", "lz4", "zstd"):
    query(f"compressed_file_{_codec}", "SELECT doc_id, md5(text) AS text_md5 FROM documents")(_compressed(_codec))
    query(f"compressed_csv_{_codec}", "SELECT doc_id, md5(text) AS text_md5 FROM documents")(
        (lambda codec: lambda spark, sf: _csv_compressed(spark, sf, codec))(_codec)
    )


def _csv_compressed(spark, sf, codec):
    path = staging_path(spark, f"{codec}-csv-out")
    sinks.write_csv(table(spark, sf, "documents").select("doc_id", "text"), path, codec)
    rows = sources.read_csv(spark, path, ["doc_id", "text"], compression=codec)
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"))


@query("encrypted_file", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def encrypted_file(spark, sf):
    path = staging_path(spark, "sealed-out")
    sinks.write_encrypted(table(spark, sf, "documents").select("doc_id", "text"), path, "k1", KEY, "zstd")
    back = sources.read_encrypted(spark, path, {"k1": KEY}, "zstd")
    row = F.from_json("payload", "doc_id bigint, text string")
    return back.select(row.alias("r")).select("r.doc_id", F.md5("r.text").alias("text_md5"))


def _payload_codec(close, open_):
    def run(spark, sf):
        docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("payload"))
        closed = close(docs)
        changed = closed.select("doc_id", F.md5("payload").alias("closed_md5"), "payload")
        back = open_(changed)
        return back.select(
            "doc_id", F.md5("payload").alias("text_md5"), (F.md5("payload") != F.col("closed_md5")).alias("changed")
        )

    return run


_SEALED_SQL = "SELECT doc_id, md5(text) AS text_md5, true AS changed FROM documents"
for _codec in ("gzip", "lz4", "zstd"):
    query(f"payload_{_codec}", _SEALED_SQL)(
        _payload_codec(
            lambda df, c=_codec: codecs.compress_payload(df, c),
            lambda df, c=_codec: codecs.decompress_payload(df, c, 10_000_000),
        )
    )
query("payload_encryption", _SEALED_SQL)(
    _payload_codec(
        lambda df: codecs.encrypt_payload(df, "k2", KEY),
        lambda df: codecs.decrypt_payload(df, {"k1": KEY[::-1], "k2": KEY}),
    )
)
query("payload_sealed", _SEALED_SQL)(
    _payload_codec(
        lambda df: codecs.seal(df, "zstd", "k1", KEY), lambda df: codecs.unseal(df, "zstd", {"k1": KEY})
    )
)


@query(
    "sink_objects_by_date",
    """SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day,
       count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY ALL""",
)
def sink_objects_by_date(spark, sf):
    path = staging_path(spark, "dated-out")
    events = table(spark, sf, "events")
    sinks.write_objects(events.select("event_id", "ts"), path, now=F.col("ts"))
    kept = spark.read.schema("value string, year string, month string, day string").option(
        "basePath", path
    ).text(path)
    return kept.groupBy("year", "month", "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("value", "$.event_id").cast("bigint")).alias("id_sum")
    )


@query("sink_idempotent_replay", "SELECT o_orderkey, o_totalprice FROM orders")
def sink_idempotent_replay(spark, sf):
    path = staging_path(spark, "replay-out")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    for batch_id, condition in ((0, "o_orderkey % 2 = 0"), (1, "o_orderkey % 2 = 1"), (1, "o_orderkey % 2 = 1")):
        sinks.write_idempotent(orders.where(condition), path, batch_id)
    return spark.read.schema("o_orderkey bigint, o_totalprice double").json(f"{path}/batch=*")


@query("sink_null_counted", "SELECT count(*) AS rows_read, count(*) AS rows_delivered FROM lineitem")
def sink_null_counted(spark, sf):
    report = records.write_counted(table(spark, sf, "lineitem"), sinks.drain)
    return spark.createDataFrame([(report.read, report.delivered)], "rows_read long, rows_delivered long")


@query("sink_table_append", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def sink_table_append(spark, sf):
    path = staging_path(spark, "table-out")
    suppliers = table(spark, sf, "supplier")
    sinks.append_table(suppliers.where("s_suppkey % 2 = 0").select("s_suppkey", "s_name", "s_acctbal"), path)
    sinks.append_table(suppliers.where("s_suppkey % 2 = 1").select("s_acctbal", "s_name", "s_suppkey"), path, create=False)
    return spark.read.parquet(path)


@query(
    "sink_insert_tokens",
    """SELECT event_id AS id, value AS amount, event_type AS kind, CAST(NULL AS VARCHAR) AS gone,
       'web' AS channel FROM events""",
)
def sink_insert_tokens(spark, sf):
    return sinks.project_tokens(
        event_envelopes(spark, sf),
        {"id": "${payload:event_id}", "amount": "${payload:value}", "kind": "${metadata:kind}",
         "gone": "${payload:nowhere}", "channel": "web"},
        {"id": "bigint", "amount": "double"},
    )


@query(
    "sink_record_key",
    """SELECT CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS key,
       event_id FROM events""",
)
def sink_record_key(spark, sf):
    rows = event_envelopes(spark, sf).withColumn(
        "metadata",
        F.when(F.col("message_id").cast("bigint") % 4 == 0, F.expr("cast(map() as map<string,string>)")).otherwise(F.col("metadata")),
    )
    keyed = records.kafka_records(rows, "correlation_id")
    return keyed.select(
        F.col("key").cast("string").alias("key"),
        F.get_json_object(F.col("value").cast("string"), "$.event_id").cast("bigint").alias("event_id"),
    )


def _dead_letters(spark, sf):
    kind = F.col("metadata")["kind"]
    return records.split_dlq(
        event_envelopes(spark, sf),
        [(kind != "error", "kind is error"),
         (F.get_json_object("payload", "$.value").cast("double") < 40, "value too large")],
    )


@query("dead_letters_accepted", "SELECT CAST(event_id AS VARCHAR) AS message_id FROM events WHERE event_type <> 'error' AND value < 40")
def dead_letters_accepted(spark, sf):
    return _dead_letters(spark, sf)[0].select("message_id")


@query(
    "dead_letters_rejected",
    """SELECT CAST(event_id AS VARCHAR) AS message_id,
       CASE WHEN event_type = 'error' THEN 'kind is error' ELSE 'value too large' END AS error
       FROM events WHERE event_type = 'error' OR value >= 40""",
)
def dead_letters_rejected(spark, sf):
    return _dead_letters(spark, sf)[1].select("message_id", "error")


@query(
    "dead_letters_replayed",
    """SELECT CAST(event_id AS VARCHAR) AS message_id, event_type AS kind FROM events
       WHERE (event_type = 'error' OR value >= 40) AND event_id % 3 <> 0""",
)
def dead_letters_replayed(spark, sf):
    path = staging_path(spark, "dlq")
    rejects = _dead_letters(spark, sf)[1]
    records.write_dlq(rejects, path)
    done = rejects.where(F.col("message_id").cast("bigint") % 3 == 0)
    return records.replay_dlq(spark, path, done).select("message_id", F.col("metadata")["kind"].alias("kind"))


@query(
    "sink_drop_report",
    with_views("event_docs")
    + """SELECT count(*) AS rows_read, count(*) FILTER (WHERE value > 5) AS rows_kept,
         count(*) FILTER (WHERE value <= 5) AS rows_filtered, CAST(0 AS BIGINT) AS rows_dropped FROM event_docs""",
)
def sink_drop_report(spark, sf):
    events = table(spark, sf, "events")
    report = records.write_counted(events, sinks.drain, keep=F.col("value") > 5)
    return spark.createDataFrame(
        [(report.read, report.kept, report.filtered, report.dropped)],
        "rows_read long, rows_kept long, rows_filtered long, rows_dropped long",
    )
