"""Registered queries: filters and predicates over event documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicework.operators.filtering import filter_counts, filter_rows, require_document, unresolved_fields
from sluicework.plans.fixtures import event_docs, event_envelopes, with_views
from sluicework.plans.registry import query, table

# (query, expression, condition in SQL)
EXPRESSIONS = [
    ("filter_rows", "value > 25", "value > 25"),
    ("filter_greater_equal", "value >= 12.5", "value >= 12.5"),
    ("filter_less", "value < 3", "value < 3"),
    ("filter_less_equal", "event_id <= user_id", "event_id <= user_id"),
    ("filter_equal", "event_type == 'click'", "event_type = 'click'"),
    ("filter_not_equal", "event_type != 'click'", "event_type <> 'click'"),
    ("filter_and", "value > 5 and value < 10", "value > 5 AND value < 10"),
    ("filter_and_symbol", "value > 5 && event_type == 'view'", "value > 5 AND event_type = 'view'"),
    ("filter_or", "value > 30 or event_type == 'error'", "value > 30 OR event_type = 'error'"),
    ("filter_or_symbol", "user_id == 7 || user_id == 8", "user_id IN (7, 8)"),
    ("filter_not", "not active", "NOT active"),
    ("filter_boolean_field", "active", "active"),
    ("filter_in", "event_type in ['view','signup']", "event_type IN ('view', 'signup')"),
    ("filter_starts_with", "startsWith(event_type, 'p')", "starts_with(event_type, 'p')"),
    ("filter_contains", "contains(note, 'ick-no')", "contains(note, 'ick-no')"),
    ("filter_len_array", "len(tags) > 1", "n_tags > 1"),
    ("filter_len_text", "len(event_type) > 5", "length(event_type) > 5"),
    ("filter_number", "number(note) > 1 or number(meta.retry_count) >= 5", "CAST(retry_count AS DOUBLE) >= 5"),
    ("filter_null_test", "note == null", "note IS NULL"),
    ("filter_not_null_test", "note != null", "note IS NOT NULL"),
    ("filter_nested_path", "props.k >= 90", "k >= 90"),
    ("filter_metadata", "meta.kind == 'purchase'", "event_type = 'purchase'"),
    ("filter_unknown_drops", "note != 'click-note'", "note <> 'click-note'"),
]


def _register(name: str, expression: str, condition: str) -> None:
    def run(spark, sf):
        return filter_rows(event_docs(spark, sf), expression).select("event_id", "event_type", "value")

    sql = with_views("event_docs") + f"SELECT event_id, event_type, value FROM event_docs WHERE {condition}"
    query(name, sql)(run)


for _case in EXPRESSIONS:
    _register(*_case)


@query(
    "filter_counts",
    with_views("event_docs")
    + """SELECT count(*) AS rows_read, count(*) FILTER (WHERE note <> 'click-note') AS rows_kept,
         count(*) - count(*) FILTER (WHERE note <> 'click-note') AS rows_dropped FROM event_docs""",
)
def counts(spark, sf):
    return filter_counts(event_docs(spark, sf), "note != 'click-note'")


@query(
    "filter_unresolved_fields",
    with_views("event_docs")
    + """SELECT 'note' AS field, count(note) AS rows_with_field, count(note) = 0 AS unresolved FROM event_docs
         UNION ALL SELECT 'valeu', CAST(0 AS BIGINT), true""",
)
def unresolved(spark, sf):
    return unresolved_fields(event_docs(spark, sf), "note == 'x' and valeu > 3")


@query("filter_document_guard", "SELECT CAST(event_id AS VARCHAR) AS message_id, event_type FROM events")
def document_guard(spark, sf):
    docs = require_document(event_envelopes(spark, sf), "payload")
    return docs.select("message_id", F.variant_get("doc", "$.event_type", "string").alias("event_type"))


@query(
    "filter_pushed_to_scan",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus IN ('O', 'F')",
)
def pushed(spark, sf):
    orders = filter_rows(table(spark, sf, "orders"), "o_totalprice > 1000 and o_orderstatus in ['O','F']")
    return orders.select("o_orderkey", "o_totalprice")


# The payload's fields are paths into its JSON; every case reads all events.
DOCUMENTS = [
    ("filter_document_number", "value > 50 and user_id < 100", "value > 50 AND user_id < 100"),
    ("filter_document_text", "event_type in ['click','purchase'] or startsWith(event_type, 'v')", "event_type IN ('click', 'purchase') OR event_type LIKE 'v%'"),
    ("filter_document_metadata", "meta.kind == 'purchase' and number(meta.retry_count) >= 3", "event_type = 'purchase' AND event_id % 7 >= 3"),
    ("filter_document_kinds", "event_type > 3 or not value or len(event_type) == 5", "length(event_type) = 5"),
]


def _register_document(name: str, expression: str, condition: str) -> None:
    def run(spark, sf):
        kept = filter_rows(event_envelopes(spark, sf), expression)
        return kept.select("message_id", F.get_json_object("payload", "$.event_type").alias("event_type"))

    query(name, f"SELECT CAST(event_id AS VARCHAR) AS message_id, event_type FROM events WHERE {condition}")(run)


for _case in DOCUMENTS:
    _register_document(*_case)
