"""Envelope form of a record: ``message_id``, ``payload`` and text ``metadata``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: metadata keys with this prefix are set by sources and stripped from input.
RESERVED_PREFIX = "src."
ENVELOPE_JSON = "message_id string, payload string, payload_base64 string, metadata map<string,string>"
EMPTY_METADATA = "cast(map() as map<string,string>)"


def to_envelope(
    df: DataFrame,
    payload: Column | None = None,
    metadata: Column | None = None,
    message_id: Column | None = None,
) -> DataFrame:
    """Wrap rows. Without ``payload`` the whole row is serialised; a text payload is kept as is.

    Supply ``message_id`` for a stable identity; otherwise one is generated.
    """
    body = payload if payload is not None else F.to_json(F.struct("*"))
    notes = metadata if metadata is not None else F.expr(EMPTY_METADATA)
    identity = message_id.cast("string") if message_id is not None else F.uuid()
    return df.select(
        identity.alias("message_id"), body.alias("payload"), notes.alias("metadata")
    )


def from_envelope(df: DataFrame) -> DataFrame:
    """Unwrap: ``doc`` where the payload is structured JSON, ``text`` where it is not."""
    parsed = F.try_parse_json("payload")
    shape = F.schema_of_variant(parsed)
    structured = shape.startswith("OBJECT") | shape.startswith("ARRAY")
    return df.withColumn("doc", F.when(structured, parsed)).withColumn(
        "text", F.when(F.coalesce(structured, F.lit(False)), F.lit(None)).otherwise(F.col("payload"))
    )


def strip_reserved(df: DataFrame, metadata: str = "metadata", prefix: str = RESERVED_PREFIX) -> DataFrame:
    """Drop reserved metadata keys that came in from outside."""
    return df.withColumn(metadata, F.map_filter(metadata, lambda k, _: ~k.startswith(prefix)))


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and one spelling per value, for comparing and hashing."""
    return F.to_json(F.try_parse_json(text))


def payload_columns(payload: Column) -> tuple[Column, Column]:
    """(text, base64): exactly one is set, the second only for bytes that are not UTF-8."""
    text = F.is_valid_utf8(payload.cast("string"))
    return F.when(text, payload.cast("string")), F.when(~text, F.base64(payload))


def envelope_json(df: DataFrame, encoding: str = "normal") -> Column:
    """One envelope per row as JSON text.

    ``json`` nests the payload document; ``normal`` and ``text`` carry it as a string, and
    ``normal`` moves bytes that are not UTF-8 into ``payload_base64``.
    """
    if encoding == "json":
        doc = F.try_parse_json(F.col("payload").cast("string"))
        body = F.coalesce(doc, F.col("payload").cast("string").cast("variant"))
        return F.to_json(F.struct("message_id", body.alias("payload"), "metadata"))
    if encoding == "text":
        return F.to_json(F.struct("message_id", F.col("payload").cast("string").alias("payload"), "metadata"))
    if encoding != "normal":
        raise ValueError(f"unknown envelope encoding {encoding}")
    kinds = dict(df.dtypes)
    if kinds["payload"] == "binary":
        text, coded = payload_columns(F.col("payload"))
        return F.to_json(
            F.struct("message_id", text.alias("payload"), coded.alias("payload_base64"), "metadata")
        )
    return F.to_json(F.struct("message_id", "payload", "metadata"))
