"""Payload kinds and credential masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What makes a payload XML or binary.
XML_DECLARATION = r"(?i)^<\?xml[\s?>]"
XML_ELEMENT = r"(?s)^<[A-Za-z_][\w:.-]*(\s[^>]*)?>.*</[A-Za-z_][\w:.-]*>$"
XML_EMPTY = r"(?s)^<[A-Za-z_][\w:.-]*(\s[^>]*)?/>$"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

# Query parts that hold a secret.
SECRET_WORDS = ["password", "passphrase", "secret", "token", "credential"]
SECRET_NAMES = ["authorization", "cookie", "access_key"]
# User name and colon of an authority, the password, and the host part from the last "@".
AUTHORITY_PASSWORD = r"^(.*?://[^:/#]*):[^/#]*(@[^/#@]*)"


def is_secret(option: str) -> bool:
    """Whether an option's name says that its value is a credential."""
    name = option.lower()
    return name in SECRET_NAMES or any(word in name for word in SECRET_WORDS)


def payload_kind(text: Column) -> Column:
    """``json``, ``xml``, ``hex`` (binary) or ``text``."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    braced = (body.startswith("{") & body.endswith("}")) | (body.startswith("[") & body.endswith("]"))
    xml = body.rlike(XML_DECLARATION) & body.endswith(">") | body.rlike(XML_ELEMENT) | body.rlike(XML_EMPTY)
    return (
        F.when(braced & F.try_parse_json(body).isNotNull(), "json")
        .when(xml, "xml")
        .when(text.rlike(CONTROL), "hex")
        .otherwise("text")
    )


def payload_profile(df: DataFrame, column: str) -> DataFrame:
    """Rows and bytes per payload kind."""
    return df.groupBy(payload_kind(F.col(column)).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("bytes")
    )


def _mask_pair(pair: Column, parent: Column) -> Column:
    name = F.lower(F.split_part(pair, F.lit("="), F.lit(1)))
    secret = name.isin(SECRET_NAMES) | name.rlike("|".join(SECRET_WORDS))
    secret = secret | ((name == "key") & (parent == "encryption")) | (parent == "decrypt_keys")
    return F.when(secret & pair.contains("="), F.regexp_replace(pair, r"(?s)=.*$", "=***")).otherwise(pair)


def _mask_segment(segment: Column) -> Column:
    head = F.regexp_extract(segment, r"(?s)^([^?]*)", 1)
    query = F.regexp_extract(segment, r"(?s)^[^?]*\?(.*)$", 1)
    parent = F.when(head.contains("://"), F.lit("")).otherwise(head)
    masked = F.regexp_replace(head, AUTHORITY_PASSWORD, r"$1:***$2")
    pairs = F.transform(F.split(query, "&"), lambda p: _mask_pair(p, parent))
    return F.when(segment.contains("?"), F.concat(masked, F.lit("?"), F.array_join(pairs, "&"))).otherwise(masked)


def mask_text(uri: Column) -> Column:
    """A URI with its password and secret query values as ``***``; field names stay."""
    return F.array_join(F.transform(F.split(uri, r"\|"), _mask_segment), "|")


def mask_credentials(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, mask_text(F.col(column)))
