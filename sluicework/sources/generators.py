"""Sources that make or name rows inside Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The pools that generated bench rows pick from.
FIRST_NAMES = [f"person{i:02d}" for i in range(16)]
COUNTRIES = [f"C{i}" for i in range(10)]
TIERS = ["basic", "plus", "team"]
TAGS = [f"tag{i}" for i in range(5)]


def static_rows(spark: SparkSession, body: str, n: int, metadata: dict[str, str] | None = None) -> DataFrame:
    """A fixed message repeated ``n`` times, as envelopes with ids 0..n-1."""
    pairs = [F.lit(x) for pair in (metadata or {}).items() for x in pair]
    notes = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    return spark.range(n).select(
        F.col("id").cast("string").alias("message_id"), F.lit(body).alias("payload"),
        notes.alias("metadata"),
    )


def _draw(seed: int, name: str, size: int) -> Column:
    """A repeatable draw from 0..size-1 per (seed, name, id), the same on every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col("id").cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % size


def _pick(values: list[str], draw: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), draw.cast("int") + 1)


def bench_rows(spark: SparkSession, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``n`` rows of seven mixed columns with ids 1..n; any slice can be made on its own."""
    ids = spark.range(1, n + 1, 1, partitions) if partitions else spark.range(1, n + 1)
    score = (_draw(seed, "score", 100_001) / 1000.0).cast("decimal(9,3)")
    tags = F.slice(
        F.array(*[F.lit(t) for t in TAGS]), _draw(seed, "tag", 3).cast("int") + 1,
        _draw(seed, "tags", 3).cast("int") + 1,
    )
    attributes = F.concat(
        F.lit('{"tier":"'), _pick(TIERS, _draw(seed, "tier", 3)), F.lit('","score":'),
        score.cast("string"), F.lit(',"tags":["'), F.array_join(tags, '","'), F.lit('"]}'),
    )
    seconds = F.lit(1577836800) + F.col("id") * 45 + _draw(seed, "second", 45)
    return ids.select(
        "id",
        _pick(FIRST_NAMES, _draw(seed, "first_name", 16)).alias("first_name"),
        _pick(COUNTRIES, _draw(seed, "country", 10)).alias("country"),
        F.round((_draw(seed, "amount", 999_901) + 100) / 100.0, 2).alias("amount"),
        F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.when(_draw(seed, "active", 2) == 1, "true").otherwise("false").alias("active"),
        attributes.alias("attributes"),
    )


def memory_sink(df: DataFrame, name: str) -> None:
    """Name a frame inside the session."""
    df.createOrReplaceTempView(name)


def memory_source(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def topic_regex(pattern: str) -> str:
    """``+`` is one level; a last ``#`` is the parent level and everything below it."""
    levels = pattern.split("/")
    if "#" in levels[:-1] or any(len(x) > 1 and ("+" in x or "#" in x) for x in levels):
        raise ValueError(f"misplaced wildcard in topic pattern {pattern}")
    if pattern == "#":
        return "^.*$"
    tail = ""
    if levels[-1] == "#":
        levels, tail = levels[:-1], "(/.*)?"
    body = "/".join("[^/]*" if x == "+" else re.escape(x) for x in levels)
    return f"^{body}{tail}$"


def where_topic(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose topic matches a wildcard pattern; plain topics stay an equality."""
    if "+" not in pattern and "#" not in pattern:
        return df.where(F.col(column) == pattern)
    return df.where(F.col(column).rlike(topic_regex(pattern)))
