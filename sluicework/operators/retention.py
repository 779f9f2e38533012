"""Keep-last, stream caps and expiry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicework.operators.segments import positions, same_keys, small
from sluicework.operators.selection import cap_by_selection
from sluicework.session import cut_lineage

# Up to this many rows per key Spark drops the rest before the shuffle (its group limit).
GROUP_LIMIT = 1000


def keep_last(df: DataFrame, n: int, route: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest ``n`` rows per route, with ``rank`` 1 for the newest.

    For a small ``n`` every task first keeps its own newest ``n`` per route, so a busy route
    ships little.  A large ``n`` uses positions in a range sort instead of one window per route.
    """
    keys = [route] if isinstance(route, str) else list(route)
    if n <= GROUP_LIMIT:
        newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        ranked = df.withColumn("rank", F.row_number().over(newest))
        return ranked.where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("bigint"))
    placed = positions(df, [*map(F.col, keys), *map(F.col, order)])
    last = placed.groupBy(*keys).agg(F.max("_g").alias("_last"))
    last = cut_lineage(last.select(*[F.col(k).alias(f"l_{k}") for k in keys], "_last"))
    ranked = placed.join(small(last), same_keys(keys, "l"))
    ranked = ranked.withColumn("rank", F.col("_last") - F.col("_g") + 1)
    return ranked.where(F.col("rank") <= n).select(*df.columns, "rank")


def cap_stream(df: DataFrame, stream: str, n: int, order: Sequence[str]) -> DataFrame:
    """A stream keeps its newest ``n`` rows.

    Beyond Spark's group limit, and where the order columns are numbers, dates or times, the
    boundary of each stream is selected from histograms and the rest is a filter: no row is sorted.
    """
    orderable = ("tinyint", "smallint", "int", "bigint", "double", "float", "date", "timestamp", "timestamp_ntz")
    if n > GROUP_LIMIT and all(df.schema[c].dataType.simpleString() in orderable for c in order):
        return cap_by_selection(df, stream, n, order)
    return keep_last(df, n, stream, order).drop("rank")


def expire_rows(df: DataFrame, ts: str, ttl_seconds: float, now: Column) -> DataFrame:
    """Drop rows older than the limit; a plain comparison on the time column, so it is pushed down."""
    micros = round(ttl_seconds * 1_000_000)
    return df.where(F.col(ts) > now - F.expr(f"make_dt_interval(0, 0, 0, {micros / 1_000_000})"))
