"""Deduplication, change identities and log positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.operators.segments import HOT_ROWS, Bounds, segment

KeyLike = str | Column


def _key_columns(key: KeyLike | Sequence[KeyLike]) -> list[Column]:
    parts = [key] if isinstance(key, (str, Column)) else list(key)
    return [F.col(k) if isinstance(k, str) else k for k in parts]


def first_per_key(df: DataFrame, key: KeyLike | Sequence[KeyLike], order: Sequence[str]) -> DataFrame:
    """The earliest row of each key, by a partial aggregate: a busy key sends one row per task."""
    columns = [c.alias(f"_k{i}") for i, c in enumerate(_key_columns(key))]
    kept = F.min_by(F.struct("*"), F.struct(*order)).alias("r")
    return df.groupBy(*columns).agg(kept).select("r.*")


def latest_per_key(df: DataFrame, key: KeyLike | Sequence[KeyLike], order: Sequence[str]) -> DataFrame:
    """The newest row of each key, by a partial aggregate."""
    columns = [c.alias(f"_k{i}") for i, c in enumerate(_key_columns(key))]
    kept = F.max_by(F.struct("*"), F.struct(*order)).alias("r")
    return df.groupBy(*columns).agg(kept).select("r.*")


def dedup(df: DataFrame, key: KeyLike | Sequence[KeyLike], order: Sequence[str]) -> DataFrame:
    """First row of each key wins; the key may be columns, an expression or a template.

    ``order`` must be total for the result to be repeatable. A row whose expression or template
    key is null (a template field it lacks) has no key and passes: it is no repeat of anything.
    """
    if isinstance(key, Column):
        marked = df.withColumn("_dedup_key", key)
        keyed = first_per_key(marked.where(F.col("_dedup_key").isNotNull()), F.col("_dedup_key"), order)
        return keyed.unionByName(marked.where(F.col("_dedup_key").isNull())).drop("_dedup_key")
    return first_per_key(df, key, order)


def key_template(template: str) -> Column:
    """A key from a template such as ``${payload:user_id}-${metadata:kind}``; null where a row
    lacks one of its fields, so that such rows are not taken for repeats of each other."""
    pieces: list[Column] = []
    rest = template
    while "${" in rest:
        before, _, after = rest.partition("${")
        token, _, rest = after.partition("}")
        space, _, name = token.partition(":")
        if before:
            pieces.append(F.lit(before))
        if space == "payload":
            pieces.append(F.get_json_object(F.col("payload").cast("string"), f"$.{name}"))
        elif space == "metadata":
            pieces.append(F.col("metadata")[name])
        elif space == "message_id":
            pieces.append(F.col("message_id"))
        else:
            raise ValueError(f"unknown template token ${{{token}}}")
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


def dedup_ttl(
    df: DataFrame, key: str | Sequence[str], ts: str, tie: str, ttl_seconds: float, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Drop a row seen less than ``ttl_seconds`` after the last *accepted* row of its key.

    The window is fixed: a dropped row does not extend it.
    """
    keys = [key] if isinstance(key, str) else list(key)
    runs = segment(df, keys, ts, tie, Bounds(max_span=round(ttl_seconds * 1_000_000)), hot_rows=hot_rows)
    return runs.where("run_start").select(df.columns)


def change_id(table: str | Column, key: Column, op: Column, lsn: Column, ordinal: Column) -> Column:
    """A stable identity of one change: the same after a replay, distinct within a transaction.

    Every part is written with its length (``3:abc``) and a null as ``-``, so no separator inside a
    part and no empty text can make two changes one.
    """
    name = F.lit(table) if isinstance(table, str) else table

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat_ws("|", *[part(c) for c in (name, key, op, lsn, ordinal)]), 256)


def lsn_to_bigint(lsn: Column) -> Column:
    """``hi/lo`` in hex as one number, since text order of positions is wrong.

    Positions fill 64 unsigned bits, so the number is a DECIMAL(20,0): from ``80000000/0`` on a
    long would turn negative and sort first.
    """
    half = F.split(lsn, "/")
    high = F.conv(half[0], 16, 10).cast("decimal(20,0)")
    low = F.conv(half[1], 16, 10).cast("decimal(20,0)")
    return (high * F.lit(1 << 32).cast("decimal(20,0)") + low).cast("decimal(20,0)")


def bigint_to_lsn(value: Column) -> Column:
    """A position (a long, or a DECIMAL(20,0) up to 2^64 - 1) as ``hi/lo`` in hex."""
    whole = value.cast("decimal(20,0)")
    span = F.lit(1 << 32).cast("decimal(20,0)")
    high = F.conv(F.floor(whole / span).cast("string"), 10, 16)
    low = F.conv(F.pmod(whole, span).cast("string"), 10, 16)
    return F.concat_ws("/", high, low)
