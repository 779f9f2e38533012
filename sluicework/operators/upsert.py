"""Upserts, insert conflicts and change application over keyed tables.

Batches are collapsed to one row per key by a partial aggregate before any join, and targets
are unique by key, so no join here meets a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.operators.dedup import first_per_key, latest_per_key


def _names(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _absent(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key the target lacks.

    The target is first reduced to the keys of the source.  When the source is small enough
    for Spark to broadcast, a large target is only scanned and never shuffled.
    """
    hits = target.select(keys).join(source.select(keys), keys, "left_semi")
    return source.join(hits, keys, "left_anti").select(source.columns)


def upsert(
    target: DataFrame,
    source: DataFrame,
    key: str | Sequence[str],
    mode: str = "update",
    order: Sequence[str] = (),
    version: Sequence[str] = (),
) -> DataFrame:
    """The target after a batch.

    ``ignore``: a key that exists is skipped, the first new row of a key by ``order`` wins.
    ``update``: the last row of a key by ``order`` wins.  With ``version`` a row only wins
    when its version is greater than the stored one; an absent stored version is the floor.
    """
    keys, columns = _names(key), target.columns
    if mode == "ignore":
        first = first_per_key(source, keys, order).select(columns)
        return target.unionByName(_absent(first, target, keys))
    if mode != "update":
        raise ValueError(f"mode must be ignore or update, not {mode}")
    if not version:
        last = latest_per_key(source, keys, order).select(columns)
        return target.join(last.select(keys), keys, "left_anti").select(columns).unionByName(last)
    filled = {f"_v{i}": F.coalesce(F.col(v), F.lit(0)) for i, v in enumerate(version)}
    newest = latest_per_key(source.withColumns(filled), keys, [*filled, *order]).select(columns)

    def at(side: str) -> Column:
        return F.struct(*[F.coalesce(F.col(f"{side}.{v}"), F.lit(0)).alias(v) for v in version])

    new = newest.select(F.struct("*").alias("s"), *keys)
    paired = target.select(F.struct("*").alias("t"), *keys).join(new, keys, "left")
    wins = F.col("s").isNotNull() & (at("s") > at("t"))
    stored = paired.select(F.when(wins, F.col("s")).otherwise(F.col("t")).alias("r"))
    return stored.select("r.*").unionByName(_absent(newest, target, keys))


def collapse(df: DataFrame, key: str | Sequence[str], version: Sequence[str]) -> DataFrame:
    """Keep the greatest version of each sort key, as a replacing table does at read."""
    return latest_per_key(df, _names(key), version)


def require_key(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the key, rejected rows with a reason)."""
    rejects = df.where(F.col(key).isNull()).withColumn("error", F.lit(f"$.{key} [missing_required]: no key"))
    return df.where(F.col(key).isNotNull()), rejects


def _insertable(target: DataFrame, source: DataFrame, keys: list[str], order: Sequence[str]) -> DataFrame:
    """First source row of every key the target lacks."""
    return _absent(first_per_key(source, keys, order), target, keys).select(source.columns)


def insert_strict(
    target: DataFrame, source: DataFrame, key: str | Sequence[str], row_id: str
) -> tuple[DataFrame, DataFrame]:
    """(new rows, conflicting rows): a plain insert fails on every row whose key is taken.

    ``row_id`` is unique per source row and orders the batch.
    """
    new = _insertable(target, source, _names(key), [row_id])
    rejects = source.join(new.select(row_id), row_id, "left_anti").select(source.columns)
    return new, rejects.withColumn("error", F.lit("duplicate key"))


def tag_outcome(
    source: DataFrame, target: DataFrame, key: str | Sequence[str], row_id: str, column: str = "outcome"
) -> DataFrame:
    """Tag each row ``inserted`` or ``existed`` as an insert-if-absent would report it."""
    new = _insertable(target, source, _names(key), [row_id]).select(row_id, F.lit("inserted").alias(column))
    tagged = source.join(new, row_id, "left")
    return tagged.select(*source.columns, F.coalesce(F.col(column), F.lit("existed")).alias(column))


def apply_changes(
    target: DataFrame,
    changes: DataFrame,
    key: str | Sequence[str],
    op: str = "op",
    order: Sequence[str] = ("lsn", "ordinal"),
) -> DataFrame:
    """The current table after a change feed: insert, update, replace, delete, truncate.

    Only the last change of a key counts.  A truncate removes every row written before its
    position, whatever the key.  ``order`` must be total per key.
    """
    keys = _names(key)
    position = F.struct(*order)
    rows = changes.where(F.col(op) != "truncate")
    wiped = changes.where(F.col(op) == "truncate").agg(F.max(position).alias("p")).scalar()
    last = latest_per_key(rows.withColumn("_p", position), keys, ["_p"])
    alive = (F.col(op) != "delete") & F.coalesce(F.col("_p") > wiped, F.lit(True))
    last = last.withColumn("_alive", alive)
    columns = target.columns
    kept = target.join(last.select(keys), keys, "left_anti").where(wiped.isNull())
    return kept.select(columns).unionByName(last.where("_alive").select(columns))


def change_log(changes: DataFrame, row_columns: Sequence[str], op: str = "op") -> DataFrame:
    """Each change as one envelope: the row as payload, operation and position as metadata."""
    return changes.select(
        F.to_json(F.struct(*row_columns)).alias("payload"),
        F.create_map(
            F.lit("operation"), F.col(op), F.lit("lsn"), F.col("lsn").cast("string"),
            F.lit("ordinal"), F.col("ordinal").cast("string"),
        ).alias("metadata"),
    )
