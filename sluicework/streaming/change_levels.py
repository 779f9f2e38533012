"""A change feed applied by a stream into a levelled log of sorted runs.

Every micro-batch lands as one run: its changes collapsed to the last one per key (and the last
truncate), sorted by key within files, with its row count and key range. A manifest
(``_levels/<version>.json``, created once per version, so one writer wins) lists the live runs and
the high-water mark: the last batch id whose changes are in them. When ``fanout`` runs share a
level they are merged, by the same collapse, into one run of the next level, and the folders they
came from are retired (deleted after the manifest that no longer names them is committed). A read
is the base with the live runs, at most ``fanout - 1`` a level, so the files read grow with the
logarithm of the batches, not with the batches. A batch id at or below the high-water mark is a
replay (a restart from a checkpoint that had not recorded it) and lands nothing.

Key ranges (of the first key column) let ``read_levelled`` skip runs for a range of keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType

from sluicework.operators.dedup import latest_per_key
from sluicework.operators.upsert import apply_changes
from sluicework.sinks.upsert_table import _commit, _fs, _read_text

LEVELS = "_levels"


def levels(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(version, manifest) of the newest complete manifest."""
    for version in reversed(_level_versions(spark, path)):
        try:
            found = json.loads(_read_text(spark, f"{path}/{LEVELS}/{version:020d}.json"))
        except ValueError:
            continue
        if found.get("complete"):
            return version, found
    return 0, {"runs": [], "through": -1, "complete": True}


def _level_versions(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _fs(spark, f"{path}/{LEVELS}")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()[:20]) for s in fs.listStatus(folder) if s.getPath().getName()[:20].isdigit())


def _collapsed(changes: DataFrame, keys: list[str], op: str, order: Sequence[str]) -> DataFrame:
    """The last change of each key and the last truncate: the same fold for landing and merging."""
    return latest_per_key(changes, [*keys, F.col(op) == "truncate"], order)


def _run(spark: SparkSession, df: DataFrame, path: str, level: int, first: int, last: int, keys: list[str], op: str) -> dict:
    folder = f"{path}/runs/{level}-{first:020d}-{last:020d}-{uuid.uuid4().hex[:8]}"
    df.sortWithinPartitions(*keys).write.parquet(folder)
    stats = spark.read.parquet(folder).agg(
        F.count(F.lit(1)).alias("n"), F.min(keys[0]).alias("low"), F.max(keys[0]).alias("high"),
        F.coalesce(F.max((F.col(op) == "truncate").cast("int")), F.lit(0)).alias("truncates"),
    ).first()
    return {"folder": folder, "level": level, "first": first, "last": last, "rows": stats.n, "truncates": bool(stats.truncates),
            "low": None if stats.low is None else str(stats.low), "high": None if stats.high is None else str(stats.high)}


def land_batch(
    batch: DataFrame, batch_id: int, path: str, key: str | Sequence[str], op: str = "op",
    order: Sequence[str] = ("lsn", "ordinal"), fanout: int = 4,
) -> bool:
    """Land one micro-batch and merge full levels; False for a replayed batch id."""
    spark, keys = batch.sparkSession, [key] if isinstance(key, str) else list(key)
    version, found = levels(spark, path)
    if batch_id <= found["through"]:
        return False
    runs = [*found["runs"], _run(spark, _collapsed(batch, keys, op, order), path, 0, batch_id, batch_id, keys, op)]
    retired = []
    level = 0
    while True:
        same = [r for r in runs if r["level"] == level]
        if not same:
            if not any(r["level"] > level for r in runs):
                break
            level += 1
            continue
        if len(same) >= fanout:
            merged = _collapsed(spark.read.parquet(*[r["folder"] for r in same]), keys, op, order)
            runs = [r for r in runs if r not in same] + [_run(spark, merged, path, level + 1, min(r["first"] for r in same), max(r["last"] for r in same), keys, op)]
            retired += [r["folder"] for r in same]
        level += 1
    runs.sort(key=lambda r: (-r["level"], r["first"]))
    _commit(spark, path, version + 1, {"runs": runs, "through": batch_id, "complete": True}, folder=LEVELS)
    for folder in retired:
        fs, location = _fs(spark, folder)
        fs.delete(location, True)
    return True


def apply_changes_levelled(
    sdf: DataFrame, path: str, key: str | Sequence[str], checkpoint: str, op: str = "op",
    order: Sequence[str] = ("lsn", "ordinal"), fanout: int = 4, **trigger,
):
    """Land a change feed by micro-batches into the levelled log at ``path``."""

    def land(batch: DataFrame, batch_id: int) -> None:
        land_batch(batch, batch_id, path, key, op, order, fanout)

    writer = sdf.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_levelled(
    spark: SparkSession, path: str, base: DataFrame, key: str | Sequence[str], op: str = "op",
    order: Sequence[str] = ("lsn", "ordinal"), low=None, high=None,
) -> DataFrame:
    """The base with every live run; with ``low``/``high`` (values of the first key column) only runs
    whose key range meets them, or that hold a truncate, are read, and rows outside are left out."""
    keys = [key] if isinstance(key, str) else list(key)
    _, found = levels(spark, path)
    runs = found["runs"]
    kind = base.schema[keys[0]].dataType

    as_value = int if isinstance(kind, IntegralType) else float if isinstance(kind, FractionalType) else str

    def meets(r) -> bool:
        # A truncate acts on every key, so its run is always read.
        if r["truncates"]:
            return True
        if r["low"] is None:
            return False
        return (low is None or as_value(r["high"]) >= low) and (high is None or as_value(r["low"]) <= high)

    if low is not None or high is not None:
        runs = [r for r in runs if meets(r)]
        inside = (F.col(keys[0]) >= F.lit(low) if low is not None else F.lit(True)) & (F.col(keys[0]) <= F.lit(high) if high is not None else F.lit(True))
        base = base.where(inside)
    if not runs:
        return base
    changes = spark.read.parquet(*[r["folder"] for r in runs])
    if low is not None or high is not None:
        changes = changes.where(inside | (F.col(op) == "truncate"))
    return apply_changes(base, changes, keys, op, order)
