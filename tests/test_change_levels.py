"""The levelled change log: runs per level, replays after compaction, key ranges, truncates."""

from pyspark.sql import functions as F

from sluicework.operators.upsert import apply_changes
from sluicework.streaming import change_levels

SCHEMA = "op string, key long, amount double, lsn long, ordinal long"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def as_set(df):
    return sorted(tuple(r) for r in df.select("key", "amount", "lsn").collect())


def test_runs_stay_few_and_replays_land_nothing(spark, work):
    path = f"{work}/log"
    base = spark.createDataFrame([(k, 0.0, 0, 0) for k in range(0, 40, 2)], "key long, amount double, lsn long, ordinal long")
    everything = []
    for b in range(20):
        rows = [("update" if (b + k) % 5 else "delete", k, float(b * 100 + k), b * 100 + k, 0) for k in range(b % 7, 40, 3)]
        everything += rows
        assert change_levels.land_batch(batch(spark, rows), b, path, "key", fanout=3)
        _, found = change_levels.levels(spark, path)
        per_level = {}
        for r in found["runs"]:
            per_level[r["level"]] = per_level.get(r["level"], 0) + 1
        # At most fanout - 1 runs a level: the runs read grow with the logarithm of the batches.
        assert all(n < 3 for n in per_level.values()) and len(found["runs"]) <= 2 * 3
    expected = as_set(apply_changes(base, batch(spark, everything), "key"))
    assert as_set(change_levels.read_levelled(spark, path, base, "key")) == expected
    # Batch 4 was folded into a level-1 run long ago: a replay lands nothing.
    assert not change_levels.land_batch(batch(spark, [("update", 1, -1.0, 10**9, 0)]), 4, path, "key", fanout=3)
    assert as_set(change_levels.read_levelled(spark, path, base, "key")) == expected
    # Retired folders are gone.
    import os

    live = {r["folder"] for r in change_levels.levels(spark, path)[1]["runs"]}
    assert {os.path.join(f"{path}/runs", d) for d in os.listdir(f"{path}/runs")} == live


def test_key_ranges_and_truncates(spark, work):
    path = f"{work}/log"
    base = spark.createDataFrame([(k, 0.0, 0, 0) for k in range(10)], "key long, amount double, lsn long, ordinal long")
    change_levels.land_batch(batch(spark, [("update", k, 1.0, 10 + k, 0) for k in range(0, 5)]), 0, path, "key")
    change_levels.land_batch(batch(spark, [("update", k, 2.0, 20 + k, 0) for k in range(50, 55)]), 1, path, "key")
    whole = change_levels.read_levelled(spark, path, base, "key")
    low = change_levels.read_levelled(spark, path, base, "key", low=0, high=5)
    assert as_set(low) == as_set(whole.where("key between 0 and 5"))
    change_levels.land_batch(batch(spark, [("truncate", None, None, 100, 0), ("insert", 51, 3.0, 101, 0)]), 2, path, "key")
    assert as_set(change_levels.read_levelled(spark, path, base, "key", low=0, high=5)) == []
    assert as_set(change_levels.read_levelled(spark, path, base, "key")) == [(51, 3.0, 101)]
    empty = spark.createDataFrame([], SCHEMA)
    assert change_levels.land_batch(empty, 3, path, "key")
    assert as_set(change_levels.read_levelled(spark, f"{work}/none", base.where(F.lit(False)), "key")) == []
