"""Comparing outputs: record parity, exactly-once and branch accounting.

Both sides go through one grouped count with map-side combining; no join and no pairing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.operators.segments import small
from sluicework.session import cut_lineage


def _leaf(value, numeric: bool):
    """A parsed JSON value in which every number is text that tells its kind and value."""
    if isinstance(value, dict):
        return {k: _leaf(v, numeric) for k, v in value.items()}
    if isinstance(value, list):
        return [_leaf(v, numeric) for v in value]
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, str):
        return "s" + value
    if isinstance(value, float) and numeric and value.is_integer():
        value = int(value)
    return ("i" if isinstance(value, int) and not numeric else "n") + repr(value)


def comparable(text: Column, numeric: bool) -> Column:
    """JSON text with sorted keys and tagged leaves; other text and null as they are, told apart."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return "null"
            try:
                return "j" + json.dumps(_leaf(json.loads(x), numeric), sort_keys=True, separators=(",", ":"))
            except ValueError:
                return "t" + x

        return texts.map(one)

    return form(text)


def _by_value(value: Column, kind: T.DataType) -> Column:
    """A number as text of its value: whole numbers exactly (beyond 2^53 too), others as doubles."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value.cast("string")
    if isinstance(kind, T.DecimalType):
        whole = value == F.floor(value)
        return F.when(whole, F.floor(value).cast("string")).otherwise(value.cast("double").cast("string"))
    double = value.cast("double")
    whole = (double == F.floor(double)) & (F.abs(double) < F.lit(9.2e18))
    return F.when(whole, double.cast("long").cast("string")).otherwise(double.cast("string"))


def record_form(df: DataFrame, column: str | None = None, numeric: bool = False) -> Column:
    """A row (or one JSON text column) as text to show, independent of key order."""
    if column is None:
        kinds = {f.name: f.dataType for f in df.schema}
        members = [
            _by_value(F.col(c), kinds[c]).alias(c) if numeric and isinstance(kinds[c], T.NumericType) else F.col(c)
            for c in sorted(df.columns)
        ]
        return F.to_json(F.struct(*members), {"ignoreNullFields": "false"})
    return F.coalesce(F.to_json(F.try_parse_json(column)), F.col(column))


def _differences(left: DataFrame, right: DataFrame, weight: int = 1) -> DataFrame:
    """Rows of (record, side) frames whose counts differ (left counted ``weight`` times)."""
    both = left.select("record", F.lit(weight).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select("record", F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    counted = both.groupBy("record").agg(F.sum("l").alias("expected_n"), F.sum("r").alias("actual_n"))
    return counted.where(F.col("expected_n") != F.col("actual_n"))


#: Buckets of the first comparison: sums of digests per bucket and side.
BUCKETS = 4096
#: Rows whose texts are longer on average are counted by digest, and texts fetched for those that differ.
WIDE = 256


def _sketch(records: DataFrame) -> DataFrame:
    """Per bucket: records, their texts' length, and the sums of the halves of two 64-bit digests."""
    halves = {
        f"s{i}{name}": F.sum(half) for i in (1, 2)
        for name, half in (("a", F.col(f"h{i}").bitwiseAND(F.lit(0xFFFFFFFF))), ("b", F.shiftrightunsigned(f"h{i}", 32)))
    }
    return records.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("width").alias("width"), *[total.alias(c) for c, total in halves.items()],
    )


def parity(left: DataFrame, right: DataFrame, column: str | None = None, numeric: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Records whose number differs between two outputs; empty means the same records.

    Types count: ``7.0`` differs from ``7``, but not from ``70e-1``; with ``numeric`` all three are
    equal, and whole numbers are compared exactly at any size.  A null record is a record, and
    differs from an empty one.
    First each side is summed per bucket of records (count and two 64-bit digests): only
    ``buckets`` rows a task are shuffled, and equal outputs stop there. Records are counted only
    in buckets whose sums differ: short rows by their text, in one shuffle; long ones and those of
    a ``column`` by digest, and their texts are fetched by the digests that did.
    """
    texts = [df.select(record_form(df, column, numeric).alias("text"), *([F.col(column).alias("own")] if column else [])) for df in (left, right)]
    keyed = [t.select((F.md5(comparable(F.col("own"), numeric)) if column else F.col("text")).alias("record"), "text") for t in texts]
    digests = [
        k.select("record", F.coalesce(F.length("text"), F.lit(0)).alias("width"),
                 F.xxhash64(F.lit(1), "record").alias("h1"), F.xxhash64(F.lit(2), "record").alias("h2"))
        .withColumn("bucket", F.pmod("h1", F.lit(buckets)))
        for k in keyed
    ]
    sketches = [_sketch(d) for d in digests]
    joined = sketches[0].alias("a").join(sketches[1].alias("b"), "bucket", "full_outer")
    same = reduce(Column.__and__, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("n", "s1a", "s1b", "s2a", "s2b")])
    size = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit(0)) + F.coalesce(F.col(f"b.{c}"), F.lit(0))
    differing = joined.where(~F.coalesce(same, F.lit(False))).select("bucket", size("n").alias("n"), size("width").alias("width"))
    differing = cut_lineage(differing)
    total = differing.agg(F.sum("n").alias("n"), F.sum("width").alias("width")).first()
    empty = keyed[0].select("record").where(F.lit(False))
    if not total["n"]:
        found = _differences(empty, empty)
        return found.select("record", F.col("expected_n").alias("left_n"), F.col("actual_n").alias("right_n"))
    opened = [d.join(small(differing.select("bucket")), "bucket", "left_semi").select("record") for d in digests]
    if column is None and total["width"] <= WIDE * total["n"]:
        found = _differences(opened[0], opened[1])
        return found.select("record", F.col("expected_n").alias("left_n"), F.col("actual_n").alias("right_n"))
    if column is None:
        keyed, opened = ([df.withColumn("record", F.md5("record")) for df in frames] for frames in (keyed, opened))
    # Counted first, so that texts are only read again when there are differences to show.
    found = cut_lineage(_differences(opened[0], opened[1]))
    if found.isEmpty():
        return found.select("record", F.col("expected_n").alias("left_n"), F.col("actual_n").alias("right_n"))
    shown = keyed[0].unionByName(keyed[1]).join(small(found.select("record")), "record", "left_semi")
    shown = shown.groupBy("record").agg(F.first("text").alias("text"))
    return found.join(shown, "record").select(
        F.col("text").alias("record"), F.col("expected_n").alias("left_n"), F.col("actual_n").alias("right_n"),
    )


def exactly_once(source: DataFrame, sink: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys lost or repeated between source and sink."""
    record = F.struct(*key)
    found = _differences(source.select(record.alias("record")), sink.select(record.alias("record")))
    problem = F.when(F.col("actual_n") < F.col("expected_n"), "lost").otherwise("repeated")
    return found.select("record.*", "expected_n", "actual_n", problem.alias("problem"))


def branch_accounting(source: DataFrame, branches: Sequence[DataFrame], copies: int, key: Sequence[str]) -> DataFrame:
    """Keys whose rows over all branches are not the source rows times ``copies``."""
    record = F.struct(*key).alias("record")
    union = reduce(DataFrame.unionByName, [b.select(record) for b in branches])
    return _differences(source.select(record), union, copies).select("record.*", "expected_n", "actual_n")
