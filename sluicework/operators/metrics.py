"""Run metrics as aggregates.  Ordered rules work on chunks of consecutive positions, so a route
with very many samples is not one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicework.operators.segments import same_keys, small, order_value, positions
from sluicework.operators.selection import exact_quantiles
from sluicework.session import cut_lineage

# The sampling tick and the smoothing time constant, in seconds.
TICK_SECONDS = 0.2
TAU_SECONDS = 0.5

# Consecutive positions folded together.
CHUNK = 512


def run_counts(df: DataFrame, id_col: str) -> DataFrame:
    """Rows read, and rows delivered when a redelivered id counts once."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_read"), F.countDistinct(id_col).alias("rows_delivered")
    ).withColumn("redelivered", F.col("rows_read") - F.col("rows_delivered"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (later - earlier) / 1_000_000.0


def throughput(df: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, elapsed seconds and whole rows per second (0 when no time passed)."""
    at = order_value(df, ts)
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), seconds_between(F.max(at), F.min(at)).alias("elapsed_s")
    )
    rate = F.when(F.col("elapsed_s") > 0, F.round(F.col("rows") / F.col("elapsed_s"))).otherwise(0.0)
    return counted.withColumn("rows_per_second", rate.cast("bigint"))


def tick_counts(df: DataFrame, ts: str, tick: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per fixed tick."""
    counted = df.groupBy(*keys, F.window(ts, tick).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.col("w.start").alias("tick"), "n")


def _linked(df: DataFrame, route: str, ts: str, value: str) -> DataFrame:
    """Samples in one global (route, time) order with the sample before each, as ``_prev``.

    Work is cut into chunks of consecutive positions, so its size does not follow the route.
    Looks back inside a chunk, and across chunks through one row per chunk.
    """
    timed = df.withColumn("_at", order_value(df, ts))
    placed = positions(timed, [F.col(route), F.col("_at"), F.col(value)])
    chunked = placed.withColumn("_chunk", F.expr(f"_g div {CHUNK}"))
    sample = F.struct(F.col(route).alias("route"), F.col("_at").alias("at"), F.col(value).alias("value"))
    tails = chunked.groupBy("_chunk").agg(F.max_by(sample, "_g").alias("_carried"))
    tails = tails.withColumn("_chunk", F.col("_chunk") + 1)
    inside = Window.partitionBy("_chunk").orderBy("_g")
    seen = F.coalesce(F.lag(sample).over(inside), F.col("_carried"))
    linked = chunked.join(tails, "_chunk", "left").withColumn("_prev", seen)
    same = F.col("_prev.route").eqNullSafe(F.col(route))
    return linked.withColumn("_prev", F.when(same, F.col("_prev"))).drop("_carried")


def linear_scan(steps: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """``x[g] = decay * x[g-1] + gain`` over positions ``_g``, as column ``x``.

    A chunk is folded from 0; its summary is a step of the same kind, so the values entering
    the chunks come from a scan over the summaries, a 512th of the rows each time.
    """
    step = F.struct("_g", "decay", "gain", *kept)
    chunks = steps.groupBy(F.expr(f"_g div {CHUNK}").alias("_chunk")).agg(
        F.array_sort(F.collect_list(step)).alias("steps")  # at most CHUNK positions
    )
    init = F.expr("named_struct('x', 0D, 'keep', 1D, 'out', cast(array() as array<struct<x:double,keep:double>>))")

    def fold(acc: Column, s: Column) -> Column:
        x = acc["x"] * s["decay"] + s["gain"]
        keep = acc["keep"] * s["decay"]
        row = F.struct(x.alias("x"), keep.alias("keep"))
        return F.struct(x.alias("x"), keep.alias("keep"), F.array_append(acc["out"], row).alias("out"))

    folded = cut_lineage(chunks.withColumn("f", F.aggregate("steps", init, fold)))
    if folded.count() > 1:
        summary = folded.select(F.col("_chunk").alias("_g"), F.col("f.keep").alias("decay"), F.col("f.x").alias("gain"))
        entering = linear_scan(summary).select((F.col("_g") + 1).alias("_chunk"), F.col("x").alias("_entering"))
        folded = folded.join(entering, "_chunk", "left")
    else:
        folded = folded.withColumn("_entering", F.lit(0.0))
    rows = folded.select("_entering", F.explode(F.arrays_zip("steps", "f.out")).alias("z"))
    carried = F.col("z.out.keep") * F.coalesce("_entering", F.lit(0.0))
    return rows.select(
        F.col("z.steps._g").alias("_g"), *[F.col(f"z.steps.{c}").alias(c) for c in kept],
        (F.col("z.out.x") + carried).alias("x"),
    )


def ewma_rate(samples: DataFrame, route: str, ts: str, total: str, tau: float = TAU_SECONDS) -> DataFrame:
    """Smoothed rate per cumulative sample: ``alpha = 1 - exp(-dt/tau)``, first sample 0.

    A falling count gives rate 0.  The first sample of a route has decay 0, which also keeps
    the routes of one global scan apart.
    """
    linked = _linked(samples, route, ts, total)
    dt = seconds_between(F.col("_at"), F.col("_prev.at"))
    grown = F.greatest(F.col(total) - F.col("_prev.value"), F.lit(0)).cast("double")
    decay = F.when(F.col("_prev").isNull(), 0.0).when(dt > 0, F.exp(-dt / tau)).otherwise(1.0)
    gain = F.when(dt > 0, (1 - F.exp(-dt / tau)) * grown / dt).otherwise(0.0)
    steps = linked.select("_g", route, ts, total, decay.alias("decay"), gain.alias("gain"))
    return linear_scan(steps, [route, ts, total]).select(route, ts, total, F.col("x").alias("rate"))


def elapsed_and_average(samples: DataFrame, route: str, ts: str, total: str) -> DataFrame:
    """Messages, seconds from start to the last growth, and the average rate; stable when idle."""
    linked = _linked(samples, route, ts, total)
    grew = F.col("_prev").isNull() | (F.col(total) > F.col("_prev.value"))
    timed = linked.groupBy(route).agg(
        F.max_by(total, "_g").alias("messages"),
        seconds_between(F.max(F.when(grew, F.col("_at"))), F.min("_at")).alias("elapsed_s"),
    )
    average = F.when(F.col("elapsed_s") > 0, F.col("messages") / F.col("elapsed_s")).otherwise(0.0)
    return timed.withColumn("average_per_second", average)


def outcome(read: Column, delivered: Column, failed: Column) -> Column:
    """``failed``, ``completed_with_drops``, ``stopped`` (nothing read) or ``completed``."""
    return (
        F.when(failed > 0, "failed")
        .when(delivered < read, "completed_with_drops")
        .when(read == 0, "stopped")
        .otherwise("completed")
    )


def route_status(samples: DataFrame, route: str, ts: str, total: str, tau: float = TAU_SECONDS) -> DataFrame:
    """One row per route: messages, current rate, elapsed and average."""
    rates = ewma_rate(samples, route, ts, total, tau)
    now = rates.groupBy(route).agg(F.max_by("rate", F.struct(ts, total)).alias("messages_per_second"))
    now = now.withColumnRenamed(route, f"r_{route}")
    averages = elapsed_and_average(samples, route, ts, total)
    return averages.join(now, same_keys([route], "r")).drop(f"r_{route}")


def quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], keys: Sequence[str] = (), exact: bool = True
) -> DataFrame:
    """Quantiles per key, one row per (key, p).

    Exact ones are found by radix selection on the ordered bits of the values (``selection``):
    counts only are shuffled, no row is sorted, so neither a hot key nor a hot value is gathered;
    ``exact=False`` uses a mergeable sketch.
    """
    keys = list(keys)
    if exact:
        return exact_quantiles(df, value, probabilities, keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", [float(p) for p in probabilities], 100_000).alias("q")
    )
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probabilities]).alias("p"), F.col("q").alias("v"))
    return sketch.select(*keys, F.inline(pairs))


def latency_quantiles(df: DataFrame, column: str, keys: Sequence[str] = (), exact: bool = True) -> DataFrame:
    return quantiles(df, column, (0.5, 0.95, 0.99), keys, exact)


def totals(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("messages"))


def rejection_summary(rejects: DataFrame) -> DataFrame:
    """Rejected rows per path and code."""
    return rejects.groupBy("path", "code").agg(F.count(F.lit(1)).alias("n"))


def run_stats(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Median and population standard deviation."""
    keys = list(keys)
    spread = df.groupBy(*keys).agg(F.stddev_pop(column).alias("stddev"), F.count(column).alias("runs"))
    middle = quantiles(df, column, [0.5], keys).select(
        *[F.col(k).alias(f"q_{k}") for k in keys], F.col("v").alias("median")
    )
    if not keys:
        return spread.withColumn("median", middle.select("median").scalar())
    return spread.join(middle, same_keys(keys, "q")).drop(*[f"q_{k}" for k in keys])
