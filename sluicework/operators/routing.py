"""Routing: switches, fanout, per-branch chains and named steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.operators.filtering import matches

Sink = Callable[[DataFrame], None]
Step = Callable[[DataFrame], DataFrame]

ROUTE = "route"


def switch_value(df: DataFrame, key: Column | str, cases: dict[str, str], default: str | None = None) -> DataFrame:
    """Add ``route`` by exact match on a value; a missing or unlisted value takes the default."""
    if not cases:
        raise ValueError("switch needs at least one case")
    value = F.col(key) if isinstance(key, str) else key
    route: Column | None = None
    for match, name in cases.items():
        route = F.when(value == match, name) if route is None else route.when(value == match, name)
    return df.withColumn(ROUTE, route.otherwise(F.lit(default)))


def switch_when(df: DataFrame, cases: list[tuple[str, str]], default: str | None = None) -> DataFrame:
    """Add ``route`` by ordered conditions in the filter language; the first match wins."""
    if not cases:
        raise ValueError("switch needs at least one condition")
    route: Column | None = None
    for expression, name in cases:
        hit = matches(df, expression)
        route = F.when(hit, name) if route is None else route.when(hit, name)
    return df.withColumn(ROUTE, route.otherwise(F.lit(default)))


def switch(df: DataFrame, key=None, cases=None, when=None, default=None) -> DataFrame:
    """Either by value or by condition; both or neither is an error before any row moves."""
    if (cases is None) == (when is None):
        raise ValueError("a switch is by value (key, cases) or by condition (when), not both")
    if cases is not None:
        if key is None:
            raise ValueError("a switch by value needs a key")
        return switch_value(df, key, cases, default)
    return switch_when(df, when, default)


def branch_rows(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(ROUTE) == name).drop(ROUTE)


def unrouted(df: DataFrame) -> DataFrame:
    """One row: how many rows no branch takes."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col(ROUTE).isNull()).alias("rows_unrouted")
    )


def write_routes(df: DataFrame, path: str) -> None:
    """All branches in one pass: a folder per route; rows without a route are left out."""
    df.where(F.col(ROUTE).isNotNull()).write.partitionBy(ROUTE).mode("append").parquet(path)


def branch(steps: list[Step], sink: Sink) -> Sink:
    """A branch with its own chain before its sink."""

    def run(df: DataFrame) -> None:
        for step in steps:
            df = df.transform(step)
        sink(df)

    return run


@dataclass
class FanoutReport:
    delivered: list[str] = field(default_factory=list)
    mirror_errors: dict[str, str] = field(default_factory=dict)


def fanout(
    df: DataFrame, sinks: dict[str, Sink], mirrors: dict[str, Sink] | None = None, reuse: bool = True
) -> FanoutReport:
    """Every sink gets every row.  A failing mirror is recorded and stops nothing.

    ``reuse`` keeps the rows (memory, then disk) so that the source is read once.
    """
    report = FanoutReport()
    shared = df.persist(StorageLevel.MEMORY_AND_DISK) if reuse else df
    try:
        for name, sink in sinks.items():
            sink(shared)
            report.delivered.append(name)
        for name, sink in (mirrors or {}).items():
            try:
                sink(shared)
                report.delivered.append(name)
            except Exception as error:  # a mirror may fail in any way
                report.mirror_errors[name] = str(error)
    finally:
        if reuse:
            shared.unpersist()
    return report


def switch_sink(route: Step, sinks: dict[str, Sink]) -> Sink:
    """A switch as a sink, to nest inside a fanout or another switch."""

    def run(df: DataFrame) -> None:
        routed = route(df)
        for name, sink in sinks.items():
            sink(branch_rows(routed, name))

    return run


_NAMED: dict[str, Sink] = {}
_STEPS: dict[str, Step] = {}


def register_named(name: str, sink: Sink) -> None:
    """Keep a chain and sink under a name, to be used as a branch elsewhere."""
    if name in _NAMED:
        raise ValueError(f"named branch {name} exists")
    _NAMED[name] = sink


def named(name: str) -> Sink:
    if name not in _NAMED:
        raise ValueError(f"unknown named branch {name}")
    return _NAMED[name]


def register_step(name: str, step: Step) -> None:
    """Keep a DataFrame step under a name, for routes written as data."""
    if name in _STEPS:
        raise ValueError(f"step {name} exists")
    _STEPS[name] = step


def step(name: str) -> Step:
    if name not in _STEPS:
        raise ValueError(f"unknown step {name}")
    return _STEPS[name]


def enrich(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Call a batch function; what it returns (response, status) replaces the rows, to route on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def enrich_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], metadata: str = "metadata", prefix: str = "enrich.") -> DataFrame:
    """Call a batch function and keep the rows: each column it returns (one row out per row in, in
    order; response, status, ...) is added as text to the row's metadata under ``prefix``, so the
    input columns stay and routes can switch on ``metadata['enrich.status']``.

    A function that returns another number of rows than it was given fails the job.
    """
    out_schema = T.StructType([f for f in df.schema if f.name != metadata] + [T.StructField(metadata, T.MapType(T.StringType(), T.StringType()))])
    has_metadata = metadata in df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answered = fn(batch)
            if len(answered) != len(batch):
                raise ValueError(f"the enrichment returned {len(answered)} rows for {len(batch)}")
            answers = answered.reset_index(drop=True).astype(object).where(answered.notna(), None)
            known = batch[metadata].tolist() if has_metadata else [None] * len(batch)
            merged = []
            for i, before in enumerate(known):
                row = dict(before or {})
                row.update({f"{prefix}{c}": (None if answers.at[i, c] is None else str(answers.at[i, c])) for c in answers.columns})
                merged.append(row)
            kept = batch.drop(columns=[metadata]) if has_metadata else batch
            yield kept.reset_index(drop=True).assign(**{metadata: merged})

    return df.mapInPandas(run, out_schema)
