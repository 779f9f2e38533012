"""The copy job: one source to one sink, with filter, steps, resume and a report."""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import logging
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluicework.functions.texts import is_secret
from sluicework.operators import dedup as dedup_ops
from sluicework.operators import routing, shaping
from sluicework.operators.correlate import correlate
from sluicework.operators.filtering import filter_rows
from sluicework.operators.selection import values_at
from sluicework.session import path_exists, shared_dir, staging_path
from sluicework.sinks import files as file_sinks
from sluicework.sinks import branches as branch_sinks
from sluicework.sinks import upsert_table
from sluicework.sinks.records import kafka_sink
from sluicework.sources import files as file_sources
from sluicework.sources import tables
from sluicework.streaming.filestream import group_checkpoint, stream_file, stream_files

log = logging.getLogger("sluicework")

ENVELOPES = ("json", "normal", "text")
STREAMS = ("growing_file", "folder")
IDEMPOTENT_SINKS = ("upsert", "idempotent")


# --- identity and positions -----------------------------------------------------------------


def _facts(value: Any, path: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(path, text) of everything a definition states, without credentials and unset options."""
    if value is None or any(is_secret(name) for name in path):
        return []
    if isinstance(value, dict):
        return [fact for name, inner in value.items() for fact in _facts(inner, (*path, str(name)))]
    if isinstance(value, (list, tuple)):
        return [fact for i, inner in enumerate(value) for fact in _facts(inner, (*path, str(i)))]
    text = value
    if isinstance(value, str) and "://" in value:
        address = urlsplit(value)
        text = address._replace(netloc=address.netloc.rpartition("@")[2]).geturl()
    return [("/".join(path), json.dumps(text, default=str))]


def copy_identity(source: dict, sink: dict, filter: str | None = None) -> str:
    """``copy-<32 hex>`` over what the job means."""
    stated = sorted(_facts({"source": source, "sink": sink, "filter": filter}))
    digest = hashlib.sha256(json.dumps(stated).encode()).hexdigest()
    return f"copy-{digest[:32]}"


def resume_kind(source: dict) -> str:
    """How a source resumes, or a refusal before anything starts."""
    kind = source.get("kind")
    if kind in STREAMS or kind == "kafka":
        return "native"
    if source.get("cursor_column"):
        return "cursor"
    if kind == "objects":
        return "external"
    raise ValueError(f"a {kind} source cannot resume: it has no durable position; add cursor_column")


def delivery_label(source: dict, sink: dict) -> str:
    """Reported, not enforced: a stable source identity and an idempotent write."""
    stable = source.get("kind") in (*STREAMS, "kafka", "table", "objects") or bool(source.get("cursor_column"))
    return "effectively-once" if stable and sink.get("kind") in IDEMPOTENT_SINKS else "at-least-once"


class PositionStore:
    """Positions by id in an append-only table; several jobs may share one."""

    SCHEMA = "value string, kind string, seq long, token string, id_hash string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def _hash(identity: str) -> str:
        return hashlib.sha256(identity.encode()).hexdigest()[:16]

    def get(self, identity: str) -> Any | None:
        """The last stored value; one folder per id, so other jobs' rows are not read."""
        folder = f"{self.path}/id_hash={self._hash(identity)}"
        if not path_exists(self.spark, folder):
            return None
        rows = self.spark.read.schema("value string, kind string, seq long, token string").parquet(folder)
        row = rows.agg(F.max_by(F.struct("value", "kind"), F.struct("seq", "token")).alias("r")).first()["r"]
        if row is None:
            return None
        return int(row["value"]) if row["kind"] == "int" else row["value"]

    def put(self, identity: str, *values: Any) -> None:
        """Store positions in the order they were reached, in one write."""
        rows, now = [], time.time_ns()
        for i, value in enumerate(values):
            if isinstance(value, bool) or not isinstance(value, (int, str)):
                raise ValueError("a position is an integer or text")
            kind = "int" if isinstance(value, int) else "text"
            rows.append((str(value), kind, now + i, uuid.uuid4().hex, self._hash(identity)))
        frame = self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1)
        frame.write.mode("append").partitionBy("id_hash").parquet(self.path)


#: Cursor types whose values a position can hold; others are refused before anything is read.
CURSOR_KINDS = ("tinyint", "smallint", "int", "bigint", "string")


def check_cursor_type(df: DataFrame, cursor: str) -> None:
    kind = df.schema[cursor].dataType.simpleString()
    if kind not in CURSOR_KINDS:
        raise ValueError(f"a cursor of type {kind} cannot be stored; cast {cursor} to bigint or string")


class LossyCopy(Exception):
    """Rows were rejected and had nowhere to go."""


class Rejecting:
    """A step that may reject rows: ``split`` gives (good, rejects); ``sink`` takes the rejects.

    Without a sink a rejected row makes the copy fail, with the count, and no position is stored.
    """

    def __init__(self, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], sink: dict | None = None):
        self.split, self.sink = split, sink


def safe_position(results: DataFrame, cursor: str, ok: str) -> DataFrame:
    """The furthest position before the first failed row."""
    first_failed = F.min(F.when(~F.col(ok), F.col(cursor)))
    bound = results.agg(first_failed.alias("f")).scalar()
    return results.where(bound.isNull() | (F.col(cursor) < bound)).agg(F.max(cursor).alias("position"))


def check_cursor(df: DataFrame, cursor: str, last: Any | None) -> DataFrame:
    """One row: range of the new rows, the largest group of equal values, and whether all lie
    after the stored position."""
    groups = df.groupBy(cursor).agg(F.count(F.lit(1)).alias("n"))
    after = F.lit(True) if last is None else F.coalesce(F.min(cursor) > F.lit(last), F.lit(True))
    return groups.agg(
        F.min(cursor).alias("first"), F.max(cursor).alias("last"), F.max("n").alias("largest_group"),
        after.alias("monotonic"),
    )


# --- endpoints ------------------------------------------------------------------------------


def open_source(spark: SparkSession, source: dict) -> DataFrame:
    kind, path = source["kind"], source.get("path")
    codec = source.get("compression", "none")
    if kind == "csv":
        return file_sources.read_csv(spark, path, source.get("columns"), source.get("splittable", False), codec)
    if kind == "raw":
        return file_sources.read_raw(spark, path, source.get("delimiter", "\n"), codec)
    if kind in ENVELOPES:
        return file_sources.read_envelope(spark, path, kind, codec)
    if kind == "table":
        return tables.read_table(spark, path)
    if kind == "objects":
        return file_sources.read_objects(spark, path, source.get("after_key"), source.get("max_object_bytes"))
    if kind == "jdbc":
        return tables.read_jdbc(spark, source["url"], table=source.get("table"), query=source.get("query"))
    if kind == "view":
        return spark.table(source["name"])
    if kind == "growing_file":
        return stream_file(spark, path, source.get("start", "earliest"))
    if kind == "folder":
        return stream_files(
            spark, path, source.get("cleanup", "off"), source.get("archive_dir"), source.get("max_files"),
            source.get("schema", "value string"), source.get("format", "text"),
        )
    raise ValueError(f"unknown source kind {kind}")


def open_sink(sink: dict) -> Callable[[DataFrame, str], None]:
    """A writer (rows, batch id)."""
    kind, path, codec = sink["kind"], sink.get("path"), sink.get("compression", "none")
    if kind == "null":
        return lambda df, _: file_sinks.drain(df)
    if kind == "raw":
        return lambda df, _: file_sinks.write_raw(df, path, codec)
    if kind in ENVELOPES:
        return lambda df, _: file_sinks.write_envelope(df, path, kind, codec)
    if kind == "csv":
        return lambda df, _: file_sinks.write_csv(df, path, codec)
    if kind == "table":
        return lambda df, _: file_sinks.append_table(df, path)
    if kind == "objects":
        return lambda df, _: file_sinks.write_objects(df, path, date_partition=sink.get("date_partition", True))
    if kind == "idempotent":
        return lambda df, batch: file_sinks.write_idempotent(df, path, batch)
    if kind == "branches":
        return lambda df, _: branch_sinks.write_branches(
            df, path, [tuple(c) for c in sink.get("when", ())], sink.get("default"), sink.get("every", ()), sink.get("encodings"), codec
        )
    if kind == "upsert":
        return lambda df, batch: upsert_table.upsert_into(
            df, path, sink["key"], batch, sink.get("mode", "update"), sink.get("order", ()), sink.get("version", ()), sink.get("buckets", 64)
        )
    if kind == "jdbc":
        return lambda df, _: tables.write_jdbc(df, sink["url"], sink["table"])
    if kind == "kafka":
        return lambda df, _: kafka_sink(df, sink["servers"], sink["topic"], sink.get("partition_key"), **sink.get("options", {}))
    if kind == "fanout":
        writers = [open_sink(s) for s in sink["sinks"]]

        def all_of(df: DataFrame, batch: str) -> None:
            for one in writers:
                one(df, batch)

        return all_of
    if kind == "switch":
        branches = {name: open_sink(s) for name, s in sink["sinks"].items()}
        rule = {k: sink[k] for k in ("key", "cases", "when", "default") if k in sink}

        def one_of(df: DataFrame, batch: str) -> branch_sinks.BranchReport:
            # Unrouted rows are counted on the way and reported; they are not copied.
            counts = Observation()
            routed = routing.switch(df, **rule).observe(
                counts, F.count(F.lit(1)).alias("read"), F.count_if(F.col(routing.ROUTE).isNull()).alias("unrouted"),
                *[F.count_if(F.col(routing.ROUTE) == name).alias(name) for name in branches],
            )
            for name, one in branches.items():
                one(routing.branch_rows(routed, name), batch)
            if not branches:
                file_sinks.drain(routed)
            got = counts.get
            return branch_sinks.BranchReport(read=got["read"], unrouted=got["unrouted"], per_branch={n: got[n] for n in branches})

        return one_of
    if kind == "named":
        return lambda df, _: routing.named(sink["name"])(df)
    raise ValueError(f"unknown sink kind {kind}")


# --- the job --------------------------------------------------------------------------------


@dataclass
class CopyReport:
    rows: int = 0
    read: int = 0
    rejected: int = 0
    elapsed_s: float = 0.0
    delivery: str = ""
    identity: str = ""
    position: Any = None
    notes: list[str] = field(default_factory=list)

    @property
    def rows_per_second(self) -> int:
        return round(self.read / self.elapsed_s) if self.elapsed_s > 0 else 0

    def summary(self) -> str:
        kept = f"{self.rows} rows" if self.rows == self.read else f"{self.rows} of {self.read} rows"
        kept += f" ({self.rejected} rejected)" if self.rejected else ""
        return f"copied {kept} in {self.elapsed_s:.2f} s ({self.rows_per_second} rows/s, {self.delivery})"


class Grouping:
    """A step whose result for a row depends on other rows, so that it needs all of them at once.

    Cut into micro-batches or resumed runs it would lose open groups and let repeats through.
    """

    def __init__(self, name: str, step: Callable[[DataFrame], DataFrame]):
        self.name, self.step = name, step

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.step(df)


def copy(
    spark: SparkSession,
    source: dict,
    sink: dict,
    filter: str | None = None,
    steps: Sequence[Callable[[DataFrame], DataFrame]] = (),
    resume: bool = False,
    drain: bool = True,
    state_dir: str | None = None,
    poll: str = "1 second",
) -> CopyReport | StreamingQuery:
    """Copy what is there and stop (``drain``), or keep copying and return the running query.

    With ``resume`` a later run continues where this one ended: by the last cursor value, or
    by the checkpoint of a stream.  A position is stored only after the sink has accepted the
    rows, so a crash repeats rows and never skips any.

    ``rows`` of the report are those that reached the sink.  A ``Rejecting`` step sends what it
    rejects to its own sink, or the copy fails.  A ``Grouping`` step keeps no state between
    batches, so it is refused with ``resume`` or a stream source.
    """
    for step in steps:
        if isinstance(step, Grouping) and (resume or source["kind"] in STREAMS):
            raise ValueError(f"{step.name} needs all rows at once; it can't take a stream source or resume")
    kind = resume_kind(source) if resume else None
    identity = copy_identity(source, sink, filter)
    state = state_dir or f"{shared_dir(spark)}/copy-state"
    write = open_sink(sink)
    report = CopyReport(identity=identity, delivery=delivery_label(source, sink))
    log.info("%s is %s", identity, report.delivery)
    if source["kind"] in STREAMS:
        run = identity if resume else f"{identity}-{uuid.uuid4().hex[:8]}"
        if source.get("group"):
            run = f"{identity}-{source['group']}"
        return _copy_stream(spark, source, write, filter, steps, group_checkpoint(state, run), drain, poll, report)
    if not drain:
        raise ValueError(f"a {source['kind']} source ends; continuous copying needs a stream source")
    return _copy_batch(spark, source, sink, write, filter, steps, kind, PositionStore(spark, f"{state}/positions"), report)


def _delivered(flow: DataFrame, filter: str | None, steps, write, batch: str, notes: list[str]) -> tuple[int, int]:
    """Filter, shape and write; (rows delivered, rows rejected), counted by the writes themselves."""
    flow = filter_rows(flow, filter) if filter else flow
    rejects: list[tuple[DataFrame, dict | None, Observation]] = []
    for step in steps:
        if isinstance(step, Rejecting):
            # Both sides are written, so the rows before the split are settled once.
            settled = staging_path(flow.sparkSession, "split")
            flow.write.parquet(settled)
            flow, bad = step.split(flow.sparkSession.read.schema(flow.schema).parquet(settled))
            count = Observation()
            rejects.append((bad.observe(count, F.count(F.lit(1)).alias("n")), step.sink, count))
        else:
            flow = flow.transform(step)
    rejected = 0
    for bad, sink, count in rejects:
        open_sink(sink or {"kind": "null"})(bad, batch)
        rejected += count.get["n"]
        if count.get["n"] and sink is None:
            raise LossyCopy(f"{count.get['n']} rows were rejected and there is no dead-letter sink")
    delivered = Observation()
    result = write(flow.observe(delivered, F.count(F.lit(1)).alias("n")), batch)
    if isinstance(result, branch_sinks.BranchReport):
        # Rows that no branch took did not reach the sink: they are reported, not counted as copied.
        notes.append(f"unrouted {result.unrouted}; " + ", ".join(f"{k} {v}" for k, v in result.per_branch.items()))
        return result.read - result.unrouted, rejected
    return delivered.get["n"], rejected


def _copy_batch(spark, source, sink, write, filter, steps, kind, store: PositionStore, report: CopyReport) -> CopyReport:
    begun = time.monotonic()
    rows, cursor, key = open_source(spark, source), source.get("cursor_column"), None
    if source.get("provenance"):
        # Where each row was read (file, block, row index), as reserved metadata that steps keep.
        rows = file_sources.with_source_position(rows)
    measures = [F.count(F.lit(1)).alias("n")]
    if kind == "cursor":
        key = f"{source['kind']}:{source.get('cursor_id', report.identity)}"
        report.position = store.get(key)
        check_cursor_type(rows, cursor)
        # A text cursor over CSV keys would compare as text, so its type is the frame's own.
        rows = tables.read_incremental(rows, cursor, report.position)
        measures.append(F.max(cursor).alias("p"))
    elif kind == "external":
        key = f"objects:{source.get('cursor_id', report.identity)}"
        report.position = store.get(key)
        rows = file_sources.read_objects(spark, source["path"], report.position, source.get("max_object_bytes"))
        measures.append(F.max("object_key").alias("p"))
    if kind == "cursor" and source.get("chunk_rows"):
        widest = WAVE if _takes_waves(rows, sink, filter, steps) else 1
        return _copy_chunks(rows, cursor, int(source["chunk_rows"]), filter, steps, write, store, key, report, begun, widest)
    # Counts and the new position come from the write itself: the source is read once.
    read = Observation()
    batch = report.identity if report.position is None else f"{report.identity}-{report.position}"
    report.rows, report.rejected = _delivered(rows.observe(read, *measures), filter, steps, write, batch, report.notes)
    report.read = read.get["n"]
    if key and read.get.get("p") is not None:
        report.position = read.get["p"]
        store.put(key, report.position)
    report.elapsed_s = time.monotonic() - begun
    log.info(report.summary())
    return report


#: Sinks whose write of a frame leaves all of its rows or none, whatever the frame's size.
WHOLE_SINKS = ("table", "null", "objects", "idempotent", "raw", "csv", *ENVELOPES)
#: Ranges that one write takes at most.
WAVE = 1024


def _takes_waves(rows: DataFrame, sink: dict, filter: str | None, steps) -> bool:
    """Whether several ranges may be written at once: the sink takes all rows or none, and every
    step judges a row by itself, so that it gives the same rows however they are cut."""
    if sink["kind"] not in WHOLE_SINKS or sink.get("compression", "none") not in ("none", "gzip"):
        return False
    if any(isinstance(step, Rejecting) for step in steps):
        return False
    flow = filter_rows(rows, filter) if filter else rows
    for step in steps:
        flow = flow.transform(step)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        flow.explain()
    return not any(word in plan.getvalue() for word in ("Exchange", "Aggregate", "Window", "Limit"))


def _copy_chunks(rows, cursor, chunk_rows, filter, steps, write, store, key, report: CopyReport, begun, widest: int) -> CopyReport:
    """New rows in ranges of the cursor of about ``chunk_rows`` rows, written in cursor order; the
    position of each range is stored after it is written, so it is always the end of a gapless run
    of written rows, and a copy that fails in a range resumes at that range. A range ends between
    different values, so rows of one cursor value are written together.

    Each write takes twice as many ranges as the one before, up to ``widest``. One that fails has
    left nothing, and is halved until the failing range stands alone and all before it are written.
    """
    if rows.schema[cursor].dataType.simpleString() == "string":
        raise ValueError("chunk_rows needs a numeric cursor")
    total = rows.count()
    report.read = total
    if not total:
        report.elapsed_s = time.monotonic() - begun
        return report
    ranks = rows.sparkSession.range(chunk_rows - 1, total, chunk_rows).select(F.lit("").alias("_g"), F.col("id").alias("_rank"))
    ranks = ranks.union(rows.sparkSession.range(1).select(F.lit("").alias("_g"), F.lit(total - 1).alias("_rank")))
    found = values_at(rows.select(F.lit("").alias("_g"), F.col(cursor).alias("_v")), ranks.distinct())
    bounds = sorted({r["_value"] for r in found.collect()})
    at, wave, suspect = 0, 1, 0
    while at < len(bounds):
        # Inside a wave that failed, half of what is left of it; else the next wave.
        ends = bounds[at : at + (max(1, (suspect - at) // 2) if at < suspect else wave)]
        part = rows.where(F.col(cursor) <= F.lit(ends[-1]))
        if report.position is not None:
            part = part.where(F.col(cursor) > F.lit(report.position))
        batch = f"{report.identity}-{report.position}"
        try:
            written, rejected = _delivered(part, filter, steps, write, batch, report.notes)
        except Exception:
            if len(ends) == 1:
                raise
            log.warning("a write of %d ranges failed; trying fewer", len(ends))
            suspect, wave = at + len(ends), 1
            continue
        report.rows += written
        report.rejected += rejected
        report.position = int(ends[-1])
        store.put(key, *map(int, ends))
        at += len(ends)
        if at >= suspect:
            wave = min(2 * wave, widest)
    report.elapsed_s = time.monotonic() - begun
    log.info(report.summary())
    return report


def _copy_stream(spark, source, write, filter, steps, checkpoint, drain, poll, report: CopyReport):
    rows = open_source(spark, source)
    counts = {"read": 0, "rows": 0, "rejected": 0}

    def each(batch: DataFrame, batch_id: int) -> None:
        read = Observation()
        rows, rejected = _delivered(batch.observe(read, F.count(F.lit(1)).alias("n")), filter, steps, write, str(batch_id), report.notes)
        counts["read"] += read.get["n"]
        counts["rows"] += rows
        counts["rejected"] += rejected

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if not drain:
        return writer.queryName(report.identity).trigger(processingTime=poll).start()
    begun = time.monotonic()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    report.read, report.rows, report.rejected = counts["read"], counts["rows"], counts["rejected"]
    report.elapsed_s = time.monotonic() - begun
    log.info(report.summary())
    return report


# --- routes as data -------------------------------------------------------------------------


def _step_of(item: dict) -> Callable[[DataFrame], DataFrame]:
    (name, options), = item.items()
    if name == "filter":
        return lambda df: filter_rows(df, options)
    if name == "mapping":
        return lambda df: shaping.map_fields(df, options)
    if name == "columns":
        return lambda df: shaping.project(df, options)
    if name == "types":
        rules = {k: v for k, v in options.items() if k != "dead_letters"}
        return Rejecting(lambda df: shaping.split_by_error(shaping.type_columns(df, rules)), options.get("dead_letters"))
    if name == "transform":
        wanted = {k: v for k, v in options.items() if k != "dead_letters"}
        if wanted.get("on_error", "reject") == "reject":
            return Rejecting(lambda df: shaping.transform(df, **wanted), options.get("dead_letters"))
        return lambda df: shaping.transform(df, **wanted)
    if name == "dedup":
        return lambda df: dedup_ops.dedup(df, options["key"], options["order"])
    if name == "dedup_ttl":
        names = ("key", "ts", "tie", "ttl_seconds")
        return Grouping(name, lambda df: dedup_ops.dedup_ttl(df, *(options[n] for n in names)))
    if name == "correlate":
        return Grouping(name, lambda df: correlate(df, **options))
    if name == "switch":
        return lambda df: routing.switch(df, **options)
    if name == "step":
        return routing.step(options)
    raise ValueError(f"unknown middleware {name}")


def run_route(spark: SparkSession, config: dict | str, name: str | None = None):
    """Run one route given as a dict, or as the path of a YAML or JSON file.

    ``{name: {input: {...}, middlewares: [...], output: {...}, resume, drain}}``
    """
    if isinstance(config, str):
        import yaml

        with open(config, encoding="utf-8") as handle:
            config = yaml.safe_load(handle)
    routes = config.get("routes", config)
    if name is None:
        if len(routes) != 1:
            raise ValueError("name the route to run")
        name = next(iter(routes))
    route = routes[name]
    steps = [_step_of(item) for item in route.get("middlewares", [])]
    sink = route.get("output", {"kind": "null"})
    return copy(
        spark, route["input"], sink, route.get("filter"), steps,
        route.get("resume", False), route.get("drain", True), route.get("state_dir"),
    )


def run_routes(spark: SparkSession, config: dict) -> dict[str, Any]:
    """Start every enabled route; continuous ones come back as running queries."""
    routes = config.get("routes", config)
    return {n: run_route(spark, routes, n) for n, r in routes.items() if r.get("enabled", True)}
