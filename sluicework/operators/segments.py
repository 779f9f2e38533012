"""Greedy segments: split each key's ordered rows into runs that close at a bound.

One rule covers TTL deduplication, correlation with a timeout and count-or-time batches: where
the next run starts depends only on the row that started the current one.

* Ordinary keys take one shuffle; a task walks sorted Arrow batches and solves every key in
  them with array operations.
* A key over ``hot_rows`` rows is never put in one task.  Its rows are range-sorted, so a hot
  key spans many partitions; each row gets a pointer to the row that would start the next run,
  blocks of rows collapse pointer chains locally, and the few pointers left between blocks are
  followed by repeated doubling.  The result is exact for any skew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sluicework.session import cut_lineage

# Rows of one key that a task may hold at once, with their payloads.
HOT_ROWS = 200_000
BATCH_ROWS = 50_000
_NONE = np.iinfo(np.int64).max
# A row without a time stands before all others of its key, in a run of its own.
NO_TIME = -(1 << 62)
_MASK = (1 << 33) - 1


@dataclass(frozen=True)
class Bounds:
    """When a run closes: after ``max_rows``, ``max_span`` order units after its first row, or
    once all ``required`` branches, or any ``branch_count`` different ones, were seen.  A null
    branch is none of them."""

    max_rows: int | None = None
    max_span: int | None = None
    required: tuple[str, ...] = ()
    branch_count: int | None = None

    @property
    def only_rows(self) -> bool:
        return self.max_rows is not None and self.max_span is None and not (self.required or self.branch_count)


def order_value(df: DataFrame, column: str) -> Column:
    """The order column as BIGINT: microseconds for timestamps, the number itself otherwise,
    ``NO_TIME`` for null.

    A timestamp without zone is counted from its own calendar fields, so the session's zone
    and its clock changes cannot reorder rows.
    """
    kind = df.schema[column].dataType
    ts = F.col(column)
    if isinstance(kind, T.TimestampType):
        value = F.unix_micros(ts)
    elif isinstance(kind, T.TimestampNTZType):
        days = F.unix_date(ts.cast("date")).cast("bigint")
        minutes = days * 1440 + F.hour(ts) * 60 + F.minute(ts)
        value = minutes * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    else:
        value = ts.cast("bigint")
    return F.coalesce(value, F.lit(NO_TIME))


def segment(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    bounds: Bounds,
    branch: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``run_start`` (first row of a run), ``run_id`` (``tie`` of that row) and
    ``run_complete`` (closed by count or branches, not by time or end of data).

    ``tie`` must be unique within a key.  Rows without a time come first and form a run of
    their own, however large the key is.
    """
    keys = list(keys)
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return _segment_ordinary(df, keys, order, tie, bounds, branch)
    same = same_keys(keys, "k")
    renamed = small(hot.select(*[F.col(k).alias(f"k_{k}") for k in keys]))
    ordinary = df.join(renamed, same, "left_anti")
    heavy = df.join(renamed, same, "left_semi")
    return _segment_ordinary(ordinary, keys, order, tie, bounds, branch).unionByName(
        _segment_hot(heavy, keys, order, tie, bounds, branch, hot_rows)
    )


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, or None.  Counts are combined map-side."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = cut_lineage(counted.drop("_n"))
    return None if hot.isEmpty() else hot


def same_keys(keys: list[str], prefix: str) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"{prefix}_{k}"))
    return condition


BROADCAST_BYTES = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """Broadcast a written lookup only when its measured size allows; else leave it to AQE, which
    splits the skewed side of a join."""
    width = F.octet_length(F.to_json(F.struct("*")))
    size = df.agg(F.sum(width + 32).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


# --- array rules shared by both ways --------------------------------------------------------


def _next_occurrence(is_branch: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Per row, the position of the nearest branch row at or after it."""
    marked = np.where(is_branch, positions, _NONE)
    return np.minimum.accumulate(marked[::-1])[::-1]


def _close_by_branches(nexts: list[np.ndarray]) -> np.ndarray:
    """First position after the run that has seen every branch."""
    last = np.stack(nexts).max(axis=0)
    return np.where(last == _NONE, _NONE, last + 1)


def _close_by_count(group: np.ndarray, branch: np.ndarray, wanted: int) -> np.ndarray:
    """Per row, the first position after a run from there that has seen ``wanted`` different branches.

    The end only moves forward within a group, so one pass with two pointers finds all.
    """
    n = len(group)
    out = np.full(n, _NONE)
    tags, groups = branch.tolist(), group.tolist()
    seen: dict = {}
    end = 0
    for here in range(n):
        if here and groups[here] != groups[here - 1]:
            seen, end = {}, here
        while len(seen) < wanted and end < n and groups[end] == groups[here]:
            if tags[end] is not None:
                seen[tags[end]] = seen.get(tags[end], 0) + 1
            end += 1
        if len(seen) >= wanted:
            out[here] = end
        if tags[here] is not None:
            seen[tags[here]] -= 1
            if not seen[tags[here]]:
                del seen[tags[here]]
    return out


def _jumps(pointer: np.ndarray) -> list[np.ndarray]:
    """Pointer tables for 1, 2, 4, ... steps; ``len(pointer)`` is the fixed end node."""
    tables = [np.append(pointer, len(pointer))]
    while True:
        doubled = tables[-1][tables[-1]]
        if np.array_equal(doubled, tables[-1]):
            return tables
        tables.append(doubled)


def _visited(tables: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """All nodes on the chains that leave ``starts``."""
    seen = np.zeros(len(tables[0]), dtype=bool)
    seen[starts] = True
    for table in reversed(tables):
        seen[table[np.flatnonzero(seen)]] = True
    return seen[:-1]


def _solve(group: np.ndarray, at: np.ndarray, branch: np.ndarray | None, bounds: Bounds):
    """Runs of whole groups: (is_start, start position, complete) per row."""
    n = len(group)
    here = np.arange(n)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    by_rows = here + bounds.max_rows if bounds.max_rows is not None else np.full(n, _NONE)
    if bounds.required:
        nexts = []
        for name in bounds.required:
            near = _next_occurrence(branch == name, here)
            nexts.append(np.where(near >= end, _NONE, near))
        by_rows = np.minimum(by_rows, _close_by_branches(nexts))
    elif bounds.branch_count:
        by_rows = np.minimum(by_rows, _close_by_count(group, branch, bounds.branch_count))
    by_time = np.full(n, _NONE)
    if bounds.max_span is not None:
        ranks = np.unique(np.concatenate([at, at + bounds.max_span]), return_inverse=True)[1]
        scale = 2 * n + 1
        by_time = np.searchsorted(group * scale + ranks[:n], group * scale + ranks[n:], "left")
        by_time = np.maximum(by_time, here + 1)
    complete = (by_rows <= end) & (by_rows <= by_time)
    following = np.minimum(by_rows, by_time)
    is_start = _visited(_jumps(np.where(following >= end, n, following)), first)
    start = np.maximum.accumulate(np.where(is_start, here, 0))
    return is_start, start, complete[start]


# --- ordinary keys --------------------------------------------------------------------------


def _out_schema(df: DataFrame, tie: str) -> T.StructType:
    return T.StructType(
        list(df.schema.fields)
        + [
            T.StructField("run_start", T.BooleanType()),
            T.StructField("run_id", df.schema[tie].dataType),
            T.StructField("run_complete", T.BooleanType()),
        ]
    )


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Small integers, equal exactly where the (adjacent) values are equal."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    encoded = pc.dictionary_encode(column, null_encoding="encode")
    return encoded.indices.to_numpy(zero_copy_only=False)


def _groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(table.num_rows, dtype=bool)
    for k in keys:
        codes = _codes(table.column(k))
        changed[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(changed)


def _segment_ordinary(df, keys, order, tie, bounds: Bounds, branch) -> DataFrame:
    names = df.columns
    ordered = (
        df.withColumn("_at", order_value(df, order))
        .repartition(*keys)
        .sortWithinPartitions(*keys, "_at", tie)
    )

    def solve(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = table.column("_at").to_numpy()
        tags = np.array(table.column(branch).to_pylist(), dtype=object) if branch else None
        is_start, start, complete = _solve(group, at, tags, bounds)
        out = table.select(names)
        out = out.append_column("run_start", pa.array(is_start))
        out = out.append_column("run_id", table.column(tie).take(pa.array(start)))
        out = out.append_column("run_complete", pa.array(complete))
        yield from out.to_batches()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, wanted = 0, BATCH_ROWS
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < wanted:
                continue
            table = pa.Table.from_batches(held)
            group = _groups(table, keys)
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield from solve(table.slice(0, cut), group[:cut])
                held = table.slice(cut).combine_chunks().to_batches()
            rows = table.num_rows - cut
            # A long last group is looked at again only once it has doubled.
            wanted = max(BATCH_ROWS, 2 * rows)
        if held:
            table = pa.Table.from_batches(held)
            yield from solve(table, _groups(table, keys))

    return ordered.mapInArrow(walk, _out_schema(df, tie))


# --- hot keys -------------------------------------------------------------------------------


def positions(df: DataFrame, order: Sequence[Column], name: str = "_g", partitions: int | None = None) -> DataFrame:
    """Rows with their 0-based position in a global order.

    A range sort splits any key over partitions.  The sorted rows are written once, so the
    positions are stable; only one row count per partition reaches the driver.
    """
    spread = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = cut_lineage(
        spread.sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id())
    )
    counts = placed.groupBy(F.shiftright("_pos", 33).alias("_pid")).agg(F.count(F.lit(1)).alias("n"))
    offset, rows = 0, []
    for row in sorted(counts.collect()):
        rows.append((row["_pid"], offset))
        offset += row["n"]
    starts = df.sparkSession.createDataFrame(rows, "_pid long, _offset long")
    return (
        placed.withColumn("_pid", F.shiftright("_pos", 33))
        .join(F.broadcast(starts), "_pid")
        .withColumn(name, F.col("_offset") + F.col("_pos").bitwiseAND(F.lit(_MASK)))
        .drop("_pos", "_pid", "_offset")
    )


def _segment_hot(df, keys, order, tie, bounds: Bounds, branch, block_rows: int) -> DataFrame:
    spread = df.sparkSession.sparkContext.defaultParallelism
    spread = max(spread, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slim = df.select(
        *keys, order_value(df, order).alias("_at"), F.col(tie).alias("_tie"),
        *([F.col(branch).alias("_branch")] if branch else []),
    )
    ranked = positions(slim, [*map(F.col, keys), F.col("_at"), F.col("_tie")], partitions=spread)
    edge = ranked.groupBy(*keys).agg(F.min("_g").alias("_first"), F.max("_g").alias("_last"))
    edge = cut_lineage(edge.select(*[F.col(k).alias(f"e_{k}") for k in keys], "_first", "_last"))
    ranked = ranked.join(small(edge), same_keys(keys, "e"), "inner").drop(*[f"e_{k}" for k in keys])
    if bounds.only_rows:
        solved = _every(ranked, bounds.max_rows)
    else:
        solved = _follow(_pointers(ranked, keys, bounds, spread), block_rows)
    named = solved.select(
        *[F.col(k).alias(f"r_{k}") for k in keys], "_tie", "run_start", "run_id", "run_complete"
    )
    joined = df.join(named, same_keys(keys, "r") & F.col(tie).eqNullSafe(F.col("_tie")))
    return joined.select(*df.columns, "run_start", "run_id", "run_complete")


def _every(ranked: DataFrame, rows: int) -> DataFrame:
    """Runs of a fixed number of rows follow from positions alone."""
    step = (F.col("_g") - F.col("_first")) % rows
    full = F.col("_g") - step + rows <= F.col("_last") + 1
    placed = cut_lineage(
        ranked.withColumns({"run_start": step == 0, "_s": F.col("_g") - step, "run_complete": full})
    )
    heads = placed.where("run_start").select(F.col("_g").alias("_s"), F.col("_tie").alias("run_id"))
    return placed.join(heads, "_s")


def _pointers(ranked: DataFrame, keys, bounds: Bounds, spread: int) -> DataFrame:
    """Add ``_next`` (position that would start the next run, or NULL) and ``_complete``."""
    out = ranked.withColumn(
        "_rows", (F.col("_g") + bounds.max_rows) if bounds.max_rows is not None else F.lit(_NONE)
    )
    if bounds.required:
        out = _branch_closes(out, bounds, spread)
    elif bounds.branch_count:
        out = _count_closes(out, bounds.branch_count, spread)
    if bounds.max_span is not None:
        out = _time_closes(out, keys, bounds.max_span, spread)
    else:
        out = out.withColumn("_time", F.lit(_NONE))
    following = F.least("_rows", "_time")
    return out.withColumn("_next", F.when(following <= F.col("_last"), following)).withColumn(
        "_complete", (F.col("_rows") <= F.col("_last") + 1) & (F.col("_rows") <= F.col("_time"))
    )


def _scan_down(
    df: DataFrame, order: Sequence[Column], marks: dict[str, Column], spread: int, schema: T.StructType, use
) -> DataFrame:
    """Walk rows in a descending range order carrying, per mark, the smallest marked position.

    ``use(table, running)`` makes the output rows of a batch.  Across partitions only one value
    per mark and partition is gathered.
    """
    names = list(marks)
    placed = df.select("*", *[c.alias(f"_m_{n}") for n, c in marks.items()])
    placed = cut_lineage(
        placed.repartitionByRange(spread, *order).sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    lows = placed.groupBy(F.shiftright("_pos", 33).alias("_pid")).agg(
        *[F.min(f"_m_{n}").alias(n) for n in names]
    )
    carried, running = {}, np.full(len(names), _NONE)
    for row in sorted(lows.collect(), key=lambda r: r["_pid"]):
        carried[row["_pid"]] = running
        here = np.array([_NONE if row[n] is None else row[n] for n in names])
        running = np.minimum(running, here)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, carry = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("_pos").to_numpy() >> 33
            cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            for begin, end in zip(cuts, np.append(cuts[1:], len(ids))):
                part = batch.slice(begin, end - begin)
                if ids[begin] != pid:
                    pid, carry = ids[begin], carried[ids[begin]].copy()
                lowest = []
                for i, n in enumerate(names):
                    marked = pc.fill_null(part.column(f"_m_{n}"), _NONE).to_numpy(zero_copy_only=False)
                    low = np.minimum.accumulate(np.minimum(marked, carry[i]))
                    carry[i] = low[-1]
                    lowest.append(low)
                yield from use(pa.Table.from_batches([part]), lowest).to_batches()

    return placed.mapInArrow(walk, schema)


def _branch_closes(ranked: DataFrame, bounds: Bounds, spread: int) -> DataFrame:
    kept = ranked.columns
    marks = {str(i): F.when(F.col("_branch") == name, F.col("_g")) for i, name in enumerate(bounds.required)}
    schema = T.StructType(list(ranked.schema.fields))

    def use(table, lowest):
        last = table.column("_last").to_numpy()
        near = [np.where(low > last, _NONE, low) for low in lowest]
        rows = np.minimum(table.column("_rows").to_numpy(), _close_by_branches(near))
        out = table.select(kept)
        return out.set_column(kept.index("_rows"), "_rows", pa.array(rows))

    return _scan_down(ranked, [F.col("_g").desc()], marks, spread, schema, use)


class _Nearest:
    """The ``wanted`` different branches that come next, nearest first, on a walk from the end."""

    def __init__(self, wanted: int, known: list[tuple]):
        self.wanted, self.places = wanted, dict(reversed(known))

    def pass_by(self, branch, position: int) -> None:
        if branch is None:
            return
        self.places.pop(branch, None)
        self.places[branch] = position
        if len(self.places) > self.wanted:
            del self.places[next(iter(self.places))]

    def last(self) -> int:
        """Position of the ``wanted``-th branch."""
        return next(iter(self.places.values())) if len(self.places) == self.wanted else _NONE

    def known(self) -> list[tuple]:
        return list(self.places.items())[::-1]


def _count_closes(ranked: DataFrame, wanted: int, spread: int) -> DataFrame:
    """Close runs at the ``wanted``-th different branch, however many branches there are.

    Rows are walked from the end; a partition hands on at most ``wanted`` branches.
    """
    kept = ranked.columns
    placed = cut_lineage(
        ranked.repartitionByRange(spread, F.col("_g").desc()).sortWithinPartitions(F.col("_g").desc())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    kind = ranked.schema["_branch"].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("_pos").to_numpy() >> 33
                cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                for begin, end in zip(cuts, np.append(cuts[1:], len(ids))):
                    yield int(ids[begin]), batch.slice(begin, end - begin)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, _Nearest] = {}
        for pid, part in parts(batches):
            state = near.setdefault(pid, _Nearest(wanted, []))
            for branch, g in zip(part.column("_branch").to_pylist(), part.column("_g").to_pylist()):
                state.pass_by(branch, g)
        for pid, state in near.items():
            known = state.known()
            yield pa.RecordBatch.from_arrays(
                [pa.array([pid] * len(known), pa.int64()), pa.array([b for b, _ in known], placed_kind), pa.array([g for _, g in known], pa.int64())],
                names=["pid", "branch", "g"],
            )

    placed_kind = to_arrow_type(ranked.schema["_branch"].dataType)
    found: dict[int, list[tuple]] = {}
    for row in placed.mapInArrow(gather, f"pid long, branch {kind}, g long").collect():
        found.setdefault(row["pid"], []).append((row["branch"], row["g"]))
    carried, state = {}, _Nearest(wanted, [])
    pids = sorted(r["pid"] for r in placed.select(F.shiftright("_pos", 33).alias("pid")).distinct().collect())
    for pid in pids:
        carried[pid] = state.known()
        for branch, g in sorted(found.get(pid, []), key=lambda known: -known[1]):
            state.pass_by(branch, g)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, near = None, None
        for here, part in parts(batches):
            if here != pid:
                pid, near = here, _Nearest(wanted, carried[here])
            closes = []
            for branch, g, last in zip(*(part.column(c).to_pylist() for c in ("_branch", "_g", "_last"))):
                near.pass_by(branch, g)
                at = near.last()
                closes.append(at + 1 if at <= last else _NONE)
            out = pa.Table.from_batches([part]).select(kept)
            rows = np.minimum(out.column("_rows").to_numpy(), np.array(closes, np.int64))
            yield from out.set_column(kept.index("_rows"), "_rows", pa.array(rows)).to_batches()

    return placed.mapInArrow(close, T.StructType(list(ranked.schema.fields)))


def _time_closes(ranked: DataFrame, keys, span: int, spread: int) -> DataFrame:
    """For each row, the first row of its key at or after ``_at + span``: rows and probes are
    sorted together, newest first, and a probe reads the last row passed before it."""
    kept = ranked.columns
    rows = ranked.withColumn("_when", F.col("_at")).withColumn("_probe", F.lit(0))
    probes = ranked.withColumn("_when", F.col("_at") + span).withColumn("_probe", F.lit(1))
    order = [*[F.col(k).desc() for k in keys], F.col("_when").desc(), F.col("_probe").asc(), F.col("_g").desc()]
    schema = T.StructType([*ranked.schema.fields, T.StructField("_time", T.LongType())])
    marks = {"row": F.when(F.col("_probe") == 0, F.col("_g"))}

    def use(table, lowest):
        low = np.where(lowest[0] > table.column("_last").to_numpy(), _NONE, lowest[0])
        low = np.maximum(low, table.column("_g").to_numpy() + 1)
        out = table.select(kept).append_column("_time", pa.array(low))
        return out.filter(pc.equal(table.column("_probe"), 1))

    return _scan_down(rows.unionByName(probes), order, marks, spread, schema, use)


def _per_block(df: DataFrame, block_rows: int, columns: list[str], schema: str, solve) -> DataFrame:
    """Run ``solve(table sorted by _g)`` on every block of consecutive positions."""
    blocks = (
        df.withColumn("_b", F.expr(f"_g div {block_rows}"))
        .repartition("_b").sortWithinPartitions("_b", "_g").select("_b", "_g", *columns)
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            ids = table.column("_b").to_numpy()
            cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            for begin, end in zip(cuts, np.append(cuts[1:], len(ids))):
                part = table.slice(begin, end - begin)
                if held and held[0].column("_b")[0].as_py() != ids[begin]:
                    yield from solve(pa.concat_tables(held)).to_batches()
                    held = []
                held.append(part)
        if held:
            yield from solve(pa.concat_tables(held)).to_batches()

    return blocks.mapInArrow(walk, schema)


def _local(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, next positions (-1 = none) and in-block pointers (block size = leaves)."""
    g = table.column("_g").to_numpy()
    following = pc.fill_null(table.column("_next"), -1).to_numpy()
    inside = (following >= 0) & (following <= g[-1])
    local = np.where(inside, np.searchsorted(g, following), len(g))
    return g, following, local


def _follow(edges: DataFrame, block_rows: int) -> DataFrame:
    """Mark run starts by following ``_next`` from the first row of every key."""
    edges = cut_lineage(edges)

    def exits(table: pa.Table) -> pa.Table:
        g, following, local = _local(table)
        tables = _jumps(local)
        last = np.arange(len(g))
        for jump in reversed(tables):
            hop = jump[last]
            last = np.where(hop < len(g), hop, last)
        left = following[last]
        return pa.table({"node": g, "leap": pa.array(left, mask=left < 0)})

    leaps = cut_lineage(_per_block(edges, block_rows, ["_next"], "node long, leap long", exits))
    roots = edges.where(F.col("_g") == F.col("_first")).select(F.col("_g").alias("node"))
    entries = leaps.where("leap is not null").select(F.col("leap").alias("node")).distinct()
    graph = leaps.join(entries.unionByName(roots).distinct(), "node", "left_semi")
    reached = _reachable(graph.where("leap is not null"), roots)

    def marks(table: pa.Table) -> pa.Table:
        g, _, local = _local(table)
        entered = np.flatnonzero(table.column("_entered").to_numpy(zero_copy_only=False))
        is_start = _visited(_jumps(local), entered) if len(entered) else np.zeros(len(g), bool)
        start = np.maximum.accumulate(np.where(is_start, np.arange(len(g)), -1))
        at = pa.array(start, mask=start < 0)
        return pa.table({
            "_g": g, "run_start": is_start, "run_id": table.column("_tie").take(at),
            "run_complete": table.column("_complete").take(at), "found": start >= 0,
        })

    flagged = edges.join(
        reached.select(F.col("node").alias("_g"), F.lit(True).alias("_hit")), "_g", "left"
    ).withColumn("_entered", F.coalesce("_hit", F.lit(False)))
    kind = edges.schema["_tie"].dataType.simpleString()
    marked = cut_lineage(_per_block(
        flagged, block_rows, ["_next", "_entered", "_tie", "_complete"],
        f"_g long, run_start boolean, run_id {kind}, run_complete boolean, found boolean", marks,
    ))
    # One row per block: the last start before it, for rows whose run began in an earlier block.
    block = F.expr(f"_g div {block_rows}")
    head = F.struct("run_id", "run_complete")
    ends = marked.groupBy(block.alias("_b")).agg(F.max_by(head, F.when(F.col("run_start"), F.col("_g"))).alias("_end"))
    carried = _carry(ends)
    filled = marked.withColumn("_b", block).join(small(carried), "_b").select(
        "_g", "run_start",
        *[F.when(F.col("found"), F.col(c)).otherwise(F.col(f"_carried.{c}")).alias(c) for c in ("run_id", "run_complete")],
    )
    return edges.join(filled, "_g")


def _carry(ends: DataFrame) -> DataFrame:
    """Per block, the last ``_end`` of the blocks before it; one row per partition is gathered."""
    placed = cut_lineage(
        ends.repartitionByRange("_b").sortWithinPartitions("_b").withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33))
    )
    lasts = placed.groupBy("_part").agg(F.max_by("_end", F.when(F.col("_end").isNotNull(), F.col("_b"))).alias("_end"))
    rows, known = [], None
    for row in sorted(lasts.collect(), key=lambda r: r["_part"]):
        rows.append((row["_part"], known))
        known = row["_end"] if row["_end"] is not None else known
    schema = T.StructType([T.StructField("_part", T.LongType()), T.StructField("_earlier", ends.schema["_end"].dataType)])
    starts = F.broadcast(ends.sparkSession.createDataFrame(rows, schema))
    before = Window.partitionBy("_part").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.last("_end", ignorenulls=True).over(before)
    return cut_lineage(placed.join(starts, "_part").select("_b", F.coalesce(inside, "_earlier").alias("_carried")))


def _reachable(graph: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes on the chains from ``roots``; the number of rounds is the log of the chain length."""
    reached = cut_lineage(roots)
    jump = cut_lineage(graph)
    while True:
        new = reached.join(jump, "node").select(F.col("leap").alias("node"))
        grown = cut_lineage(reached.unionByName(new).distinct())
        longer = jump.select("node", F.col("leap").alias("mid")).join(
            jump.select(F.col("node").alias("mid"), "leap"), "mid"
        )
        jump = cut_lineage(longer.select("node", "leap"))
        reached = grown
        if jump.isEmpty():
            return reached
