"""Streaming deduplication, correlation and change application."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sluicework.operators.dedup import latest_per_key
from sluicework.operators.segments import order_value
from sluicework.operators.upsert import apply_changes
from sluicework.session import ROCKSDB, path_exists


def with_lateness(sdf: DataFrame, ts: str, delay: str) -> DataFrame:
    """Rows up to ``delay`` behind the newest time are still in time."""
    return sdf.withWatermark(ts, delay)


def late_rows(query) -> int:
    """Rows dropped for being behind the watermark, over the batches Spark still remembers.

    A batch may be reported more than once, so its largest report counts.
    """
    per_batch: dict[int, int] = {}
    for progress in query.recentProgress:
        late = sum(o["numRowsDroppedByWatermark"] for o in progress["stateOperators"])
        per_batch[progress["batchId"]] = max(late, per_batch.get(progress["batchId"], 0))
    return sum(per_batch.values())


class LateRows(StreamingQueryListener):
    """Rows dropped for being behind the watermark, added up per query from every batch's progress
    as Spark reports it, so that the count covers the whole run, not only the reports Spark keeps.

    ``spark.streams.addListener(counter)`` before starting; a batch reported twice counts once.
    """

    def __init__(self):
        self.per_batch: dict[tuple[str, int], int] = {}
        self.last: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        late = sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)
        key = (str(progress.id), progress.batchId)
        self.per_batch[key] = max(late, self.per_batch.get(key, 0))
        self.last[str(progress.id)] = max(progress.batchId, self.last.get(str(progress.id), -1))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def total(self, query, wait_s: float = 30.0) -> int:
        """Late rows of ``query``, once its last batch's report has arrived (reports come late)."""
        import time

        last = (query.lastProgress or {}).get("batchId", -1)
        until = time.monotonic() + wait_s
        while self.last.get(str(query.id), -1) < last and time.monotonic() < until:
            time.sleep(0.1)
        return sum(n for (run, _), n in self.per_batch.items() if run == str(query.id))


#: Groups of keys that share a call and a state map: a call costs far more than a row.
KEY_GROUPS = 4096


class Seen(StatefulProcessor):
    """The times of the accepted rows of a group of keys; rows less than ``ttl_us`` away from one of
    their own key are its duplicates.

    Accepted times of a key lie at least ``ttl_us`` apart, so a slot of that width holds one at most.
    """

    def __init__(self, ttl_us: int, columns: list[str], keep_ms: int | None):
        self.ttl_us, self.columns, self.keep_ms = ttl_us, columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot string", "at long", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows), ignore_index=True)
        times, ids = arrived["at"].tolist(), arrived["id"].tolist()
        # A group that holds nothing yet need not be asked for each of its keys.
        before = self.slots.exists()
        known: dict[tuple[str, int], int | None] = {}

        def at(own: str, slot: int) -> int | None:
            if (own, slot) not in known:
                name = (f"{own}:{slot}",)
                known[own, slot] = self.slots.getValue(name)[0] if before and self.slots.containsKey(name) else None
            return known[own, slot]

        kept = []
        for i in sorted(range(len(times)), key=times.__getitem__):
            slot = times[i] // max(1, self.ttl_us)
            near = [at(ids[i], s) for s in (slot - 1, slot, slot + 1)]
            if all(t is None or abs(times[i] - t) >= self.ttl_us for t in near):
                known[ids[i], slot] = times[i]
                self.slots.updateValue((f"{ids[i]}:{slot}",), (times[i],))
                kept.append(i)
        if kept:
            yield arrived.iloc[sorted(kept)][self.columns]

    def close(self) -> None:
        pass


def dedup_stream(
    sdf: DataFrame, key: str | Sequence[str], ts: str, ttl: str, keep_state: str | None = None
) -> DataFrame:
    """One row per key within ``ttl`` of event time, in keyed state shared by all tasks.

    A key's state is its own: how far other keys have come drops nothing, so a late row that was
    never seen is kept, and a row is compared with the accepted ones before and after it.  All rows
    of a key in a micro-batch are taken in time order, those of one time as they arrive; a null time
    counts as one time of its own.  ``keep_state`` forgets an accepted row so long after it came, by
    the clock; without it state grows with the accepted rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    sdf.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    micros = [round(pd.Timedelta(t).total_seconds() * 1_000_000) if t else None for t in (ttl, keep_state)]
    keep_ms = micros[1] // 1000 if micros[1] else None
    # Names that are no identifiers would not reach the state's rows, so columns go by number.
    numbered = [f"c{i}" for i in range(len(sdf.columns))]
    # A key by two hashes of 64 bits of its parts, nulls told apart; a group by a few bits of another.
    own = [part for k in keys for part in (F.col(f"`{k}`").isNull(), F.col(f"`{k}`"))]
    name = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *own)), 16, "0") for seed in (1, 2)])
    group = F.pmod(F.xxhash64(*own), F.lit(KEY_GROUPS)).cast("int")
    timed = sdf.select("*", order_value(sdf, ts), name, group).toDF(*numbered, "at", "id", "key_group")
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(numbered, sdf.schema, strict=True))
    kept = timed.groupBy("key_group").transformWithStateInPandas(
        Seen(micros[0], numbered, keep_ms), schema, "Append", "ProcessingTime" if keep_ms else "None"
    )
    return kept.toDF(*sdf.columns)


#: Groups of one key that go out in one frame.
GROUPS_A_FRAME = 4096


class Correlator(StatefulProcessor):
    """Members of one key until the group is complete or its time has passed."""

    def __init__(self, expected_count, required, by_branch, timeout_ms, fire):
        self.expected_count, self.required, self.by_branch = expected_count, tuple(required), by_branch
        self.timeout_ms, self.fire = timeout_ms, fire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.members = handle.getListState("members", "ts long, branch string, doc string")

    def _complete(self, members) -> bool:
        if self.required:
            return set(self.required) <= {m[1] for m in members}
        if self.by_branch:
            return len({m[1] for m in members if m[1] is not None}) >= self.expected_count
        return len(members) >= self.expected_count

    @staticmethod
    def _frame(key, groups) -> pd.DataFrame:
        """Groups (members, complete) as rows; one frame for many, since a frame costs far more than a row."""
        return pd.DataFrame({
            "key": [key[0]] * len(groups), "complete": [c for _, c in groups], "n": [len(m) for m, _ in groups],
            "branches": [[b for _, b, _ in m] for m, _ in groups], "docs": [[d for _, _, d in m] for m, _ in groups],
        })

    def _stop_timer(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.members.exists()
        members = [tuple(m) for m in self.members.get()] if held else []
        arrived = pd.concat(list(rows)).sort_values("ts_ms", kind="stable")
        closed: list[tuple[list, bool]] = []
        for ts, branch, doc in zip(arrived["ts_ms"], arrived["branch"], arrived["doc"]):
            if len(closed) >= GROUPS_A_FRAME:
                yield self._frame(key, closed)
                closed = []
            if members and self.timeout_ms is not None and ts >= members[0][0] + self.timeout_ms:
                if self.fire:
                    closed.append((members, False))
                members = []
            # Every member carries the time at which its group opened.
            opened = members[0][0] if members else int(ts)
            if self.by_branch:
                members = [m for m in members if m[1] != branch]
            members.append((opened, branch, doc))
            if self._complete(members):
                closed.append((members, True))
                members = []
        if closed:
            yield self._frame(key, closed)
        if self.timeout_ms is not None:
            self._stop_timer()
        if not members:
            if held:
                self.members.clear()
            return
        self.members.put(members)
        if self.timeout_ms is not None:
            self.handle.registerTimer(members[0][0] + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        members = [tuple(m) for m in self.members.get()] if self.members.exists() else []
        self.members.clear()
        if members and self.fire:
            yield self._frame(key, [(members, False)])

    def close(self) -> None:
        pass


def correlate_stream(
    sdf: DataFrame, group_by: str, ts: str, doc: str, *, expected_count: int = 0, branch_by: str | None = None,
    required: Sequence[str] = (), timeout_seconds: float | None = None, on_timeout: str = "fire",
    lateness: str = "0 seconds",
) -> DataFrame:
    """Correlation with members kept in the checkpoint, so a crash loses none.

    Rows join in event time within a micro-batch; an open group times out on the watermark.
    State per key is bounded: ``expected_count`` members, or the last one of each branch; with
    ``branch_by`` and ``expected_count`` a group needs that many different branches.
    """
    if not required and not expected_count:
        raise ValueError("give expected_count or required")
    if required and not branch_by:
        raise ValueError("required needs branch_by")
    # Spark keeps this kind of state in RocksDB only.
    sdf.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = sdf.schema[group_by].dataType.simpleString()
    timeout_ms = None if timeout_seconds is None else round(timeout_seconds * 1000)
    slim = sdf.select(
        F.col(group_by).alias("key"), F.col(ts).cast("timestamp").alias("at"),
        F.unix_millis(F.col(ts).cast("timestamp")).alias("ts_ms"),
        (F.col(branch_by) if branch_by else F.lit(None)).cast("string").alias("branch"),
        F.col(doc).cast("string").alias("doc"),
    )
    if required:
        slim = slim.where(F.col("branch").isin(list(required)))
    timed = slim.withWatermark("at", lateness) if timeout_ms is not None else slim
    return timed.groupBy("key").transformWithStateInPandas(
        Correlator(expected_count, required, branch_by is not None, timeout_ms, on_timeout == "fire"),
        f"key {kind}, complete boolean, n long, branches array<string>, docs array<string>",
        "Append", "EventTime" if timeout_ms is not None else "None",
    )


# --- change feeds ---------------------------------------------------------------------------


def apply_changes_stream(
    sdf: DataFrame, path: str, key: str | Sequence[str], checkpoint: str, op: str = "op",
    order: Sequence[str] = ("lsn", "ordinal"), **trigger,
):
    """Write a change feed as one collapsed folder per micro-batch.

    The cost of a batch follows its size, not the table's; a replayed batch replaces its own
    folder, so it cannot apply twice.  ``read_applied`` gives the table, ``compact_applied``
    folds the folders into a new base.
    """
    keys = [key] if isinstance(key, str) else list(key)

    def land(batch: DataFrame, batch_id: int) -> None:
        # The last change per key, and the last truncate, in one pass.
        newest = latest_per_key(batch, [*keys, F.col(op) == "truncate"], order)
        newest.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")

    writer = sdf.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_applied(
    spark: SparkSession, path: str, base: DataFrame, key: str | Sequence[str], op: str = "op",
    order: Sequence[str] = ("lsn", "ordinal"),
) -> DataFrame:
    """The current table: the base with every landed change."""
    if not path_exists(spark, f"{path}/changes"):
        return base
    changes = spark.read.parquet(f"{path}/changes").drop("batch")
    return apply_changes(base, changes, key, op, order)


def compact_applied(spark: SparkSession, path: str, base: DataFrame, key, target: str, **names) -> DataFrame:
    """Write the current table to ``target`` as the new base."""
    read_applied(spark, path, base, key, **names).write.parquet(target)
    return spark.read.parquet(target)
