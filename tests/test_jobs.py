"""Copy jobs, positions and streams over several runs."""

import json
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluicework.plans import copyjob
from sluicework.plans.copyjob import (
    PositionStore, check_cursor, copy, copy_identity, delivery_label, resume_kind, run_route, run_routes, safe_position,
)
from sluicework.operators import handlers
from sluicework.streaming import filestream, stateful


def _orders(spark, ids):
    return spark.createDataFrame([(i, i * 10) for i in ids], "id long, amount long")


def _lines(path):
    return sorted(json.loads(r.value)["id"] for r in path.collect())


def test_cursor_resume_copies_each_row_once(spark, work):
    source = {"kind": "table", "path": f"{work}/src", "cursor_column": "id", "cursor_id": "orders"}
    sink = {"kind": "raw", "path": f"{work}/out"}
    moved = []
    for ids in ([1, 2, 3], [4, 5], []):
        if ids:
            _orders(spark, ids).write.mode("append").parquet(f"{work}/src")
        moved.append(copy(spark, source, sink, resume=True, state_dir=f"{work}/state").rows)
    assert moved == [3, 2, 0]
    assert _lines(spark.read.text(f"{work}/out")) == [1, 2, 3, 4, 5]
    other = copy(spark, source, {"kind": "raw", "path": f"{work}/out2"}, resume=True, state_dir=f"{work}/state2")
    assert other.rows == 5


def test_filter_counts_and_reports(spark, work):
    _orders(spark, range(1, 6)).write.parquet(f"{work}/src")
    report = copy(spark, {"kind": "table", "path": f"{work}/src"}, {"kind": "null"}, filter="amount > 20")
    assert (report.read, report.rows) == (5, 3)
    assert report.summary().startswith("copied 3 of 5 rows in")
    with pytest.raises(ValueError, match="invalid expression"):
        copy(spark, {"kind": "table", "path": f"{work}/src"}, {"kind": "raw", "path": f"{work}/o"}, filter="amount >")


def test_empty_csv_succeeds_with_zero(spark, work):
    with open(f"{work}/rows.csv", "w") as f:
        f.write("id,name\n")
    report = copy(spark, {"kind": "csv", "path": f"{work}/rows.csv"}, {"kind": "raw", "path": f"{work}/out"})
    assert report.rows == 0 and report.delivery == "at-least-once"


def test_identity_resume_and_delivery():
    source = {"kind": "jdbc", "url": "postgres://u:old@h/db", "table": "t", "cursor_column": None}
    rotated = {"kind": "jdbc", "url": "postgres://u:new@h/db", "table": "t"}
    sink = {"kind": "raw", "path": "/x", "password": "a"}
    first = copy_identity(source, sink)
    assert first.startswith("copy-") and len(first) == 37
    assert first == copy_identity(rotated, {**sink, "password": "b"})
    assert first != copy_identity(source, sink, "id > 1")
    assert first != copy_identity(source, {**sink, "path": "/y"})
    assert resume_kind({"kind": "growing_file"}) == "native"
    assert resume_kind({"kind": "table", "cursor_column": "id"}) == "cursor"
    assert resume_kind({"kind": "objects"}) == "external"
    with pytest.raises(ValueError, match="cannot resume"):
        resume_kind({"kind": "csv"})
    assert delivery_label({"kind": "growing_file"}, {"kind": "idempotent"}) == "effectively-once"
    assert delivery_label({"kind": "csv"}, {"kind": "idempotent"}) == "at-least-once"


def test_position_store(spark, work):
    store = PositionStore(spark, f"{work}/positions")
    assert store.get("a:1") is None
    store.put("a:1", 5)
    store.put("a:1", 12)
    store.put("b:1", "key-9")
    assert (store.get("a:1"), store.get("b:1"), store.get("c")) == (12, "key-9", None)
    with pytest.raises(ValueError):
        store.put("a:1", 1.5)


def test_safe_position_and_cursor_check(spark):
    df = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True), (4, True)], "c long, ok boolean")
    assert safe_position(df, "c", "ok").first().position == 2
    assert safe_position(df.where("ok"), "c", "ok").first().position == 4
    assert tuple(check_cursor(df, "c", 0).first()) == (1, 4, 2, True)
    assert check_cursor(df, "c", 1).first().monotonic is False


def test_object_copy_resumes_after_last_key(spark, work):
    source, sink = {"kind": "objects", "path": f"{work}/in"}, {"kind": "raw", "path": f"{work}/out"}
    moved = []
    for name, text in (("a", "1\n2\n"), ("b", "3\n"), (None, None)):
        if name:
            import os
            os.makedirs(f"{work}/in", exist_ok=True)
            with open(f"{work}/in/{name}.jsonl", "w") as f:
                f.write(text)
        moved.append(copy(spark, source, sink, resume=True, state_dir=f"{work}/state",
                          steps=[lambda df: df.select("payload")]).rows)
    assert moved == [2, 1, 0]
    assert sorted(r.value for r in spark.read.text(f"{work}/out").collect()) == ["1", "2", "3"]


def _append(path, *ids, tail=""):
    with open(path, "a") as f:
        f.write("".join(json.dumps({"id": i}) + "\n" for i in ids) + tail)


def test_growing_file_groups(spark, work):
    path = f"{work}/log.jsonl"
    _append(path, 1, 2, tail='{"id"')
    steps = [lambda df: df.select("payload")]

    def run(group):
        out = f"{work}/{group}"
        report = copy(spark, {"kind": "growing_file", "path": path, "group": group}, {"kind": "raw", "path": out},
                      steps=steps, state_dir=f"{work}/state")
        return report.rows, out

    assert run("g1")[0] == 2
    _append(path, tail=": 3}\n")
    assert run("g1")[0] == 1
    rows, out = run("g2")
    assert rows == 3 and _lines(spark.read.text(out)) == [1, 2, 3]
    rows, out = run("g1")
    assert rows == 0 and _lines(spark.read.text(out)) == [1, 2, 3]


def test_growing_file_ranges_lose_no_line(spark, work):
    path = f"{work}/log.jsonl"
    _append(path, *range(500))
    for size in (1, 7, 10, 64, 100000):
        sdf = filestream.stream_file(spark, path, range_bytes=size) if size > 20 else None
        reader = filestream.GrowingFileReader({"path": path, "rangebytes": str(size)})
        got = [p for part in reader.partitions(reader.initialOffset(), reader.latestOffset())
               for batch in reader.read(part) for p in batch.column(0).to_pylist()]
        assert [json.loads(g)["id"] for g in got] == list(range(500))
        assert sdf is None or sdf.isStreaming


def test_growing_folder_takes_new_files(spark, work):
    import os
    os.makedirs(f"{work}/logs")
    _append(f"{work}/logs/a.jsonl", 1, 2)
    moved = []
    for name, ids in (("a", []), ("b", [3]), ("a", [4])):
        _append(f"{work}/logs/{name}.jsonl", *ids)
        moved.append(copy(spark, {"kind": "growing_file", "path": f"{work}/logs", "group": "g"}, {"kind": "raw", "path": f"{work}/out"},
                          steps=[lambda df: df.select("payload")], state_dir=f"{work}/state").rows)
    assert moved == [2, 1, 1] and _lines(spark.read.text(f"{work}/out")) == [1, 2, 3, 4]


def test_tail_reads_only_new_lines(spark, work):
    path = f"{work}/log.jsonl"
    _append(path, 1, 2)
    query = copy(spark, {"kind": "growing_file", "path": path, "start": "latest"}, {"kind": "raw", "path": f"{work}/out"},
                 steps=[lambda df: df.select("payload")], drain=False, state_dir=f"{work}/state", poll="200 milliseconds")
    try:
        deadline = time.time() + 60
        while not query.recentProgress and time.time() < deadline:
            time.sleep(0.2)
        _append(path, 3)
        query.processAllAvailable()
        while time.time() < deadline:
            query.processAllAvailable()
            rows = _lines(spark.read.schema("value string").text(f"{work}/out"))
            if rows:
                break
        assert rows == [3]
    finally:
        query.stop()


def test_folder_source_archives_input(spark, work):
    import os
    os.makedirs(f"{work}/in")
    source = {"kind": "folder", "path": f"{work}/in", "cleanup": "archive", "archive_dir": f"{work}/done"}
    steps = [lambda df: df.withColumnRenamed("value", "payload")]
    moved = []
    for name, ids in (("a", [1, 2]), ("b", [3])):
        _append(f"{work}/in/{name}.jsonl", *ids)
        moved.append(copy(spark, source, {"kind": "raw", "path": f"{work}/out"}, steps=steps, resume=True,
                          state_dir=f"{work}/state").rows)
    assert moved == [2, 1]
    options = filestream.admission
    assert options("kafka", 5) == {"maxOffsetsPerTrigger": "5"} and options("text", 5) == {"maxFilesPerTrigger": "5"}


def test_routes_from_data(spark, work):
    _orders(spark, range(1, 6)).write.parquet(f"{work}/src")
    route = {"input": {"kind": "table", "path": f"{work}/src"},
             "middlewares": [{"filter": "amount > 20"}, {"mapping": {"id": "$.id"}}],
             "output": {"kind": "raw", "path": f"{work}/out"}}
    with open(f"{work}/routes.json", "w") as f:
        json.dump({"routes": {"orders": route, "off": {**route, "enabled": False}}}, f)
    assert run_route(spark, f"{work}/routes.json", "orders").rows == 3
    assert _lines(spark.read.text(f"{work}/out")) == [3, 4, 5]
    assert list(run_routes(spark, {"orders": route, "off": {**route, "enabled": False}})) == ["orders"]
    with pytest.raises(ValueError, match="unknown middleware"):
        run_route(spark, {"x": {**route, "middlewares": [{"nope": 1}]}})


def _stream(spark, work, name, schema, *batches):
    """A folder stream with one file per batch, read one file per trigger."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{work}/{name}")
        time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/{name}")


def _collect(sdf, work, name):
    q = (sdf.writeStream.format("parquet").option("checkpointLocation", f"{work}/{name}-cp")
         .trigger(availableNow=True).start(f"{work}/{name}-out"))
    q.awaitTermination()
    return sdf.sparkSession.read.parquet(f"{work}/{name}-out"), q


def test_stream_dedup_and_lateness(spark, work):
    schema = "id long, s long"
    sdf = _stream(spark, work, "d", schema, [(1, 0), (2, 0), (1, 5)], [(2, 8), (3, 100)], [(5, 101)], [(4, 1)])
    sdf = sdf.withColumn("ts", F.timestamp_seconds(F.col("s") + 1000))
    out, _ = _collect(stateful.dedup_stream(sdf, "id", "ts", "20 seconds").select("id"), work, "d")
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4, 5]
    timed = stateful.with_lateness(sdf, "ts", "20 seconds").groupBy(F.window("ts", "10 seconds")).count()
    counter = stateful.LateRows()
    spark.streams.addListener(counter)
    try:
        _, query = _collect(timed.select("count"), work, "w")
        assert stateful.late_rows(query) == 1
        assert counter.total(query) == 1
    finally:
        spark.streams.removeListener(counter)


def test_stream_dedup_of_rows_out_of_order(spark, work):
    """A late row doesn't make a key forget the newer one, and Arrow batches don't count."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "2")
    try:
        sdf = _stream(spark, work, "o", "id long, s long", [(1, 100), (2, 255), (2, 240), (2, 230), (2, 245)], [(1, 10)], [(1, 105), (1, 29), (1, 30)])
        sdf = sdf.withColumn("ts", F.timestamp_seconds("s"))
        out, _ = _collect(stateful.dedup_stream(sdf, "id", "ts", "20 seconds").select("id", "s"), work, "o")
    finally:
        spark.conf.set(size, before)
    assert sorted(map(tuple, out.collect())) == [(1, 10), (1, 30), (1, 100), (2, 230), (2, 255)]


def test_stream_correlation_keeps_members(spark, work):
    schema = "cid string, s long, source string, doc string"
    first = [("g", 1, "inventory", "a"), ("h", 1, "pricing", "x")]
    sdf = _stream(spark, work, "c", schema, first, [("g", 3, "pricing", "b")], [("z", 500, "other", "q"), ("z", 501, "pricing", "w")], [("y", 900, "pricing", "v")])
    sdf = sdf.withColumn("ts", F.timestamp_seconds("s"))
    joined = stateful.correlate_stream(sdf, "cid", "ts", "doc", branch_by="source",
                                       required=["inventory", "pricing"], timeout_seconds=60)
    out, _ = _collect(joined, work, "c")
    got = {(r.key, r.complete, tuple(sorted(r.docs))) for r in out.collect()}
    assert {("g", True, ("a", "b")), ("h", False, ("x",)), ("z", False, ("w",))} <= got
    counted = stateful.correlate_stream(sdf, "cid", "ts", "doc", expected_count=2)
    out, _ = _collect(counted, work, "n")
    assert sorted((r.key, tuple(r.docs)) for r in out.collect()) == [("g", ("a", "b")), ("z", ("q", "w"))]


def test_stream_correlation_counts_different_branches(spark, work):
    schema = "cid string, s long, source string, doc string"
    sdf = _stream(spark, work, "b", schema, [("g", 1, "a", "x"), ("g", 2, "a", "y")], [("g", 3, "b", "z")])
    sdf = sdf.withColumn("ts", F.timestamp_seconds("s"))
    out, _ = _collect(stateful.correlate_stream(sdf, "cid", "ts", "doc", branch_by="source", expected_count=2), work, "b")
    assert [(r.key, r.complete, sorted(r.docs)) for r in out.collect()] == [("g", True, ["y", "z"])]


def test_change_stream_is_idempotent(spark, work):
    schema = "op string, key long, amount long, lsn long, ordinal long"
    sdf = _stream(spark, work, "f", schema,
                  [("insert", 1, 10, 1, 0), ("insert", 2, 20, 2, 0), ("update", 1, 11, 3, 0)],
                  [("delete", 2, 0, 4, 0), ("insert", 3, 30, 4, 1)])
    base = spark.createDataFrame([(9, 90, 0, 0), (1, 1, 0, 0)], "key long, amount long, lsn long, ordinal long")
    for _ in range(2):
        stateful.apply_changes_stream(sdf, f"{work}/applied", "key", f"{work}/f-cp").awaitTermination()
    now = stateful.read_applied(spark, f"{work}/applied", base, "key")
    assert sorted((r.key, r.amount) for r in now.collect()) == [(1, 11), (3, 30), (9, 90)]
    again = stateful.apply_changes_stream(sdf, f"{work}/applied", "key", f"{work}/f-cp2")
    again.awaitTermination()
    now = stateful.compact_applied(spark, f"{work}/applied", base, "key", f"{work}/base2")
    assert sorted((r.key, r.amount) for r in now.collect()) == [(1, 11), (3, 30), (9, 90)]


def test_event_handlers_see_the_same_rows(spark, work):
    sdf = _stream(spark, work, "e", "id long", [(1,), (2,)])
    seen = {"a": [], "b": []}
    handlers.on_batch(sdf, [lambda df, i: seen["a"].extend(r.id for r in df.collect()),
                            lambda df, i: seen["b"].append(df.count())], f"{work}/e-cp").awaitTermination()
    assert sorted(seen["a"]) == [1, 2] and seen["b"] == [2]


def test_kafka_options():
    build = filestream.kafka_source_options
    assert build("s", "t", group="g")["startingOffsets"] == "earliest"
    assert build("s", "t")["startingOffsets"] == "latest"
    assert build("s", "t", start='{"t":{"0":5}}', max_rows=10)["maxOffsetsPerTrigger"] == "10"
    assert "subscribePattern" in build("s", "a.*")
    with pytest.raises(ValueError):
        build("s", "t", start="sometimes")


def test_a_copy_accounts_for_rejected_rows(spark, work):
    spark.createDataFrame([("1", "2.5"), ("x", "9")], "id string, amount string").write.parquet(f"{work}/in")
    rules = {"properties": {"id": {"type": "integer"}}}
    route = {"input": {"kind": "table", "path": f"{work}/in"}, "output": {"kind": "raw", "path": f"{work}/out"}}
    with pytest.raises(copyjob.LossyCopy):
        copyjob.run_route(spark, {"r": {**route, "middlewares": [{"types": rules}]}})
    kept = {**rules, "dead_letters": {"kind": "raw", "path": f"{work}/dead"}}
    report = copyjob.run_route(spark, {"r": {**route, "middlewares": [{"types": kept}]}})
    assert (report.read, report.rows, report.rejected) == (2, 1, 1)
    assert spark.read.text(f"{work}/out").count() == 1 and spark.read.text(f"{work}/dead").count() == 1


def test_a_cursor_that_cannot_be_stored_is_refused_first(spark, work):
    spark.createDataFrame([(1, 5)], "id int, s long").selectExpr("id", "timestamp_seconds(s) as ts").write.parquet(f"{work}/in")
    source = {"kind": "table", "path": f"{work}/in", "cursor_column": "ts"}
    with pytest.raises(ValueError, match="cursor of type"):
        copyjob.copy(spark, source, {"kind": "raw", "path": f"{work}/out"}, resume=True, state_dir=f"{work}/s")
    assert not os.path.exists(f"{work}/out")


def test_fanout_and_switch_are_sinks(spark, work):
    spark.createDataFrame([(1,), (5,), (9,)], "id int").write.parquet(f"{work}/in")
    parts = {"small": {"kind": "raw", "path": f"{work}/small"}, "large": {"kind": "raw", "path": f"{work}/large"}}
    sink = {"kind": "fanout", "sinks": [
        {"kind": "raw", "path": f"{work}/all"}, {"kind": "switch", "when": [("id > 4", "large")], "default": "small", "sinks": parts}]}
    copyjob.copy(spark, {"kind": "table", "path": f"{work}/in"}, sink)
    assert [spark.read.text(f"{work}/{n}").count() for n in ("all", "small", "large")] == [3, 1, 2]
    # A switch without default: rows that no branch takes are reported, not counted as copied.
    alone = {"kind": "switch", "when": [("id > 4", "large")], "sinks": {"large": {"kind": "raw", "path": f"{work}/only"}}}
    report = copyjob.copy(spark, {"kind": "table", "path": f"{work}/in"}, alone)
    assert report.read == 3 and report.rows == 2 and any("unrouted 1" in n for n in report.notes)


@pytest.mark.parametrize("source,resume", [({"kind": "folder"}, False), ({"kind": "growing_file"}, True), ({"kind": "parquet", "cursor_column": "s"}, True)])
@pytest.mark.parametrize("step", [
    {"dedup_ttl": {"key": "id", "ts": "s", "tie": "id", "ttl_seconds": 9}},
    {"correlate": {"group_by": "id", "ts": "s", "expected_count": 2}},
])
def test_routes_refuse_to_cut_what_needs_all_rows(spark, work, source, resume, step):
    route = {"input": {**source, "path": f"{work}/none"}, "middlewares": [step], "resume": resume, "state_dir": work}
    with pytest.raises(ValueError, match="needs all rows at once"):
        copyjob.run_route(spark, {"r": route})


def test_copy_in_cursor_ranges_resumes_at_the_failed_range(spark, work):
    from sluicework.operators import routing
    from sluicework.plans import copyjob

    rows = spark.range(1, 1001).select((F.col("id") * 3 % 700).alias("c"), F.col("id"))
    rows.write.parquet(f"{work}/in")
    poison = {"on": True}

    def sink(df):
        if poison["on"] and df.where("c >= 400").count():
            raise RuntimeError("sink failed")
        df.write.mode("append").parquet(f"{work}/out")

    routing.register_named(f"ranges-{work}", sink)
    source = {"kind": "table", "path": f"{work}/in", "cursor_column": "c", "cursor_id": "ranges", "chunk_rows": 150}
    target = {"kind": "named", "name": f"ranges-{work}"}
    with pytest.raises(Exception, match="sink failed"):
        copyjob.copy(spark, source, target, resume=True, state_dir=f"{work}/state")
    first = spark.read.parquet(f"{work}/out")
    top = first.agg(F.max("c")).first()[0]
    # Whole cursor values only: every row of a written value is there, none above it.
    assert first.count() == rows.where(F.col("c") <= top).count() and top < 400
    poison["on"] = False
    report = copyjob.copy(spark, source, target, resume=True, state_dir=f"{work}/state")
    out = spark.read.parquet(f"{work}/out")
    assert sorted(r.id for r in out.collect()) == list(range(1, 1001))
    assert report.position == 699


def test_copy_in_ranges_takes_many_ranges_a_write(spark, work, monkeypatch):
    """Writes grow with the logarithm of the ranges; a failing range stands alone all the same."""
    spark.range(1, 1001).select(F.col("id").alias("c"), F.lit("x").alias("t")).write.parquet(f"{work}/in")
    source = {"kind": "table", "path": f"{work}/in", "cursor_column": "c", "cursor_id": "waves", "chunk_rows": 20}
    target = {"kind": "table", "path": f"{work}/out"}
    writes, append = [], copyjob.file_sinks.append_table
    monkeypatch.setattr(copyjob.file_sinks, "append_table", lambda df, path: (writes.append(path), append(df, path)))
    bad = F.when(F.col("c") == 555, F.raise_error(F.lit("bad row"))).otherwise(F.col("t"))
    with pytest.raises(Exception, match="bad row"):
        copyjob.copy(spark, source, target, steps=[lambda df: df.withColumn("t", bad)], resume=True, state_dir=f"{work}/state")
    assert sorted(r.c for r in spark.read.parquet(f"{work}/out").collect()) == list(range(1, 541))
    report = copyjob.copy(spark, source, target, resume=True, state_dir=f"{work}/state")
    assert sorted(r.c for r in spark.read.parquet(f"{work}/out").collect()) == list(range(1, 1001))
    assert (report.position, report.rows) == (1000, 460) and len(writes) < 25
    stored = {int(r.value) for r in spark.read.parquet(f"{work}/state/positions").collect()}
    assert stored == set(range(20, 1001, 20))
    # A step that needs the rows of its range keeps seeing one range at a time.
    folded = {"kind": "table", "path": f"{work}/folded"}
    copyjob.copy(spark, {**source, "cursor_id": "folded", "chunk_rows": 250}, folded, steps=[lambda df: df.groupBy("t").agg(F.max("c").alias("c"))],
                 resume=True, state_dir=f"{work}/state")
    assert sorted(r.c for r in spark.read.parquet(f"{work}/folded").collect()) == [250, 500, 750, 1000]


def test_stream_dedup_takes_many_keys_a_call(spark, work, monkeypatch):
    """Keys share calls and a state map; keys that differ by a null's place or in later batches stay apart."""
    from sluicework.streaming.stateful import Seen

    asked = []

    class Map:
        def __init__(self):
            self.held = {}

        def exists(self):
            return bool(self.held)

        def containsKey(self, name):
            asked.append(name)
            return name in self.held

        def getValue(self, name):
            return self.held[name]

        def updateValue(self, name, value):
            self.held[name] = value

    seen = Seen(20, ["c0"], None)
    seen.slots = Map()
    first = pd.DataFrame({"c0": [1, 1, 2], "at": [0, 5, 5], "id": ["a", "a", "b"]})
    assert [r for f in seen.handleInputRows(None, [first], None) for r in f["c0"]] == [1, 2] and not asked
    later = pd.DataFrame({"c0": [1, 2, 3], "at": [25, 24, 5], "id": ["a", "b", "c"]})
    assert [r for f in seen.handleInputRows(None, [later], None) for r in f["c0"]] == [1, 3] and asked
    monkeypatch.setattr(stateful, "KEY_GROUPS", 1)
    sdf = _stream(spark, work, "m", "a string, b string, s long", [("x", None, 1), (None, "x", 1), ("x", None, 2)], [(None, "x", 5), ("y", None, 5), (None, None, 5)])
    sdf = sdf.withColumn("ts", F.timestamp_seconds("s"))
    out, _ = _collect(stateful.dedup_stream(sdf, ["a", "b"], "ts", "20 seconds").select("a", "b", "s"), work, "m")
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [("x", None, 1), (None, "x", 1), ("y", None, 5), (None, None, 5)]))


def test_stream_correlation_gives_one_frame_for_many_groups(monkeypatch):
    monkeypatch.setattr(stateful, "GROUPS_A_FRAME", 100)
    one = stateful.Correlator(3, (), False, None, True)

    class Members(list):
        def exists(self):
            return bool(self)

        def get(self):
            return iter(self)

        def put(self, rows):
            self[:] = rows

    one.members = Members()
    rows = pd.DataFrame({"ts_ms": range(1000), "branch": None, "doc": [str(i) for i in range(1000)]})
    made = list(one.handleInputRows((7,), [rows], None))
    docs = [d for frame in made for d in frame["docs"]]
    assert docs == [[str(i), str(i + 1), str(i + 2)] for i in range(0, 999, 3)] and len(made) == 4
    assert [m[2] for m in one.members] == ["999"]
