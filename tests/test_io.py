"""Sources, sinks, envelopes and codecs: round trips and refusals."""

import gzip
import json
import os

import pytest
import zstandard
from pyspark.sql import functions as F

from sluicework.functions import codecs
from sluicework.functions.envelopes import from_envelope, strip_reserved, to_envelope
from sluicework.functions.texts import mask_text, payload_kind
from sluicework.sinks import files as sinks
from sluicework.sinks import records
from sluicework.sources import files as sources
from sluicework.sources import generators, tables

KEY, OTHER = bytes(range(32)), bytes(range(1, 33))


def _rows(spark, n=200):
    return spark.range(n).select(
        F.col("id"), F.concat(F.lit('line "'), "id", F.lit('", ünï\nx')).alias("text")).repartition(3)


def test_csv_edge_cases(spark, work):
    with open(f"{work}/a.csv", "w", encoding="utf-8") as f:
        f.write('id,note,city\n1,"a, b",Köln\n2,"say ""hi""",\n3,"two\nlines","x"\n')
    rows = {r.id: (r.note, r.city) for r in sources.read_csv(spark, f"{work}/a.csv").collect()}
    assert rows == {"1": ("a, b", "Köln"), "2": ('say "hi"', ""), "3": ("two\nlines", "x")}
    with open(f"{work}/empty.csv", "w") as f:
        f.write("id,note\n")
    assert sources.read_csv(spark, f"{work}/empty.csv").count() == 0


@pytest.mark.parametrize("codec", ["none", "gzip", "lz4", "zstd"])
@pytest.mark.parametrize("sealed", [False, True])
def test_codec_and_cipher_matrix(spark, work, codec, sealed):
    path = f"{work}/out"
    df = _rows(spark)
    if sealed:
        sinks.write_encrypted(df, path, "k1", KEY, codec)
        back = sources.read_encrypted(spark, path, {"k1": KEY, "k0": OTHER}, codec)
    else:
        sinks.write_raw(df, path, codec)
        back = sources.read_raw(spark, path, compression=codec)
    got = sorted((json.loads(r.payload)["id"], json.loads(r.payload)["text"]) for r in back.collect())
    assert got == sorted((r.id, r.text) for r in df.collect())


def test_frames_are_standard_files(spark, work):
    sinks.write_raw(_rows(spark, 20), f"{work}/z", "zstd")
    sinks.write_raw(_rows(spark, 20), f"{work}/g", "gzip")
    names = [n for n in os.listdir(f"{work}/z") if n.startswith("part-")]
    assert names and all(n.endswith(".jsonl.zst") for n in names)
    lines = b"".join(
        zstandard.ZstdDecompressor().stream_reader(open(f"{work}/z/{n}", "rb")).read() for n in names).splitlines()
    assert len(lines) == 20
    packed = [n for n in os.listdir(f"{work}/g") if n.endswith(".gz")]
    assert sum(len(gzip.open(f"{work}/g/{n}").read().splitlines()) for n in packed) == 20


def test_codec_mismatch_is_an_error(spark, work):
    sinks.write_raw(_rows(spark, 5), f"{work}/z", "zstd")
    for wrong in ("none", "gzip", "lz4"):
        with pytest.raises(Exception, match="compress|is not"):
            sources.read_raw(spark, f"{work}/z", compression=wrong).collect()
    os.makedirs(f"{work}/hidden")
    with open(f"{work}/hidden/data.jsonl", "wb") as f:
        f.write(gzip.compress(b'{"id":1}\n'))
    with pytest.raises(Exception, match="no compression is declared"):
        sources.read_raw(spark, f"{work}/hidden").collect()
    assert [r.payload for r in sources.read_raw(spark, f"{work}/hidden", compression="gzip").collect()] == ['{"id":1}']


def test_encryption_refusals(spark, work):
    df = _rows(spark, 4).select("id", F.encode("text", "UTF-8").alias("payload"))
    sealed = codecs.encrypt_payload(df, "k2", KEY)
    assert {bytes(r.payload)[:3] for r in sealed.collect()} == {b"k2\x00"}
    back = codecs.decrypt_payload(sealed, {"k1": OTHER, "k2": KEY})
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    for keys in ({"k2": OTHER}, {"k1": KEY}):
        with pytest.raises(Exception, match="cannot be decrypted"):
            codecs.decrypt_payload(sealed, keys).collect()
    torn = sealed.withColumn("payload", F.expr("substring(payload, 1, length(payload) - 1)"))
    with pytest.raises(Exception, match="cannot be decrypted"):
        codecs.decrypt_payload(torn, {"k2": KEY}).collect()
    with pytest.raises(ValueError, match="32 bytes"):
        codecs.encrypt_payload(df, "k", b"short")
    round_trip = codecs.unseal(codecs.seal(df, "lz4", "k", KEY), "lz4", {"k": KEY})
    assert sorted(map(tuple, round_trip.collect())) == sorted(map(tuple, df.collect()))


def test_decompression_limit_and_corruption(spark):
    df = spark.createDataFrame([(b"x" * 10_000,)], "payload binary")
    packed = codecs.compress_payload(df, "zstd")
    assert len(packed.first().payload) < 200
    with pytest.raises(Exception, match="over 100 bytes"):
        codecs.decompress_payload(packed, "zstd", 100).collect()
    with pytest.raises(Exception, match="is not gzip"):
        codecs.decompress_payload(packed, "gzip").collect()


def test_envelope_formats(spark, work):
    df = spark.createDataFrame(
        [("1", b'{"a":1}', {"k": "v"}), ("2", b"\xff\xfe", {}), ("3", "tëxt".encode(), {})],
        "message_id string, payload binary, metadata map<string,string>")
    sinks.write_envelope(df, f"{work}/n")
    lines = [json.loads(r.value) for r in spark.read.text(f"{work}/n").collect()]
    assert all(("payload" in x) != ("payload_base64" in x) for x in lines)
    back = sources.read_envelope(spark, f"{work}/n")
    assert sorted((r.message_id, bytes(r.payload), r.metadata) for r in back.collect()) == sorted(
        (r.message_id, bytes(r.payload), r.metadata) for r in df.collect())
    text = df.where("message_id != '2'").withColumn("payload", F.col("payload").cast("string"))
    sinks.write_envelope(text, f"{work}/j", "json")
    lines = {x["message_id"]: x["payload"] for x in map(json.loads, [r.value for r in spark.read.text(f"{work}/j").collect()])}
    assert lines == {"1": {"a": 1}, "3": "tëxt"}
    back = {r.message_id: r.payload for r in sources.read_envelope(spark, f"{work}/j", "json").collect()}
    assert back == {"1": '{"a":1}', "3": '"tëxt"'}


def test_envelope_functions(spark):
    df = spark.createDataFrame([(1, "x")], "id int, t string")
    made = to_envelope(df).first()
    assert json.loads(made.payload) == {"id": 1, "t": "x"} and len(made.message_id) == 36 and made.metadata == {}
    opened = from_envelope(to_envelope(df, payload=F.col("t"))).first()
    assert opened.doc is None and opened.text == "x"
    noisy = df.withColumn("metadata", F.expr("map('src.file', 'a', 'kind', 'b')"))
    assert strip_reserved(noisy).first().metadata == {"kind": "b"}


def test_objects(spark, work):
    for name, text in (("a", "1\n2\n"), ("b", "3\n"), ("c", "4" * 100)):
        os.makedirs(f"{work}/o/x", exist_ok=True)
        with open(f"{work}/o/x/{name}.txt", "w") as f:
            f.write(text)
    rows = sources.read_objects(spark, f"{work}/o")
    assert rows.count() == 4
    last = rows.where("payload = '2'").first().object_key
    assert sorted(r.payload for r in sources.read_objects(spark, f"{work}/o", last).collect()) == ["3", "4" * 100]
    with pytest.raises(Exception, match="too large"):
        sources.read_objects(spark, f"{work}/o", max_object_bytes=50).collect()
    assert sinks.object_extension("raw", "gzip") == "jsonl.gz"
    assert sinks.object_extension("csv", "lz4", encrypted=True) == "csv.lz4.enc"
    assert sinks.object_extension("raw", override="dat") == "dat"


def test_delimiters(spark, work):
    with open(f"{work}/d.txt", "w") as f:
        f.write("a\x1eb\nb\x1ec")
    assert [r.payload for r in sources.read_raw(spark, f"{work}/d.txt", "0x1e").collect()] == ["a", "b\nb", "c"]
    with pytest.raises(ValueError):
        sources.line_separator("ab")


def test_idempotent_write_replaces_a_batch(spark, work):
    for n in (3, 3, 2):
        sinks.write_idempotent(spark.range(n), work + "/t", 7)
    assert spark.read.text(f"{work}/t/batch=7").count() == 2


def test_retry_and_drop_report(spark):
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError("down")

    assert records.write_with_retry(flaky, sleep=waits.append) == 3 and waits == [0.1, 0.2]

    def always():
        raise TimeoutError("slow")

    with pytest.raises(records.PermanentError, match="gave up after 2"):
        records.write_with_retry(always, max_attempts=2, sleep=lambda s: None)

    def bad():
        raise ValueError("schema")

    with pytest.raises(ValueError):
        records.write_with_retry(bad, sleep=lambda s: None)
    df = spark.range(10)
    report = records.write_counted(df, sinks.drain, keep=F.col("id") > 3)
    assert (report.read, report.kept, report.filtered, report.dropped) == (10, 6, 4, 0)
    with pytest.raises(records.PermanentError, match="dropped 1 of 10 rows: bad id"):
        records.write_counted(df, sinks.drain, accept=F.col("id") != 5, cause="bad id")


def test_jdbc_options():
    assert tables.jdbc_options("jdbc:x", table="t")["dbtable"] == "t"
    assert tables.jdbc_options("jdbc:x", query="select 1")["dbtable"].startswith("(select 1)")
    ranged = tables.jdbc_options("jdbc:x", table="t", partition_column="id", bounds=(0, 9), partitions=3)
    assert ranged["numPartitions"] == "3" and ranged["upperBound"] == "9"
    for bad in ({}, {"table": "t", "query": "q"}, {"table": "t", "partition_column": "id"}):
        with pytest.raises(ValueError):
            tables.jdbc_options("jdbc:x", **bad)


def test_change_sources(spark):
    raw = spark.createDataFrame([("UPSERT", 1)], "o string, l long")
    with pytest.raises(Exception, match="unknown change operation"):
        tables.read_changes(raw, "o", "l").collect()
    with pytest.raises(ValueError):
        tables.capture("sometimes", raw, raw)


def test_topics(spark):
    df = spark.createDataFrame([("a/b/c",), ("a/b",), ("a",), ("a/x.y/c",), ("ab/c",)], "t string")
    match = lambda p: sorted(r.t for r in generators.where_topic(df, "t", p).collect())
    assert match("a/+/c") == ["a/b/c", "a/x.y/c"]
    assert match("a/#") == ["a", "a/b", "a/b/c", "a/x.y/c"]
    assert match("#") == sorted(["a/b/c", "a/b", "a", "a/x.y/c", "ab/c"])
    assert match("a/b") == ["a/b"] and match("+") == ["a"]
    for bad in ("a/#/b", "a+/b"):
        with pytest.raises(ValueError):
            generators.topic_regex(bad)


def test_payload_kinds_and_masks(spark):
    kinds = [('{"a":1}', "json"), ("[1]", "json"), ("{oops}", "text"), ("<a>b\nc</a>", "xml"), ('<?xml version="1"?><a/>', "xml"),
             ("<a/>", "xml"), ("a\x00b", "hex"), ("plain\ttext\n", "text"), ("", "text")]
    df = spark.createDataFrame(kinds, "t string, k string")
    assert df.where(payload_kind(F.col("t")) != F.col("k")).collect() == []
    masks = [
        ("postgres://u:p@ss@h/db?table=t&password=x", "postgres://u:***@h/db?table=t&password=***"),
        ("kafka://h:9092/topic?partition_key=id", "kafka://h:9092/topic?partition_key=id"),
        ("file:///a|encryption?key=abc&key_id=1|deduplication?key=id", "file:///a|encryption?key=***&key_id=1|deduplication?key=id"),
        ("decrypt_keys?old=abc", "decrypt_keys?old=***"), ("http://h/p?Access_Token=1&flag", "http://h/p?Access_Token=***&flag"),
    ]
    got = spark.createDataFrame(masks, "u string, m string").select(mask_text(F.col("u")).alias("got"), "m").collect()
    assert [r.got for r in got] == [r.m for r in got]


def test_append_table_refuses_a_missing_table(spark, work):
    with pytest.raises(ValueError, match="does not exist"):
        sinks.append_table(spark.range(1), f"{work}/none", create=False)


def test_bench_rows_are_repeatable(spark):
    a, b = (generators.bench_rows(spark, 50, 7, partitions=p).collect() for p in (1, 4))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len({r.id for r in a}) == 50
    assert json.loads(a[0].attributes)["tier"] in generators.TIERS
    assert generators.static_rows(spark, "x", 3, {"a": "b"}).where("metadata['a'] = 'b'").count() == 3


def test_schema_file_and_endpoint(spark, work):
    from pyspark.sql.datasource import DataSource, DataSourceReader

    from sluicework.functions.rules import load_schema, struct_type
    from sluicework.operators.handlers import register_endpoint

    with open(f"{work}/s.json", "w") as f:
        json.dump({"properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}}, f)
    assert struct_type(load_schema(f"{work}/s.json")).simpleString() == "struct<id:bigint,tags:array<string>>"
    with pytest.raises(FileNotFoundError):
        load_schema(f"{work}/none.json")

    class Reader(DataSourceReader):
        def read(self, partition):
            yield (1, "a")

    class Endpoint(DataSource):
        @classmethod
        def name(cls):
            return "two_cells"

        def schema(self):
            return "id int, t string"

        def reader(self, schema):
            return Reader()

    register_endpoint(spark, Endpoint)
    assert [tuple(r) for r in spark.read.format("two_cells").load().collect()] == [(1, "a")]


def test_csv_keeps_blanks_blank_rows_and_long_cells(spark, work):
    rows = [(1, "  lead"), (2, "trail  "), (3, ""), (4, 'a "q", b'), (5, "two\nlines"), (6, "x" * 1_000_000), (7, None)]
    df = spark.createDataFrame(rows, "id int, note string")
    for codec in ("none", "gzip", "zstd"):
        sinks.write_csv(df, f"{work}/{codec}", codec)
        back = sources.read_csv(spark, f"{work}/{codec}", ["note", "id"], compression=codec)
        assert back.columns == ["note", "id"]
        assert {int(r.id): r.note for r in back.collect()} == {i: n or "" for i, n in rows}
        sinks.write_csv(df.select("note").where("id in (3, 4)"), f"{work}/one-{codec}", codec)
        assert sorted(r.note for r in sources.read_csv(spark, f"{work}/one-{codec}", ["note"], compression=codec).collect()) == ["", 'a "q", b']


def test_csv_refuses_unknown_columns_and_other_codecs(spark, work):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    for codec in ("none", "gzip", "zstd"):
        sinks.write_csv(df, f"{work}/{codec}", codec)
        with pytest.raises(Exception, match="no column"):
            sources.read_csv(spark, f"{work}/{codec}", ["nope"], compression=codec).collect()
        for other in {"none", "gzip", "zstd"} - {codec}:
            with pytest.raises(Exception):
                sources.read_csv(spark, f"{work}/{codec}", ["id", "t"], compression=other).select("t").collect()


def test_framed_sinks_honour_the_mode(spark, work):
    df = spark.createDataFrame([(1,)], "id int")
    for mode, n in (("append", 1), ("append", 2), ("overwrite", 1), ("ignore", 1)):
        sinks.write_raw(df, f"{work}/m", "zstd", mode)
        assert sources.read_raw(spark, f"{work}/m", compression="zstd").count() == n
    with pytest.raises(ValueError):
        sinks.write_raw(df, f"{work}/m", "zstd", "error")


def test_batch_folders_have_plain_names(spark, work):
    df = spark.createDataFrame([(1,)], "id int")
    for _ in range(2):
        sinks.write_idempotent(df, f"{work}/b", "copy-file:/x/y.txt")
    assert [n.startswith("batch=") for n in os.listdir(f"{work}/b")] == [True]
    assert spark.read.text(f"{work}/b").count() == 1


def _random_csv(rng, n, names):
    bare = ["plain", "", "ünï", "x" * 300]
    quoted = ["a, b", 'say "hi"', "two\nlines", "three\r\nline\nbreaks", "", '"', 'quoted, "inner"\n end']

    def cell():
        if rng.random() < 0.5:
            return rng.choice(bare)
        return '"' + rng.choice(quoted).replace('"', '""') + '"'

    rows = [",".join(cell() for _ in names) for _ in range(n)]
    return ",".join(names) + "\n" + "\n".join(rows) + ("\n" if rng.random() < 0.5 else "")


def test_quoted_csv_is_read_in_many_blocks(spark, work):
    import csv
    import io
    import random

    from sluicework.sources import csv_blocks

    rng = random.Random(11)
    names = ["a", "b", "c"]
    expected = []
    for i in range(4):
        text = _random_csv(rng, 300, names)
        with open(f"{work}/f{i}.csv", "w", encoding="utf-8", newline="") as f:
            f.write(("﻿" if i == 1 else "") + text)
        expected += [tuple(r) for r in csv.reader(io.StringIO(text, newline=""))][1:]
    expected = [r for r in expected if r]
    for size in (7, 64, 1000, 1 << 20):
        got = csv_blocks.read_csv_blocks(spark, work, block_bytes=size)
        assert got.columns == names
        assert sorted(tuple(r) for r in got.collect()) == sorted(expected), size
    # Blocks by the thousand bytes: many tasks take part, and cells cross their ends.
    assert csv_blocks.read_csv_blocks(spark, work, ["c", "a"], block_bytes=1000).rdd.getNumPartitions() >= 1


def test_quote_parity_finds_record_starts():
    from sluicework.sources import csv_blocks

    data = b'x"\nstill",1\nnext,2\n'
    odd, outside, inside = csv_blocks.first_starts(data, 100)
    assert odd == 0 and outside == 112 and inside == 103
    assert csv_blocks.first_starts(b'"no break', 0) == (1, None, None)


def test_quoted_csv_ragged_rows_headers_and_codecs(spark, work):
    from sluicework.sources import csv_blocks

    with open(f"{work}/a.csv", "w", newline="") as f:
        f.write("id,note\r\n1\r\n2,x,extra\r\n3,\"q\r\nr\"\r\n")
    rows = sorted(tuple(r) for r in csv_blocks.read_csv_blocks(spark, f"{work}/a.csv", block_bytes=5).collect())
    assert rows == [("1", ""), ("2", "x"), ("3", "q\r\nr")]
    with open(f"{work}/b.csv", "w") as f:
        f.write("id,other\n1,2\n")
    with pytest.raises(Exception, match="another header"):
        csv_blocks.read_csv_blocks(spark, work).collect()
    import gzip

    gz = f"{work}/gz"
    os.makedirs(gz)
    with open(f"{gz}/c.csv", "wb") as f:
        f.write(gzip.compress(b"id\n1\n"))
    with pytest.raises(Exception, match="gzip"):
        sources.read_csv(spark, gz).collect()
    empty = f"{work}/empty"
    os.makedirs(empty)
    open(f"{empty}/e.csv", "w").close()
    assert sources.read_csv(spark, empty).columns == []


def test_source_positions_name_file_and_row(spark, work):
    from sluicework.plans import copyjob

    df = spark.range(50).select(F.col("id"), F.create_map(F.lit("src.row"), F.lit("stale"), F.lit("k"), F.lit("v")).alias("metadata"))
    df.coalesce(1).write.parquet(f"{work}/in")
    placed = sources.with_source_position(spark.read.parquet(f"{work}/in"))
    got = [(r.id, r.metadata["src.row"], r.metadata["k"]) for r in placed.collect()]
    assert sorted(got) == [(i, str(i), "v") for i in range(50)]
    copyjob.copy(spark, {"kind": "table", "path": f"{work}/in", "provenance": True}, {"kind": "table", "path": f"{work}/out"})
    out = spark.read.parquet(f"{work}/out")
    assert sorted((r.id, r.metadata["src.row"]) for r in out.collect()) == [(i, str(i)) for i in range(50)]


def test_zstd_files_are_frames_with_an_index(spark, work):
    import io

    import pyarrow as pa

    from sluicework.functions.frames import FrameWriter, frame_index, frame_lines

    buffer = io.BytesIO()
    writer = FrameWriter(buffer, b"head\n", frame_bytes=64)
    for i in range(200):
        writer.write(f"line {i}\n".encode())
    writer.close()
    data = buffer.getvalue()
    index = frame_index(pa.BufferReader(data), len(data))
    assert len(index) > 10
    whole = b"".join(frame_lines(pa.BufferReader(data), o, n) for o, n in index)
    assert whole == b"head\n" + b"".join(f"line {i}\n".encode() for i in range(200))
    # Standard readers see one stream of lines and skip the index.
    assert pa.CompressedInputStream(pa.BufferReader(data), "zstd").read() == whole
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == whole
    assert frame_index(pa.BufferReader(b"plain"), 5) is None
    # A file of several frames is read by several tasks.
    rows = spark.range(400_000).select(F.col("id"), F.lit("x" * 20).alias("t")).coalesce(1)
    sinks.write_raw(rows, f"{work}/z", "zstd")
    back = sources.read_raw(spark, f"{work}/z", compression="zstd")
    assert sorted(json.loads(r.payload)["id"] for r in back.collect()) == list(range(400_000))
    assert back.rdd.getNumPartitions() > 1


def test_payloads_reach_python_in_bounded_batches(spark, work):
    """A worker's memory follows a batch's bytes, not the rows of a partition."""
    import pyarrow as pa


    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, str(1 << 30))
        rows = spark.range(40).select("id", F.when(F.col("id") != 7, F.expr("repeat(cast(id as string), 400000)")).alias("payload"))
        back = codecs.decompress_payload(codecs.compress_payload(rows.coalesce(1), "lz4"), "lz4")
        assert int(spark.conf.get(setting)) == codecs.BATCH_BYTES
        got = {r.id: r.n for r in back.select("id", F.length("payload").alias("n")).collect()}
        assert got == {i: None if i == 7 else 400000 * len(str(i)) for i in range(40)}
        sizes = [sum(len(v.as_py() or b"") for v in a) for a in codecs._mapped(lambda b: b * 3, iter([pa.array([b"x" * (1 << 20), None] * 20)]))]
        assert sum(sizes) == 60 << 20 and max(sizes) <= codecs.BATCH_BYTES + (3 << 20)
        spark.conf.set(setting, "1000")
        codecs.bounded_batches(spark)
        assert spark.conf.get(setting) == "1000"
    finally:
        spark.conf.set(setting, before)


def test_sealed_frames_are_bounded(spark, work):
    key = bytes(range(32))
    rows = spark.range(0, 60, 1, 1).select(F.expr("repeat(cast(id % 10 as string), 200000)").alias("t"), "id")
    sinks.write_encrypted(rows, f"{work}/sealed", "k", key, "none")
    held = spark.read.parquet(f"{work}/sealed").select(F.length("content").alias("n")).collect()
    assert len(held) >= 6 and max(r.n for r in held) < (2 << 20) + 300000
    back = sources.read_encrypted(spark, f"{work}/sealed", {"k": key}, "none")
    assert sorted(int(r.id) for r in back.select(F.get_json_object("payload", "$.id").alias("id")).collect()) == list(range(60))
