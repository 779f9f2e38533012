"""Batch file sources. Nothing is inferred: text stays text until a schema types it."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.functions.codecs import MAGIC, bounded_batches, decrypt_payload, unpack
from sluicework.functions.envelopes import EMPTY_METADATA, ENVELOPE_JSON
from sluicework.functions.frames import frame_index, frame_lines
from sluicework.sources.csv_blocks import read_csv_blocks


CODECS = ("none", "gzip", "lz4", "zstd")


def line_separator(delimiter: str) -> str:
    """A single character, or a byte written as ``0x1e``."""
    text = chr(int(delimiter, 16)) if delimiter.lower().startswith("0x") else delimiter
    if len(text) != 1 or ord(text) > 127:
        raise ValueError("the delimiter must be one byte")
    return text


def read_raw(
    spark: SparkSession, path: str | list[str], delimiter: str = "\n", compression: str = "none"
) -> DataFrame:
    """One record per delimiter, verbatim, in ``payload``.

    Plain files are split into ranges.  A declared codec must match the bytes, and compressed
    bytes without a declared codec fail the job.  ``.gz`` is read natively; other frames are
    streamed by the task that owns the file, in constant memory.
    """
    separator = line_separator(delimiter)
    if compression == "none":
        lines = spark.read.option("lineSep", separator).text(path)
        compressed = F.lit(False)
        for magic in MAGIC.values():
            compressed = compressed | F.startswith(F.col("value").cast("binary"), F.lit(bytearray(magic)))
        named = F.input_file_name().rlike(r"\.(gz|zst|lz4)$")
        refuse = F.raise_error(F.lit("input is compressed but no compression is declared"))
        return lines.select(
            F.when(compressed | named, refuse).otherwise(F.col("value")).alias("payload")
        )
    frames = _stored_frames(spark, path)
    if compression == "gzip" and all(name.endswith(".gz") for name in frames.inputFiles()):
        lines = spark.read.option("lineSep", separator).text(path)
        return lines.withColumnRenamed("value", "payload")
    return _lines_of_files(frames, compression, separator)


def _uri(path: str) -> str:
    """A path as Spark names it, as Arrow's file systems name it."""
    return re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", path))


def _opened(path: str, compression: str) -> pa.NativeFile:
    """A decompressing stream over one stored frame; the leading bytes must match the codec."""
    filesystem, name = fs.FileSystem.from_uri(_uri(path))
    with filesystem.open_input_stream(name, compression=None) as head:
        begun = head.read(4)
    if begun and not begun.startswith(MAGIC[compression]):
        raise ValueError(f"{path} is not {compression} data")
    return filesystem.open_input_stream(name, compression=compression if begun else None)


def _split(stream: pa.NativeFile, separator: bytes) -> Iterator[list[str]]:
    """Records of a stream, a megabyte at a time."""
    rest = b""
    while chunk := stream.read(1 << 20):
        *whole, rest = (rest + chunk).split(separator)
        yield [r.decode("utf-8") for r in whole]
    if rest:
        yield [rest.decode("utf-8")]


def _stored_frames(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Paths of the frames.  Content is not selected, so Spark only lists and balances them."""
    return spark.read.format("binaryFile").load(path).select("path")


def _frame_pieces(frames: DataFrame) -> DataFrame:
    """One row per indexed zstd frame of every file (offset, length), or one per unindexed file
    (-1, -1); spread over the tasks so that a large file is read by many."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"path": [], "offset": [], "length": []}
            for path in batch.column("path").to_pylist():
                filesystem, name = fs.FileSystem.from_uri(_uri(path))
                with filesystem.open_input_file(name) as handle:
                    index = frame_index(handle, handle.size())
                    if index is not None and not handle.read_at(4, 0).startswith(MAGIC["zstd"]) and index:
                        raise ValueError(f"{path} is not zstd data")
                for offset, length in index or [(-1, -1)]:
                    out["path"].append(path)
                    out["offset"].append(offset)
                    out["length"].append(length)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    listed = frames.mapInArrow(pieces, "path string, offset long, length long")
    return listed.repartition(max(1, int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _lines_of_files(frames: DataFrame, compression: str, separator: str) -> DataFrame:
    mark = separator.encode()
    if compression == "zstd":
        def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for path, offset, length in zip(batch["path"], batch["offset"], batch["length"], strict=True):
                    if offset < 0:
                        with _opened(path, compression) as stream:
                            for records in _split(stream, mark):
                                yield pd.DataFrame({"payload": pd.Series(records, dtype=object)})
                        continue
                    filesystem, name = fs.FileSystem.from_uri(_uri(path))
                    with filesystem.open_input_file(name) as handle:
                        text = frame_lines(handle, int(offset), int(length))
                    records = text.split(mark)
                    if records and records[-1] == b"":
                        records.pop()
                    yield pd.DataFrame({"payload": pd.Series([r.decode("utf-8") for r in records], dtype=object)})

        return _frame_pieces(frames).mapInPandas(framed, "payload string")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with _opened(path, compression) as stream:
                    for records in _split(stream, mark):
                        yield pd.DataFrame({"payload": pd.Series(records, dtype=object)})

    return frames.mapInPandas(lines, "payload string")


def _lines_of_cells(frames: DataFrame, compression: str) -> DataFrame:
    """Lines of frames held in a ``content`` column; a frame holds whole lines and is small."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                text = unpack(content.as_py(), compression).decode("utf-8")
                if text:
                    yield pa.RecordBatch.from_pydict({"payload": pa.array(text.removesuffix("\n").split("\n"), pa.string())})

    bounded_batches(frames.sparkSession)
    return frames.mapInArrow(lines, "payload string")


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str] | None = None,
    splittable: bool = False,
    compression: str = "none",
) -> DataFrame:
    """CSV with a header row; every field is a string and an empty cell is ``""``.

    Quoted cells may hold line breaks. Uncompressed files are read in blocks by many tasks, the
    record starts of each block settled by the parity of quotes before it (``csv_blocks``). Pass
    ``splittable=True`` for data known to have no line break in a cell: lines are then split by
    Spark's own reader. ``columns`` picks columns by their name in the header; a name that it lacks
    is refused, and so is a file whose header differs from the first one's. The declared
    compression must be the files' own.
    """
    if compression not in CODECS:
        raise ValueError(f"unknown compression {compression}")
    if compression in ("lz4", "zstd"):
        return _csv_of_frames(spark, path, columns, compression)
    if compression == "none" and not splittable:
        return read_csv_blocks(spark, path, columns)
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", not splittable)
        .option("encoding", "UTF-8")
        .option("enforceSchema", False)
    )
    found = reader.csv(path)
    # The names of the listed files, not a test on every row, check the declared codec.
    for name in found.inputFiles():
        if re.search(r"\.(zst|lz4)$", name) or bool(re.search(r"\.gz$", name)) != (compression == "gzip"):
            raise ValueError(f"input {name} is not what the declared compression {compression} says")
    missing = [c for c in columns or [] if c not in found.columns]
    if missing:
        raise ValueError(f"the header has no column {', '.join(missing)}")
    if not found.columns:
        return found
    checked = found.na.fill("")
    return checked.select(*[f"`{c}`" for c in columns]) if columns else checked


def _csv_of_frames(spark, path, columns, compression: str) -> DataFrame:
    """Every frame is a whole CSV file with its own header row."""
    if not columns:
        raise ValueError("reading framed CSV needs the column names")
    names = list(columns)

    def picked(row: dict, name: str) -> str:
        if name not in row:
            raise ValueError(f"the header has no column {name}")
        return row[name]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with _opened(path, compression) as stream:
                    # A cell may be as long as a value can be.
                    csv.field_size_limit((1 << 31) - 1)
                    reader = csv.DictReader(io.TextIOWrapper(stream, encoding="utf-8", newline=""))
                    while chunk := list(islice(reader, 1_000)):
                        yield pd.DataFrame({n: [picked(r, n) for r in chunk] for n in names})

    frames = _stored_frames(spark, path)
    return frames.mapInPandas(rows, ", ".join(f"`{n}` string" for n in names)).na.fill("")


def read_envelope(
    spark: SparkSession, path: str | list[str], encoding: str = "normal", compression: str = "none"
) -> DataFrame:
    """``message_id, payload, metadata`` from one envelope per line.

    ``json``: payload text is the JSON of the payload value.  ``normal``: payload is BINARY,
    from ``payload`` or ``payload_base64``.  ``text``: payload is the string as written.
    """
    lines = read_raw(spark, path, compression=compression).withColumnRenamed("payload", "line")
    metadata = F.coalesce(F.col("e.metadata"), F.expr(EMPTY_METADATA)).alias("metadata")
    parsed = lines.select("line", F.from_json("line", ENVELOPE_JSON, {"mode": "FAILFAST"}).alias("e"))
    if encoding == "json":
        # A nested value comes back as its own text, but a string comes back without quotes, so
        # lines where the payload may be a string take the exact way through a VARIANT.
        exact = F.to_json(F.try_variant_get(F.parse_json("line"), "$.payload", "variant"))
        payload = F.when(F.col("line").rlike(r'"payload"\s*:\s*"'), exact).otherwise(F.col("e.payload"))
        return parsed.select("e.message_id", payload.alias("payload"), metadata)
    if encoding == "text":
        return parsed.select("e.message_id", "e.payload", metadata)
    if encoding != "normal":
        raise ValueError(f"unknown envelope encoding {encoding}")
    body = F.coalesce(F.encode("e.payload", "UTF-8"), F.unbase64("e.payload_base64"))
    return parsed.select("e.message_id", body.alias("payload"), metadata)


def read_encrypted(spark: SparkSession, path: str, keys: dict[str, bytes], compression: str = "none") -> DataFrame:
    """Lines of sealed frames (see ``write_encrypted``): decrypt, decompress, split."""
    frames = decrypt_payload(spark.read.parquet(path).select("content"), keys, "content")
    return _lines_of_cells(frames, compression)


def after_key(df: DataFrame, key: str | None) -> DataFrame:
    """Objects after ``key`` in listing order; the condition prunes files before they open."""
    return df if key is None else df.where(F.col("_metadata.file_path") > key)


def read_objects(
    spark: SparkSession,
    prefix: str,
    last_key: str | None = None,
    max_object_bytes: int | None = None,
    delimiter: str = "\n",
) -> DataFrame:
    """Lines of every object below ``prefix`` after ``last_key``, with its ``object_key``.

    An object over ``max_object_bytes`` fails the read.  Nothing is deleted.
    """
    lines = after_key(
        spark.read.option("lineSep", line_separator(delimiter))
        .option("recursiveFileLookup", True)
        .text(prefix)
        .select("value", "_metadata"),
        last_key,
    )
    payload: Column = F.col("value")
    if max_object_bytes is not None:
        refuse = F.raise_error(
            F.concat(F.lit("object is too large: "), F.col("_metadata.file_path"))
        )
        payload = F.when(F.col("_metadata.file_size") > max_object_bytes, refuse).otherwise(payload)
    return lines.select(payload.alias("payload"), F.col("_metadata.file_path").alias("object_key"))


def with_source_position(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Add file name, block start, size and, where the format knows it (Parquet), the row's index in
    its file as reserved ``src.*`` metadata. ``src.*`` keys that came with the input are removed
    first: a position names where this read found the row, not where an earlier job did."""
    known = F.col(metadata) if metadata in df.columns else F.expr(EMPTY_METADATA)
    known = F.map_filter(known, lambda k, _: ~k.startswith("src."))
    fields = df.select("_metadata.*").columns
    pairs = [
        F.lit("src.file"), F.col("_metadata.file_name"),
        F.lit("src.block_start"), F.col("_metadata.file_block_start").cast("string"),
        F.lit("src.file_size"), F.col("_metadata.file_size").cast("string"),
    ]
    if "row_index" in fields:
        pairs += [F.lit("src.row"), F.col("_metadata.row_index").cast("string")]
    return df.withColumn(metadata, F.map_concat(known, F.create_map(*pairs)))
