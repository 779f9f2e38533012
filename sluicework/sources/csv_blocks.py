"""CSV files read in byte ranges by many tasks, also where quoted cells hold line breaks.

A line break ends a record only outside quotes, and whether a byte lies inside quotes depends on
every quote before it in the file. Two passes settle that without reading a file in one task:

1. Every block (``block_bytes`` of a file) counts its quotes and notes, for both cases (the block
   begins outside or inside a quoted cell), where its first record begins: after its first line
   break that is outside quotes in that case.
2. A running parity of the quote counts over the blocks of a file (a window by file, ordered by
   block) says which case is true for each block. A block then parses the records from its true
   first start up to the next block's, reading past its own end for its last record; a block in
   which no record begins (all inside one long cell) parses nothing, its neighbour reads the cell.

Quotes follow RFC 4180: a doubled quote inside a quoted cell is a quote, so it changes no parity.
Only counts and offsets pass between tasks; records are parsed where their bytes are read. Files are
opened through Arrow's file systems, so paths are URIs they know or shared mounts.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.csv as pacsv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicework.functions.codecs import MAGIC

BLOCK_BYTES = 16 << 20
#: Bytes searched at once for quotes and line breaks.
STEP = 1 << 20
QUOTE, NEWLINE = 34, 10


def _file(path: str):
    from sluicework.sources.files import _uri

    filesystem, name = fs.FileSystem.from_uri(_uri(path))
    return filesystem.open_input_file(name)


def first_starts(data: bytes, offset: int) -> tuple[int, int | None, int | None]:
    """Quote count parity of ``data``, and the first record start for a block that begins outside
    quotes and for one that begins inside them (absolute offsets; None where there is none)."""
    starts: list[int | None] = [None, None]
    quotes = 0
    for at in range(0, len(data), STEP):
        piece = np.frombuffer(data, np.uint8, count=min(STEP, len(data) - at), offset=at)
        if None in starts:
            breaks = np.flatnonzero(piece == NEWLINE)
            if len(breaks):
                before = quotes + np.cumsum(piece == QUOTE)[breaks]
                for case in (0, 1):
                    if starts[case] is None:
                        outside = np.flatnonzero((before + case) % 2 == 0)
                        if len(outside):
                            starts[case] = offset + at + int(breaks[outside[0]]) + 1
        quotes += int(np.count_nonzero(piece == QUOTE))
    return quotes % 2, starts[0], starts[1]


def _header_of(path: str) -> list[str] | None:
    """The first record of a file, read until it ends; None for an empty file."""
    with _file(path) as handle:
        data, size = b"", handle.size()
        while len(data) < size:
            data += handle.read_at(min(STEP, size - len(data)), len(data))
            _, end, _ = first_starts(data, 0)
            if end is not None:
                data = data[:end]
                break
    return _records(data.removeprefix(b"\xef\xbb\xbf"), None)[0] if data.strip() else None


def _records(data: bytes, width: int | None) -> list[list[str]]:
    """Records of whole CSV lines; missing cells are empty, cells beyond ``width`` dropped."""
    rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline=""), strict=False) if r]
    if width is not None:
        rows = [(r + [""] * width)[:width] for r in rows]
    return rows


def _parsed(data: bytes, names: list[str]) -> pa.Table:
    """All cells as text; Arrow's parser where the records are regular, Python's otherwise."""
    try:
        return pacsv.read_csv(
            pa.BufferReader(data),
            read_options=pacsv.ReadOptions(column_names=[f"c{i}" for i in range(len(names))], use_threads=False),
            parse_options=pacsv.ParseOptions(newlines_in_values=True, double_quote=True),
            convert_options=pacsv.ConvertOptions(
                column_types={f"c{i}": pa.string() for i in range(len(names))}, strings_can_be_null=False, quoted_strings_can_be_null=False
            ),
        ).rename_columns(names)
    except (pa.ArrowInvalid, UnicodeDecodeError):
        rows = _records(data, len(names))
        return pa.table({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(names)})


def read_csv_blocks(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """CSV with a header row, every cell text and an empty cell ``""``, read in blocks of a file.

    ``columns`` picks columns by header name; a missing name is refused, and so is a file whose
    header differs from the first file's, or whose bytes are compressed.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    first = files.where("length > 0").orderBy("path").limit(1).collect()
    header = _header_of(first[0].path) if first else None
    if header is None:
        return spark.createDataFrame([], "dummy string").select()
    if len(set(header)) != len(header):
        raise ValueError("the header names a column twice")
    missing = [c for c in columns or [] if c not in header]
    if missing:
        raise ValueError(f"the header has no column {', '.join(missing)}")

    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / block_bytes) - 1, F.lit(0)))).alias("block"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = {"odd": [], "outside": [], "inside": []}
            for path, length, block in zip(*(part.column(c).to_pylist() for c in ("path", "length", "block")), strict=True):
                begin = block * block_bytes
                with _file(path) as handle:
                    data = handle.read_at(max(0, min(block_bytes, length - begin)), begin)
                if block == 0:
                    sniffed = next((n for n, m in MAGIC.items() if data.startswith(m)), None)
                    if sniffed:
                        raise ValueError(f"{path} is {sniffed} data but no compression is declared")
                odd, outside, inside = first_starts(data, begin)
                out["odd"].append(odd)
                out["outside"].append(outside)
                out["inside"].append(inside)
            yield pa.RecordBatch.from_arrays(
                [part.column("path"), part.column("length"), part.column("block"), pa.array(out["odd"], pa.int32()),
                 pa.array(out["outside"], pa.int64()), pa.array(out["inside"], pa.int64())],
                names=["path", "length", "block", "odd", "outside", "inside"],
            )

    counted = blocks.mapInArrow(scan, "path string, length long, block long, odd int, outside long, inside long")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("path").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    parity = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    placed = counted.withColumn("start", F.when(F.col("block") == 0, F.lit(0)).when(parity == 0, F.col("outside")).otherwise(F.col("inside")))
    ranges = placed.withColumn("end", F.coalesce(F.first("start", ignorenulls=True).over(after), F.col("length"))).where(F.col("start").isNotNull())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for path, start, end, block in zip(*(part.column(c).to_pylist() for c in ("path", "start", "end", "block")), strict=True):
                with _file(path) as handle:
                    data = handle.read_at(end - start, start)
                if block == 0:
                    data = data.removeprefix(b"\xef\xbb\xbf")
                    _, cut, _ = first_starts(data, 0)
                    own = _records(data[: cut if cut is not None else len(data)], None)
                    if own and own[0] != header:
                        raise ValueError(f"{path} has another header than the first file")
                    data = data[cut:] if cut is not None else b""
                if data.strip():
                    yield from _parsed(data, header).to_batches()

    schema = ", ".join(f"`{n}` string" for n in header)
    rows = ranges.select("path", "start", "end", "block").mapInArrow(parse, schema)
    return rows.select(*[f"`{c}`" for c in columns]) if columns else rows
