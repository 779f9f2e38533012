"""Batch file sinks. Every write is a distributed Spark write; no row passes the driver."""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.functions.codecs import ALGORITHMS, bounded_batches, encrypt_payload, pack
from sluicework.functions.frames import FrameWriter
from sluicework.functions.envelopes import envelope_json
from sluicework.session import path_exists, qualified

# File name endings per format and codec.
FORMAT_EXTENSION = {"raw": "jsonl", "json": "jsonl", "normal": "jsonl", "text": "jsonl", "csv": "csv"}
CODEC_EXTENSION = {"none": "", "gzip": ".gz", "lz4": ".lz4", "zstd": ".zst"}
#: Files published at once by the driver.
PUBLISHERS = 16
#: Bytes of lines in a sealed frame, or one line's if that is longer.
FRAME_BYTES = 2 << 20


def object_extension(
    encoding: str, compression: str = "none", encrypted: bool = False, override: str | None = None
) -> str:
    """File name ending from format, codec and encryption."""
    if override is not None:
        return override
    base = FORMAT_EXTENSION.get(encoding, "bin")
    return base + CODEC_EXTENSION[compression] + (".enc" if encrypted else "")


def row_json(df: DataFrame) -> Column:
    """A whole row as JSON text, or the payload alone where the frame is an envelope."""
    if df.columns == ["payload"]:
        return F.col("payload")
    if "payload" in df.columns and "message_id" in df.columns:
        return F.col("payload").cast("string")
    return F.to_json(F.struct("*"))


def encoded(df: DataFrame, encoding: str) -> DataFrame:
    """Rows as the ``value`` lines of a text sink."""
    line = row_json(df) if encoding == "raw" else envelope_json(df, encoding)
    return df.select(line.alias("value"))


def write_lines(lines: DataFrame, path: str, compression: str = "none", mode: str = "append") -> None:
    """Write ``value`` lines. gzip is Spark's own; lz4 and zstd are standard frames."""
    if compression not in ALGORITHMS:
        raise ValueError(f"unknown compression {compression}")
    if compression in ("none", "gzip"):
        writer = lines.write.mode(mode)
        (writer.option("compression", "gzip") if compression == "gzip" else writer).text(path)
        return
    _write_frames(lines, path, compression, mode)


def _write_frames(
    lines: DataFrame, path: str, compression: str, mode: str, ending: str = "jsonl", header: str = ""
) -> None:
    """Each task streams its rows into one frame file; only finished attempts are published.

    A lost or repeated attempt leaves an unpublished file below ``_pending`` and no duplicate.
    ``mode`` is Spark's: with ``overwrite`` the files of before go once the new ones are there.
    """
    ending += CODEC_EXTENSION[compression]
    run = uuid.uuid4().hex[:12]
    target = qualified(lines.sparkSession, path)
    filesystem, root = fs.FileSystem.from_uri(target)
    listed = filesystem.get_file_info(fs.FileSelector(root, allow_not_found=True))
    earlier = [f.path for f in listed if f.type == fs.FileType.File and not f.base_name.startswith("_")]
    if mode not in ("append", "overwrite", "ignore", "error", "errorifexists"):
        raise ValueError(f"unknown mode {mode}")
    if earlier and mode == "ignore":
        return
    if earlier and mode in ("error", "errorifexists"):
        raise ValueError(f"{path} holds files already")
    filesystem.create_dir(f"{root}/_pending", recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remote, base = fs.FileSystem.from_uri(target)
        name = f"part-{run}-{uuid.uuid4().hex}.{ending}"
        stream, rows = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if stream is None:
                raw = remote.open_output_stream(f"{base}/_pending/{name}", compression=None)
                # zstd: independent frames and their index, so that readers can split the file.
                stream = FrameWriter(raw, header.encode()) if compression == "zstd" else pa.CompressedOutputStream(raw, compression)
                if compression != "zstd":
                    stream.write(header.encode())
            stream.write(("\n".join(batch.column(0).to_pylist()) + "\n").encode())
            rows += batch.num_rows
        if stream is not None:
            stream.close()
            raw.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "rows": [rows]})

    # One row per task comes back: the names of the files to publish, moved by several threads
    # at once (on object stores a move is a copy).
    done = [d["name"] for d in lines.select("value").mapInArrow(store, "name string, rows long").collect()]
    with ThreadPoolExecutor(max_workers=PUBLISHERS) as pool:
        list(pool.map(lambda name: filesystem.move(f"{root}/_pending/{name}", f"{root}/{name}"), done))
    if mode == "overwrite":
        for name in earlier:
            filesystem.delete_file(name)


def write_raw(df: DataFrame, path: str, compression: str = "none", mode: str = "append") -> None:
    """Payload only, one row per line, no envelope."""
    write_lines(encoded(df, "raw"), path, compression, mode)


def write_envelope(
    df: DataFrame, path: str, encoding: str = "normal", compression: str = "none", mode: str = "append"
) -> None:
    write_lines(encoded(df, encoding), path, compression, mode)


def write_csv(df: DataFrame, path: str, compression: str = "none", mode: str = "append") -> None:
    """One header per file, values as text in column order; null is an empty cell.

    Blanks around a value stay.  Where a frame has one column, an empty cell is quoted, since a
    blank line would be no row.
    """
    text = df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    options = {
        "escape": '"', "emptyValue": '""' if len(df.columns) == 1 else "",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }
    if compression in ("lz4", "zstd"):
        header = ",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n\r') else c for c in df.columns)
        _write_frames(text.select(F.to_csv(F.struct("*"), options).alias("value")), path, compression, mode, "csv", header + "\n")
        return
    writer = text.write.mode(mode).option("header", True).options(**options)
    (writer.option("compression", "gzip") if compression == "gzip" else writer).csv(path)


def write_encrypted(
    df: DataFrame, path: str, key_id: str, key: bytes, compression: str = "none", mode: str = "append"
) -> None:
    """Compress then encrypt: sealed frames of about ``FRAME_BYTES`` of lines, kept as binary rows."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, size = [], 0
            for i, value in enumerate(batch.column(0), 1):
                lines.append(value.as_py())
                size += len(lines[-1])
                if size >= FRAME_BYTES or i == batch.num_rows:
                    body = ("\n".join(lines) + "\n").encode()
                    yield pa.RecordBatch.from_pydict({"content": pa.array([pack(body, compression)], pa.binary())})
                    lines, size = [], 0

    bounded_batches(df.sparkSession)
    sealed = encrypt_payload(encoded(df, "raw").mapInArrow(frames, "content binary"), key_id, key, "content")
    sealed.write.mode(mode).parquet(path)


def write_objects(
    df: DataFrame, prefix: str, encoding: str = "raw", date_partition: bool = True, now: Column | None = None
) -> None:
    """Immutable objects below ``prefix``, by write date (UTC) when asked."""
    if not date_partition:
        encoded(df, encoding).write.mode("append").text(prefix)
        return
    line = row_json(df) if encoding == "raw" else envelope_json(df, encoding)
    at = now if now is not None else F.current_timestamp()
    dated = df.select(
        line.alias("value"), F.date_format(at, "yyyy").alias("year"), F.date_format(at, "MM").alias("month"),
        F.date_format(at, "dd").alias("day"),
    )
    dated.write.mode("append").partitionBy("year", "month", "day").text(prefix)


def write_idempotent(df: DataFrame, directory: str, batch_id: int | str, encoding: str = "raw") -> None:
    """A folder per batch id, replaced whole: a replay of the batch leaves the same files."""
    name = str(batch_id)
    if not re.fullmatch(r"[A-Za-z0-9_.-]{1,100}", name):
        # A position may be a path or any text; a folder's name may not.
        name = hashlib.sha256(name.encode()).hexdigest()[:32]
    encoded(df, encoding).write.mode("overwrite").text(f"{directory}/batch={name}")


def drain(df: DataFrame) -> None:
    """Run the plan and discard the rows."""
    df.write.format("noop").mode("overwrite").save()


def append_table(df: DataFrame, path: str, create: bool = True) -> None:
    """Append to a Parquet table, by column name.  ``create=False`` refuses a missing table."""
    spark = df.sparkSession
    if not path_exists(spark, path):
        if not create:
            raise ValueError(f"table does not exist: {path}")
        df.write.parquet(path)
        return
    existing = spark.read.parquet(path).schema
    df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in existing]).write.mode("append").parquet(path)


def project_tokens(df: DataFrame, mapping: dict[str, str], schema: dict[str, str] | None = None) -> DataFrame:
    """Insert columns from ``${payload:field}``, ``${metadata:key}`` or a literal.

    ``schema`` names the SQL type a payload field keeps; without it the field is text.
    Absent and non-scalar fields are NULL.
    """
    doc = F.try_parse_json("payload")
    out = []
    for name, token in mapping.items():
        if token.startswith("${payload:") and token.endswith("}"):
            path = f"$.{token[10:-1]}"
            kind = (schema or {}).get(name, "string")
            shape = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
            scalar = ~(shape.startswith("OBJECT") | shape.startswith("ARRAY"))
            out.append(F.when(scalar, F.try_variant_get(doc, path, kind)).alias(name))
        elif token.startswith("${metadata:") and token.endswith("}"):
            out.append(F.col("metadata")[token[11:-1]].alias(name))
        else:
            out.append(F.lit(token).alias(name))
    return df.select(*out)
