"""Compression and encryption of payload columns.

Encryption stays in the JVM.  Compression uses Arrow batches: Spark has no codec function.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALGORITHMS = ("none", "gzip", "lz4", "zstd")
# The leading bytes of each frame format.
MAGIC = {"gzip": b"\x1f\x8b", "zstd": b"\x28\xb5\x2f\xfd", "lz4": b"\x04\x22\x4d\x18"}


def pack(data: bytes, algorithm: str) -> bytes:
    if algorithm == "none":
        return data
    if algorithm == "gzip":
        return gzip.compress(data, mtime=0)
    if algorithm == "zstd":
        return zstandard.ZstdCompressor().compress(data)
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "lz4") as out:
        out.write(data)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes, algorithm: str, max_bytes: int | None = None) -> bytes:
    """Decompress one frame; the wrong codec, a torn frame or an oversize result raises."""
    if algorithm == "none":
        sniffed = next((n for n, m in MAGIC.items() if data.startswith(m)), None)
        if sniffed:
            raise ValueError(f"payload is {sniffed} data but no compression is declared")
        return data
    if not data.startswith(MAGIC[algorithm]):
        raise ValueError(f"payload is not {algorithm} data")
    chunks, size = [], 0
    with pa.CompressedInputStream(pa.BufferReader(data), algorithm) as stream:
        while chunk := stream.read(1 << 20):
            size += len(chunk)
            if max_bytes is not None and size > max_bytes:
                raise ValueError(f"decompressed payload is over {max_bytes} bytes")
            chunks.append(chunk)
    return b"".join(chunks)


#: Bytes of an Arrow batch that goes to Python, and of one that comes back.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not only by rows, so that a Python worker holds a few payloads
    however many rows its partition has; a smaller bound that is set stays."""
    held = spark.conf.get(_BATCH_SETTING, None)
    number = re.fullmatch(r"(-?\d+)b?", str(held).lower())
    if number is None or not 0 < int(number[1]) <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def _mapped(change: Callable[[bytes], bytes], batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Changed values in arrays of about ``BATCH_BYTES``."""
    for batch in batches:
        out, size = [], 0
        for value in batch:
            changed = change(value.as_py()) if value.is_valid else None
            out.append(changed)
            size += len(changed or b"")
            if size >= BATCH_BYTES:
                yield pa.array(out, pa.binary())
                out, size = [], 0
        yield pa.array(out, pa.binary())


def compress_payload(df: DataFrame, algorithm: str, payload: str = "payload") -> DataFrame:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown compression {algorithm}")

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _mapped(lambda data: pack(data, algorithm), batches)

    bounded_batches(df.sparkSession)
    return df.withColumn(payload, packed(F.col(payload).cast("binary")))


def decompress_payload(
    df: DataFrame, algorithm: str, max_bytes: int | None = None, payload: str = "payload"
) -> DataFrame:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown compression {algorithm}")

    @F.arrow_udf("binary")
    def unpacked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _mapped(lambda data: unpack(data, algorithm, max_bytes), batches)

    bounded_batches(df.sparkSession)
    return df.withColumn(payload, unpacked(F.col(payload)))


def _key_literal(key: bytes) -> Column:
    if len(key) != 32:
        raise ValueError("AES-256 needs a key of 32 bytes")
    return F.lit(bytearray(key))


def encrypt_payload(df: DataFrame, key_id: str, key: bytes, payload: str = "payload") -> DataFrame:
    """AES-256-GCM; the frame starts with the key id and a zero byte, also authenticated."""
    sealed = F.aes_encrypt(
        F.col(payload).cast("binary"), _key_literal(key), F.lit("GCM"), F.lit("DEFAULT"),
        F.lit(bytearray()), F.lit(key_id),
    )
    head = F.lit(bytearray(key_id.encode() + b"\x00"))
    return df.withColumn(payload, F.concat(head, sealed))


def decrypt_payload(df: DataFrame, keys: dict[str, bytes], payload: str = "payload") -> DataFrame:
    """Pick the key by the id in the frame; unknown key, wrong key or torn frame fails the job."""
    column = F.col(payload)
    opened = F.lit(None).cast("binary")
    for key_id, key in keys.items():
        head = bytearray(key_id.encode() + b"\x00")
        clear = F.try_aes_decrypt(
            F.substring(column, len(head) + 1, 2**31 - 1), _key_literal(key), F.lit("GCM"),
            F.lit("DEFAULT"), F.lit(key_id),
        )
        opened = F.when(F.substring(column, 1, len(head)) == F.lit(head), clear).otherwise(opened)
    failed = F.raise_error(F.lit("payload cannot be decrypted: unknown key, wrong key or torn frame"))
    checked = F.when(column.isNull(), F.lit(None)).when(opened.isNotNull(), opened).otherwise(
        failed.cast("binary")
    )
    return df.withColumn(payload, checked)


def seal(df: DataFrame, algorithm: str, key_id: str, key: bytes, payload: str = "payload") -> DataFrame:
    """Compress, then encrypt."""
    return encrypt_payload(compress_payload(df, algorithm, payload), key_id, key, payload)


def unseal(
    df: DataFrame, algorithm: str, keys: dict[str, bytes], max_bytes: int | None = None,
    payload: str = "payload",
) -> DataFrame:
    """Decrypt, then decompress."""
    return decompress_payload(decrypt_payload(df, keys, payload), algorithm, max_bytes, payload)
