"""Token ids in binary files that are read document by document.

A file is a row of independent zstandard frames. The first hold the ids of the documents in order
(little-endian, two or four bytes each), a long document going on in the next frame; the last one
is the directory: document ids, null marks and counts. A skippable frame with the seek table ends
the file: for each frame its compressed size, its size and a checksum (the low half of xxh64), so
that a reader opens the table, the directory, and the frames of the documents that it wants.

Defined cases: null text is empty, so the document has its end id alone; a null doc_id sorts first;
rows that repeat a doc_id all stay, ordered by a hash of their text; an empty table gives no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluicework.llm.frames import file_system, tasks
from sluicework.llm.text import chunks
from sluicework.llm.tokens import ENCODE_BYTES, encoder

# Fixed values of the seekable zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_BYTES = 1 << 18
LEVEL = 1
MANIFEST = "shard int, path string, documents long, tokens long"


class Writer:
    """Appends documents to one file."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.frames: list[tuple[int, int, int]] = []
        self.codec = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting = bytearray()
        self.ids, self.nulls, self.counts = [], [], []

    def add(self, ids: list, counts: np.ndarray, tokens: np.ndarray):
        """Documents with the given ids, whose tokens lie in ``tokens`` one after another."""
        self.ids.extend(0 if i is None else i for i in ids)
        self.nulls.extend(i is None for i in ids)
        self.counts.append(counts)
        self.waiting += tokens.astype(f"<u{self.width}").tobytes()
        begin = 0
        while len(self.waiting) - begin >= FRAME_BYTES:
            self._frame(self.waiting[begin : begin + FRAME_BYTES])
            begin += FRAME_BYTES
        del self.waiting[:begin]

    def _frame(self, data: bytes):
        packed = self.codec.compress(bytes(data))
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(bytes(data)) & 0xFFFFFFFF))

    def close(self) -> tuple[int, int]:
        """Number of documents and of tokens."""
        if self.waiting:
            self._frame(self.waiting)
        counts = np.concatenate([*self.counts, np.zeros(0, np.int64)])
        n = len(counts)
        directory = np.array([n, self.width], "<i8").tobytes() + np.array(self.ids, "<i8").tobytes()
        self._frame(directory + np.array(self.nulls, np.uint8).tobytes() + counts.astype("<i8").tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        return n, int(counts.sum())


class Reader:
    """Reads a file's directory, then only the frames that are asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, flag, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("not a token file: no seek table with checksums at its end")
        entries = np.frombuffer(self._bytes(size - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.sizes, self.sums = entries[:, 1], entries[:, 2]
        self.places = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self.codec = zstandard.ZstdDecompressor()
        directory = self.frame(count - 1)
        n, self.width = (int(x) for x in np.frombuffer(directory[:16], "<i8"))
        ids = np.frombuffer(directory, "<i8", n, 16)
        nulls = np.frombuffer(directory, np.uint8, n, 16 + 8 * n)
        self.counts = np.frombuffer(directory, "<i8", n, 16 + 9 * n)
        self.ids = pa.array(ids, pa.int64(), mask=nulls.astype(bool))
        self.begins = np.concatenate([[0], np.cumsum(self.counts)])
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes[:-1])])

    def _bytes(self, at: int, size: int) -> bytes:
        return self.source.read_at(size, at)

    def frame(self, i: int) -> bytes:
        data = self.codec.decompress(self._bytes(int(self.places[i]), int(self.places[i + 1] - self.places[i])))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} does not match its checksum")
        return data

    def span(self, first: int, last: int) -> np.ndarray:
        """Ids of the documents from number ``first`` to before ``last``, as unsigned 32 bits."""
        begin, end = int(self.begins[first]) * self.width, int(self.begins[last]) * self.width
        if begin == end:
            return np.zeros(0, "<u4")
        lo = int(np.searchsorted(self.bounds, begin, side="right")) - 1
        hi = int(np.searchsorted(self.bounds, end, side="left"))
        data = b"".join(self.frame(i) for i in range(lo, hi))
        return np.frombuffer(data, f"<u{self.width}", (end - begin) // self.width, begin - int(self.bounds[lo])).astype("<u4")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = 2, width: int = 2) -> DataFrame:
    """Encode whole texts and write one file per range of doc_id below ``path``.

    Returns the manifest: shard, path, documents, tokens. A file takes its name when it is
    complete, so a repeated task leaves one whole file.
    """
    spark = docs.sparkSession
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(tasks(docs), "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )

    def write(batches):
        where, folder = file_system(path)
        shard = TaskContext.get().partitionId()
        target = f"{folder}/shard-{shard:06d}.tok"
        writer = None
        for part in chunks(batches, "text", ENCODE_BYTES):
            if writer is None:
                where.create_dir(folder, recursive=True)
                beginning = f"{target}.{uuid.uuid4().hex}"
                sink = where.open_output_stream(beginning)
                writer = Writer(sink, width)
            tokens, offsets = encoder(vocabulary).encode(part.column("text"), end)
            writer.add(part.column("doc_id").to_pylist(), np.diff(offsets), tokens)
        if writer is not None:
            documents, total = writer.close()
            sink.close()
            if where.get_file_info(target).type.name != "NotFound":
                where.delete_file(target)
            where.move(beginning, target)
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "path": [f"{path}/shard-{shard:06d}.tok"], "documents": [documents], "tokens": [total]}
            )

    manifest = f"{path}/manifest"
    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files below ``path``: doc_id, start, n_tokens, ids_crc32.

    Only the manifest, one short row per file, passes the driver: it gives each file its first start.
    """
    files, base = [], 0
    for row in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy("shard").toLocalIterator():
        files.append((row.path, base))
        base += row.tokens

    def read(batches):
        for part in batches:
            for name, first in zip(part.column("path").to_pylist(), part.column("base").to_pylist(), strict=True):
                where, inner = file_system(name)
                with where.open_input_file(inner) as source:
                    reader = Reader(source)
                    n = len(reader.counts)
                    begin = 0
                    while begin < n:
                        stop = max(begin + 1, int(np.searchsorted(reader.begins, reader.begins[begin] + (1 << 20), side="right")) - 1)
                        data = memoryview(reader.span(begin, stop)).cast("B")
                        at = (reader.begins[begin : stop + 1] - reader.begins[begin]) * 4
                        sums = [zlib.crc32(data[at[i] : at[i + 1]]) for i in range(stop - begin)]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": reader.ids.slice(begin, stop - begin), "start": pa.array(first + reader.begins[begin:stop]),
                            "n_tokens": pa.array(reader.counts[begin:stop]), "ids_crc32": pa.array(sums, pa.int64()),
                        })
                        begin = stop

    listed = spark.createDataFrame(files, "path string, base long").repartition(max(1, len(files)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(path: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """Ids of the wanted documents of one file, decompressing only their frames."""
    where, inner = file_system(path)
    with where.open_input_file(inner) as source:
        reader = Reader(source)
        places = {d: i for i, d in enumerate(reader.ids.to_pylist()) if d in set(doc_ids)}
        return {d: reader.span(i, i + 1) for d, i in places.items()}
