"""Best-fit packing in hierarchical rounds.

Pieces, without their tokens, are dealt to tasks of about ``SPREAD`` so that each gets the same mix
of lengths, however the table is split. Every task packs its own best-fit, longest first, and emits
the bins that are nearly full. Underfull bins go on as items: tasks merge eight to one, and each
merged task runs best-fit again, until one is left.

Any two bins of a task hold more than one bin does, so at most one of them is up to half full, and
two bins only merge if one of them is. With n first tasks, at most n bins are ever topped up. A task
with more than ``carry`` underfull bins therefore closes those over half full of which it hands on
n of the same fill; the others come out as if all had been handed on, and the last task is bounded.

Defined cases: null text is empty, so the document is its end id alone; a null doc_id is kept as
null; repeated rows are packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sluicework.llm.frames import staged
from sluicework.llm.text import chunks
from sluicework.llm.tokens import ENCODE_BYTES, encoder

PIECE = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
BINS = "sequence_id long, fill int, closed boolean, members binary"
FAN_IN = 8
#: Pieces that a first task packs.
SPREAD = 1 << 18


def best_fit(lengths: Iterable[int], capacity: int) -> list[list[int]]:
    """Positions of the items in each bin: longest first, each to the bin with the least room that takes it."""
    lengths = list(lengths)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        above = open_rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            place = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
            bins[place].append(i)
        else:
            room, place = capacity, len(bins)
            bins.append([i])
        room -= size
        if room:
            if not rooms[room]:
                open_rooms |= 1 << room
            rooms[room].append(place)
    return bins


def pieces_of(docs: DataFrame, vocabulary: str, end: int, capacity: int):
    """Members of each task's documents, as arrays of PIECE."""

    def cut(batches):
        for part in chunks(batches, "text", ENCODE_BYTES):
            tokens, offsets = encoder(vocabulary, lower=True).encode(part.column("text"), end)
            counts = np.diff(offsets)
            of = np.repeat(np.arange(len(counts)), -(-counts // capacity))
            piece = np.arange(len(of)) - np.searchsorted(of, of)
            out = np.zeros(len(of), PIECE)
            ids = part.column("doc_id")
            out["null"] = np.asarray(ids.is_null())[of]
            out["doc_id"] = ids.fill_null(0).to_numpy()[of]
            out["piece"], out["start"] = piece, piece * capacity
            out["length"] = np.minimum(capacity, counts[of] - piece * capacity)
            data = memoryview(tokens.astype("<u4")).cast("B")
            begins = (offsets[of] + out["start"]) * 4
            out["crc"] = [zlib.crc32(data[a : a + 4 * int(n)]) for a, n in zip(begins.tolist(), out["length"], strict=True)]
            yield out

    return cut


def _pack(groups: list[np.ndarray], level: int, capacity: int, slack: int, carry: int | None, first_tasks: int):
    """Record batches of bins made of ``groups`` of members; all are closed where ``carry`` is None."""
    fills = [int(g["length"].sum()) for g in groups]
    bins = best_fit(fills, capacity)
    totals = np.array([sum(fills[i] for i in b) for b in bins], np.int64)
    closed = totals >= capacity - slack if carry is not None else np.ones(len(bins), bool)
    if carry is not None and (~closed).sum() > carry:
        waiting = np.flatnonzero(~closed & (2 * totals > capacity))
        waiting = waiting[np.argsort(totals[waiting], kind="stable")]
        same = np.arange(len(waiting)) - np.searchsorted(totals[waiting], totals[waiting])
        closed[waiting[same >= first_tasks]] = True
    first = (level << 56) | (TaskContext.get().partitionId() << 32)
    for begin in range(0, len(bins), 2048):
        rows = range(begin, min(begin + 2048, len(bins)))
        yield pa.RecordBatch.from_pydict({
            "sequence_id": pa.array([first + i for i in rows], pa.int64()), "fill": pa.array(totals[rows.start : rows.stop], pa.int32()),
            "closed": pa.array(closed[rows.start : rows.stop]),
            "members": pa.array([np.concatenate([groups[i] for i in bins[b]]).tobytes() for b in rows], pa.binary()),
        })


def pack(docs: DataFrame, vocabulary: str, end: int = 1, capacity: int = 4096, slack: int = 8, carry: int = 4096) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = pieces_of(narrow, vocabulary, end, capacity)

    def cut_up(batches):
        for pieces in cut(batches):
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(pieces)], pa.int64()), "members": pa.array([pieces.tobytes()], pa.binary())})

    pieces = staged(narrow.mapInArrow(cut_up, "n long, members binary"), "pieces")
    first_tasks = width = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // SPREAD))

    def deal(batches):
        for data in (m for b in batches for m in b.column("members").to_pylist()):
            own = np.frombuffer(data, PIECE)
            own = own[np.argsort(-own["length"], kind="stable")]
            hands = range(min(first_tasks, len(own)))
            yield pa.RecordBatch.from_pydict({
                "task": pa.array([(zlib.crc32(data) + i) % first_tasks for i in hands], pa.int32()),
                "members": pa.array([own[i::first_tasks].tobytes() for i in hands], pa.binary()),
            })

    def first(batches):
        members = np.concatenate([*(np.frombuffer(m, PIECE) for b in batches for m in b.column("members").to_pylist()), np.zeros(0, PIECE)])
        members = members[np.lexsort((members["crc"], members["piece"], members["doc_id"], members["null"]))]
        groups = np.split(members, len(members)) if len(members) else []
        yield from _pack(groups, 0, capacity, slack, None if first_tasks == 1 else carry, first_tasks)

    dealt = pieces.mapInArrow(deal, "task int, members binary").repartitionById(first_tasks, F.col("task"))
    rounds = [staged(dealt.mapInArrow(first, BINS), "bins")]
    level = 0
    while width > 1:
        width, level = -(-width // FAN_IN), level + 1
        last = width == 1

        def merge(batches, level=level, last=last):
            groups = [np.frombuffer(m, PIECE) for b in batches for m in b.column("members").to_pylist()]
            yield from _pack(groups, level, capacity, slack, None if last else carry, first_tasks)

        waiting = rounds[-1].where(~F.col("closed")).coalesce(width)
        rounds.append(staged(waiting.mapInArrow(merge, BINS), "bins"))

    def rows(batches):
        for part in batches:
            sizes = [len(m) // PIECE.itemsize for m in part.column("members").to_pylist()]
            all_ = np.frombuffer(b"".join(part.column("members").to_pylist()), PIECE)
            length = all_["length"].astype(np.int64)
            running = np.cumsum(length) - length
            heads = np.cumsum([0, *sizes[:-1]]) if sizes else np.zeros(0, np.int64)
            base = np.repeat(running[heads] if len(all_) else heads, sizes)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(all_["doc_id"], pa.int64(), mask=all_["null"].astype(bool)), "piece": pa.array(all_["piece"], pa.int32()),
                "start": pa.array(all_["start"]), "length": pa.array(length), "ids_crc32": pa.array(all_["crc"].astype(np.int64)),
                "sequence_id": pa.array(np.repeat(part.column("sequence_id").to_numpy(), sizes)), "offset": pa.array(running - base),
            })

    done = reduce(DataFrame.unionByName, [r.where("closed") for r in rounds])
    return done.mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
