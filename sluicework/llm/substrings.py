"""Removal of repeated passages with suffix automata of reference shards.

A window is ``window`` consecutive words. A word goes if a window over it also starts earlier:
in a document of a smaller id, or earlier in the same one.

The corpus cannot be matched against automata of itself shard by shard, which would take as many
passes as there are shards, and reference text as large as the corpus cannot be broadcast. So the
shards are routed instead: every window has an anchor, its word 5-gram of the smallest hash. Anchors
that occur once need no further look. A stretch of windows around one anchor goes, with its text,
to the shard of that anchor, where equal windows always meet. A shard streams its stretches in
document order through the suffix automaton of those before: the matching statistics tell where
a window's words have occurred, and the state tells where first. Then the stretch joins the
automaton. Windows of very frequent anchors have a shard each, and tasks send the first of equal
windows only, so neither a common passage nor many contexts of one make a shard large.

Broadcast is a Bloom filter of repeated anchors of a fixed size, ``filter_bits``; beyond its room
more stretches are sent, with the same result.

Defined cases: null text has no words; a document with a null doc_id is left whole and is no
reference; rows that share doc_id and text are one document, rows that share only doc_id are in the
order of a hash of their text; an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from sluicework.llm.frames import tasks
from sluicework.llm.text import SEPARATORS, Words, chunks, grams, mix

ANCHOR = 5
#: Anchors that occur as often have a shard for each window instead of one for all.
FREQUENT = 1000
SLICES = 256
#: Bytes of text within which equal windows are sent once.
SEND_BYTES = 2 << 20


class SuffixAutomaton:
    """All substrings of the sequences added so far, and where each first ended."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, edges: dict, link: int, length: int, first) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, q: int, symbol) -> int:
        """The state of the string to p with ``symbol``, taken out of q where q holds longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first[q])
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, symbols: list, places: list) -> None:
        """Add a sequence; ``places`` tells where each symbol stands."""
        last = 0
        for symbol, place in zip(symbols, places, strict=True):
            q = self.next[last].get(symbol)
            if q is not None:
                last = self._split(last, q, symbol)
                continue
            new, p = self._state({}, 0, self.length[last] + 1, place), last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, self.next[p][symbol], symbol)
            last = new

    def firsts(self, symbols: list, size: int) -> list:
        """For each symbol, where the ``size`` symbols up to it first ended; None where they never did."""
        state = matched = 0
        out = []
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                matched += 1
            while state and self.length[self.link[state]] >= size:
                state = self.link[state]
                matched = self.length[state]
            out.append(self.first[state] if matched >= size else None)
        return out


class Windows:
    """The windows of a batch of texts, with their anchors."""

    def __init__(self, texts: pa.Array, window: int):
        self.words = Words(texts, SEPARATORS)
        hashes, rows = self.words.hashes(), self.words.rows()
        n = len(hashes) - window + 1
        if n <= 0:
            self.starts = self.rows = self.anchors = np.zeros(0, np.int64)
            self.values = np.zeros(0, np.uint64)
            return
        small = grams(hashes, ANCHOR)
        self.starts = np.flatnonzero(rows[:n] == rows[window - 1 :])
        self.rows = rows[self.starts]
        view = sliding_window_view(small, window - ANCHOR + 1)
        at = np.concatenate([view[i : i + 65536].argmin(axis=1) for i in range(0, n, 65536)])
        self.anchors = (np.arange(n) + at)[self.starts]
        self.values = small[self.anchors]
        self.hashes = hashes

    def changes(self) -> np.ndarray:
        """Where the anchor differs from the window before; anchors of other rows are other places."""
        return np.flatnonzero(np.diff(self.anchors, prepend=-1))

    def names(self, window: int, which: np.ndarray) -> np.ndarray:
        return grams(self.hashes, window)[self.starts[which]]


def _filter_places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slice, and two bits within it, of each value."""
    h = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    room = np.uint64(bits // SLICES)
    return (h >> np.uint64(56)).astype(np.int64), ((h & np.uint64(0xFFFFFFF)) % room).astype(np.int64), ((h >> np.uint64(28) & np.uint64(0xFFFFFFF)) % room).astype(np.int64)


class AnchorFilter:
    """Which anchors may occur twice, and which may be frequent."""

    def __init__(self, slices: dict[int, tuple[bytes, bytes]], bits: int):
        self.bits = bits
        nothing = bytes(bits // SLICES // 8)
        self.tables = [np.frombuffer(b"".join(slices.get(i, (nothing, nothing))[k] for i in range(SLICES)), np.uint8) for k in range(2)]

    def holds(self, values: np.ndarray, table: int) -> np.ndarray:
        part, a, b = _filter_places(values, self.bits)
        base = part * (self.bits // SLICES)
        out = np.ones(len(values), bool)
        for at in (base + a, base + b):
            out &= (self.tables[table][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _anchor_filter(docs: DataFrame, window: int, bits: int) -> AnchorFilter:
    def count(batches):
        for part in chunks(batches, "text"):
            w = Windows(part.column("text"), window)
            values, n = np.unique(w.values[w.changes()], return_counts=True)
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(values.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    def build(batches):
        tables: dict[int, np.ndarray] = {}
        for part in batches:
            values, often = part.column("anchor").to_numpy().view(np.uint64), part.column("n").to_numpy() >= FREQUENT
            slices, a, b = _filter_places(values, bits)
            for i in np.unique(slices).tolist():
                table = tables.setdefault(i, np.zeros((2, bits // SLICES), bool))
                for at in (a, b):
                    table[0, at[slices == i]] = True
                    table[1, at[(slices == i) & often]] = True
        for i, table in tables.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), **{k: [np.packbits(t, bitorder="little").tobytes()] for k, t in zip(("repeated", "frequent"), table, strict=True)}})

    def slice_of(batches):
        for part in batches:
            slices, _, _ = _filter_places(part.column("anchor").to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([part.column("anchor"), part.column("n"), pa.array(slices, pa.int32())], names=["anchor", "n", "slice"])

    counted = docs.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    parts = counted.mapInArrow(slice_of, "anchor long, n long, slice int").repartition(min(SLICES, tasks(docs)), "slice")
    # Two bitmaps of filter_bits in all, whatever the corpus.
    rows = parts.mapInArrow(build, "slice int, repeated binary, frequent binary").collect()
    return AnchorFilter({r["slice"]: (bytes(r["repeated"]), bytes(r["frequent"])) for r in rows}, bits)


_STRETCH = "key long, doc_id long, text_hash long, start long, n long, text binary"


def _stretches(part: pa.RecordBatch, window: int, known: AnchorFilter):
    """Stretches of windows to look up, and (text null) those that surely repeat within the batch."""
    w = Windows(part.column("text"), window)
    heads = w.changes()
    if not len(heads):
        return
    sizes = np.diff(np.append(heads, len(w.anchors)))
    values = w.values[heads]
    which = np.flatnonzero(np.repeat(known.holds(values, 0), sizes))
    if not len(which):
        return
    frequent = np.repeat(known.holds(values, 1), sizes)[which]
    names = w.names(window, which)
    rows, starts = w.rows[which], w.starts[which] - w.words.heads[w.rows[which]]
    docs, texts = part.column("doc_id").to_numpy(), part.column("text_hash").to_numpy()
    order = np.lexsort((starts, texts[rows], docs[rows], names))
    name, row, start = names[order], rows[order], starts[order]
    first = np.searchsorted(name, name)
    other = (docs[row] != docs[row[first]]) | (texts[row] != texts[row[first]]) | (start != start[first])
    later = np.zeros(len(which), bool)
    later[order] = other
    lead = np.zeros(len(which), bool)
    lead[order] = first == np.arange(len(name))

    def runs(chosen: np.ndarray, by: np.ndarray):
        """First and number of windows of each run of chosen neighbours with one value of ``by``."""
        at = np.flatnonzero(chosen)
        if not len(at):
            return at, at
        new = np.concatenate([[True], (np.diff(which[at]) != 1) | (by[at][1:] != by[at][:-1])])
        head = np.flatnonzero(new)
        return at[head], np.diff(np.append(head, len(at)))

    anchors = w.anchors[which]
    at, n = runs(later, rows)
    marks = (docs[rows[at]] * 31 + starts[at] // 4096, docs[rows[at]], texts[rows[at]], starts[at], n)
    at, n = runs(lead, np.where(frequent, np.arange(len(which)), anchors))
    begin = w.starts[which[at]]
    a, b = w.words.starts[begin], w.words.ends[begin + n + window - 2]
    data = w.words.raw.tobytes()
    sent = (np.where(frequent[at], names[at], w.values[which[at]]).view(np.int64), docs[rows[at]], texts[rows[at]], starts[at], n)
    text = [None] * len(marks[0]) + [data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    columns = [pa.array(np.concatenate([x, y]), pa.int64()) for x, y in zip(marks, sent, strict=True)]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(text, pa.binary())], names=["key", "doc_id", "text_hash", "start", "n", "text"])


class Shard:
    """The stretches of one anchor, in document order."""

    def __init__(self, window: int):
        self.window = window
        self.whole: dict[bytes, tuple] = {}
        self.waiting: list[tuple] = []
        self.automaton: SuffixAutomaton | None = None

    def repeated(self, doc: tuple, start: int, n: int, text: bytes) -> list[tuple[int, int]]:
        """Runs (start, n) of the stretch's windows that occurred earlier; it is a reference from now on."""
        words = text.split()
        joined = b" ".join(words)
        if joined in self.whole:
            return [] if self.whole[joined] == (doc, start) else [(start, n)]
        self.whole[joined] = (doc, start)
        places = [(doc, start + i) for i in range(len(words))]
        self.waiting.append((words, places))
        if len(self.waiting) == 1 and self.automaton is None:
            return []
        if self.automaton is None:
            self.automaton = SuffixAutomaton()
        for earlier in self.waiting[:-1]:
            self.automaton.add(*earlier)
        self.waiting = self.waiting[-1:]
        firsts = self.automaton.firsts(words, self.window)[self.window - 1 :]
        hit = [f is not None and f != p for f, p in zip(firsts, places[self.window - 1 :], strict=True)]
        if all(hit):
            self.waiting = []
        edges = np.flatnonzero(np.diff(np.array([False, *hit, False], np.int8)))
        return [(start + int(x), int(y - x)) for x, y in zip(edges[::2], edges[1::2], strict=True)]


def repeated_windows(docs: DataFrame, window: int, filter_bits: int = 1 << 26) -> DataFrame:
    """Runs of windows that also start earlier: doc_id, text_hash, start (word), n (windows)."""
    held = docs.sparkSession.sparkContext.broadcast(_anchor_filter(docs, window, filter_bits))

    def send(batches):
        for part in chunks(batches, "text", SEND_BYTES):
            yield from _stretches(part, window, held.value)

    def look_up(batches):
        key, shard = None, None
        for part in batches:
            out = []
            columns = [part.column(c).to_pylist() for c in ("key", "doc_id", "text_hash", "start", "n", "text")]
            for k, doc, text_hash, start, n, text in zip(*columns, strict=True):
                if text is None:
                    out.append((doc, text_hash, start, n))
                    continue
                if k != key or shard is None:
                    key, shard = k, Shard(window)
                out.extend((doc, text_hash, *run) for run in shard.repeated((doc, text_hash), start, n, text))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["doc_id", "text_hash", "start", "n"])

    sent = docs.mapInArrow(send, _STRETCH).repartition(tasks(docs), "key").sortWithinPartitions("key", "doc_id", "text_hash", "start")
    return sent.mapInArrow(look_up, "doc_id long, text_hash long, start long, n long")


def remove_repeats(docs: DataFrame, window: int = 20, filter_bits: int = 1 << 26) -> DataFrame:
    """``docs`` with n_words, n_removed and kept (the words left, joined by one space).

    Existing columns of these names are replaced.
    """
    named = docs.drop("n_words", "n_removed", "kept")
    key, text_hash = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    slim = named.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(key.alias("doc_id"), text_hash.alias("text_hash"), F.col("text").cast("string").alias("text"))
    marks = repeated_windows(slim, window, filter_bits).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("_runs"))
    marks = marks.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "_runs")
    joined = named.join(marks, (key == F.col("_doc")) & (text_hash == F.col("_hash")), "left").drop("_doc", "_hash")
    out = joined.withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept": F.lit("")})

    def cut(batches):
        for part in chunks(batches, "text"):
            texts = [t.encode().split() if t else [] for t in part.column("text").to_pylist()]
            removed, kept = np.zeros(len(texts), np.int64), []
            for i, runs in enumerate(part.column("_runs").to_pylist()):
                words = texts[i]
                if runs:
                    edge = np.zeros(len(words) + 1, np.int64)
                    start, n = np.array([(r["start"], r["n"]) for r in runs]).T
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + window - 1, -1)
                    left = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    removed[i] = len(words) - len(left)
                    words = [words[j] for j in left.tolist()]
                kept.append(b" ".join(words).decode())
            found = {"n_words": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed), "kept": pa.array(kept, pa.string())}
            names = [c for c in part.schema.names if c != "_runs"]
            yield pa.RecordBatch.from_arrays([found.get(c, part.column(c)) for c in names], names=names)

    return out.mapInArrow(cut, out.drop("_runs").schema)
