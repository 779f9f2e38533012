"""Benchmark decontamination: one automaton over the items' windows, one scan over the texts.

A window is 13 consecutive words of an item; an item of fewer words, but not none, is one window.
A document word inside any occurrence of a window is hit. The items are read through the driver,
as benchmarks are small; beyond ``automaton_windows`` windows they are dealt to several automata,
and the texts are scanned once for each, so no automaton grows with the benchmark.

Defined cases: null text has no words and is not contaminated; an item without words has no window;
a null item_id reads as an empty id; items that share an item_id are one item; rows that repeat a
doc_id are judged one by one; without items nothing is hit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluicework.llm.frames import staged
from sluicework.llm.phrases import Phrases, words_of
from sluicework.llm.text import ALNUM, Words, chunks

_AUTOMATA: dict[str, Phrases] = {}


def windows_of(items, window: int) -> dict[tuple[str, ...], set[str]]:
    """Each window with the ids of the items that hold it."""
    found: dict[tuple[str, ...], set[str]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).add("" if item is None else str(item))
    return found


def _automaton(patterns: dict[tuple[str, ...], str]) -> Phrases:
    """This worker's automaton for the patterns; it keeps the last one."""
    name = hashlib.sha256(repr(sorted(patterns.items())).encode()).hexdigest() if len(patterns) < 64 else str(len(patterns)) + hashlib.sha256("\n".join(map(" ".join, patterns)).encode()).hexdigest()
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[name] = Phrases(patterns)
    return _AUTOMATA[name]


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, automaton_windows: int = 200_000) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (sorted array) and spans (bytes of the text that are hit).

    Existing columns of these names are replaced.
    """
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator()
    patterns = [(w, sorted(ids)) for w, ids in sorted(windows_of(items, window).items())]
    shards = [dict(patterns[i : i + automaton_windows]) for i in range(0, len(patterns), automaton_windows)] or [{}]
    out = docs.drop("n_words", "n_hit", "item_ids", "spans").withColumns({
        "n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "item_ids": F.array().cast("array<string>"),
        "spans": F.array().cast("array<struct<begin:long,end:long>>"),
    })
    for i, shard in enumerate(shards):
        out = staged(out, "overlaps") if i else out
        held = docs.sparkSession.sparkContext.broadcast(shard)

        def scan(batches, held=held):
            automaton = _automaton(held.value)
            for part in chunks(batches, "text"):
                yield _scan(part, automaton)

        out = out.mapInArrow(scan, out.schema)
    return out


def _scan(part: pa.RecordBatch, automaton: Phrases) -> pa.RecordBatch:
    words = Words(part.column("text"), ALNUM, lower=True)
    rows, n = words.rows(), part.num_rows
    edge = np.zeros(len(rows) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for first, end, ids in automaton.find(words):
        edge[first] += 1
        edge[end] -= 1
        items.setdefault(int(rows[first]), set()).update(ids)
    hit = np.cumsum(edge[:-1]) > 0
    earlier_spans, earlier_items = part.column("spans").to_pylist(), part.column("item_ids").to_pylist()
    spans, ids, n_hit = [], [], np.zeros(n, np.int64)
    for row in range(n):
        a, b = words.heads[row], words.heads[row + 1]
        if row in items or earlier_spans[row]:
            mask = hit[a:b].copy()
            starts, ends = words.starts[a:b] - words.offsets[row], words.ends[a:b] - words.offsets[row]
            for s in earlier_spans[row]:
                mask |= (starts >= s["begin"]) & (ends <= s["end"])
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            spans.append([{"begin": int(starts[x]), "end": int(ends[y - 1])} for x, y in zip(edges[::2], edges[1::2], strict=True)])
            ids.append(sorted(items.get(row, set()) | set(earlier_items[row])))
            n_hit[row] = mask.sum()
        else:
            spans.append([])
            ids.append([])
    columns = {
        **{c: part.column(c) for c in part.schema.names}, "n_words": pa.array(words.counts.astype(np.int64)), "n_hit": pa.array(n_hit),
        "item_ids": pa.array(ids, pa.list_(pa.string())), "spans": pa.array(spans, part.schema.field("spans").type),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def is_contaminated() -> "F.Column":
    """A document is contaminated where at least a twentieth of its words are hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
