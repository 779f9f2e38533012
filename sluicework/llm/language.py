"""Language identification with a Bloom filter whose cells are bitmasks of languages.

Training counts the byte 4-grams of lower-cased words of each language and keeps those that are
common there. Every kept gram sets its language's bit in ``PROBES`` cells; the bitwise and of a
gram's cells gives all languages that may hold it at once. A text's hits per language, less the
hits that the language's filter would give by chance, decide.

Training takes at most about ``sample`` labelled documents, chosen by a hash of their id; this
bound is a parameter, and it bounds the model. Every text is predicted whole.

Defined cases: text that is null or has no letter is ``und`` with score 0; without training rows
every text is ``und``; equal languages go to the first in order; repeated rows are predicted one
by one; a text shorter than a gram has the score 0 and the language most documents were learnt in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluicework.llm.text import LOWER, buffers, chunks, mix

GRAM = 4
PROBES = 3
#: A gram counts for a language where its share there is this part of its largest share at least.
PART = 0.25
#: A gram must be seen as often in a language.
LEAST = 5

# Anything below "A" other than a letter reads as one space, so grams hold letters and word ends.
_FOLD = LOWER.copy()
_FOLD[:0x61] = np.where((LOWER[:0x61] >= 0x61) & (LOWER[:0x61] <= 0x7A), LOWER[:0x61], 0x20)
_FOLD[0x7B:0x80] = 0x20


def grams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all rows with a letter before their last byte, and the rows' bounds."""
    data, offsets = buffers(texts)
    folded = _FOLD[data].astype(np.uint32)
    n = max(0, len(folded) - GRAM + 1)
    out = np.zeros(n, np.uint32)
    for i in range(GRAM):
        out = (out << np.uint32(8)) | folded[i : i + n]
    good = (folded[:n] != 0x20) | (folded[1 : n + 1] != 0x20) if n else np.zeros(0, bool)
    for cut in offsets[1:-1]:
        good[max(0, cut - GRAM + 1) : cut] = False
    kept = np.flatnonzero(good)
    return out[kept], np.searchsorted(kept, offsets)


def held_out(column: str = "doc_id") -> "F.Column":
    """Documents kept from training: crc32 of the id as text is divisible by 5; a null id is not."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """Languages, their bitmask cells, and how often each language's filter hits by chance."""

    def __init__(self, grams: dict[str, np.ndarray], usual: str | None):
        self.languages = sorted(grams)
        self.usual = self.languages.index(usual) if usual is not None else 0
        most = max([len(g) for g in grams.values()], default=0)
        self.size = 1 << int(np.clip(np.ceil(np.log2(max(1, most) * 12)), 16, 22))
        self.cells = np.zeros((-(-max(1, len(self.languages)) // 64), self.size), np.uint64)
        for i, language in enumerate(self.languages):
            for at in self._places(grams[language].astype(np.uint32)):
                self.cells[i // 64][at] |= np.uint64(1 << (i % 64))
        filled = [(self.cells[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(self.languages))]
        self.chance = np.array(filled) ** PROBES

    def _places(self, grams: np.ndarray) -> list[np.ndarray]:
        h = mix(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return [((h >> np.uint64(22 * i)) % np.uint64(self.size)).astype(np.int64) for i in range(PROBES - 1)] + [(mix(h) % np.uint64(self.size)).astype(np.int64)]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        data, offsets = buffers(texts)
        ascii_letters = np.concatenate([[0], np.cumsum((LOWER[data] >= 0x61) & (LOWER[data] <= 0x7A))])
        letters = np.diff(ascii_letters[offsets]) > 0
        for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
            letters[i] = any(c.isalpha() for c in texts[int(i)].as_py())
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        grams, bounds = grams_of(texts)
        places = self._places(grams)
        hits = np.zeros((len(self.languages), n))
        for word, cells in enumerate(self.cells):
            mask = cells[places[0]]
            for at in places[1:]:
                mask &= cells[at]
            for i in range(word * 64, min(word * 64 + 64, len(self.languages))):
                running = np.concatenate([[0], np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1))])
                hits[i] = np.diff(running[bounds])
        total = np.diff(bounds)
        chance = self.chance[:, None]
        true = np.maximum(0, (hits - total * chance) / np.maximum(1e-9, 1 - chance))
        best = np.where(true.max(axis=0) > 0, true.argmax(axis=0), self.usual)
        score = np.clip(true[best, np.arange(n)] / np.maximum(1, total), 0, 1)
        return [self.languages[b] if x else "und" for b, x in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def train(docs: DataFrame, sample: int = 20_000) -> Model:
    """Learn from the documents that are not held out and have a lang."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    there = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(there.values())
    if not total:
        return Model({}, None)
    # A hash of the id other than that of the split; below the bound every row is taken.
    keep = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(1_000_000)) < int(min(1.0, sample / total) * 1_000_000)

    def count(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in chunks(batches, "text"):
            grams, bounds = grams_of(part.column("text"))
            langs = np.array(part.column("lang").to_pylist(), object)
            row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            for lang in set(langs.tolist()):
                g, c = np.unique(grams[(langs == lang)[row]], return_counts=True)
                old_g, old_c = sums.get(lang, (g[:0], c[:0]))
                g, at = np.unique(np.concatenate([old_g, g]), return_inverse=True)
                sums[lang] = (g, np.bincount(at, np.concatenate([old_c, c]), len(g)).astype(np.int64))
        for lang, (g, c) in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(g), "gram": pa.array(g, pa.int64()), "n": pa.array(c, pa.int64())})

    counted = rows.where(keep).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Grams of a bounded sample: a table of bounded size, whatever the corpus.
    table = counted.where(F.col("n") >= LEAST).toPandas()
    if not len(table):
        return Model({lang: np.zeros(0, np.uint32) for lang in there}, max(sorted(there), key=there.get))
    table["share"] = table.n / table.groupby("lang").n.transform("sum")
    table = table[table.share >= PART * table.groupby("gram").share.transform("max")]
    grams = {lang: np.zeros(0, np.int64) for lang in there} | {lang: g.gram.to_numpy() for lang, g in table.groupby("lang")}
    return Model(grams, max(sorted(there), key=there.get))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.drop("lang_pred", "score").withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(0.0)})

    def predict(batches):
        for part in chunks(batches, "text"):
            langs, scores = held.value.predict(part.column("text"))
            found = {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays([found.get(c, part.column(c)) for c in part.schema.names], names=part.schema.names)

    return out.mapInArrow(predict, out.schema)
