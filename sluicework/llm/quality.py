"""Quality by ordinal cumulative-link regression on graded ratings.

Grades are ordered (0, 1, 2, ...). One weight per hashed feature gives a text's score s, shared by
all grades; ordered thresholds t give P(grade <= k) = logistic(t_k - s), and with it the expected
grade and the tail probability P(grade >= k) by which documents are selected.

Features are the presence of words, of their beginnings (4 and 5 bytes, for inflected forms) and of
levels of a few coarse traits of the text, each a 32-bit hash. Features that do not shift the mean grade
clearly have no weight, so long texts don't gather noise.

Training takes at most about ``sample`` rated documents, chosen by a hash of their id: a parameter,
which also bounds what the driver holds. Every text is scored whole.

Defined cases: null text is empty, its only features are its traits; ratings that are null or of
unknown documents are left out; of several ratings of a document the lowest counts; without ratings,
or with one grade only, every document has that grade (0 without any) and nothing is rejected;
repeated rows are scored one by one; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluicework.llm.text import ALNUM, SEPARATORS, Words, chunks, mix

PREFIXES = (4, 5)
#: Deviations by which a feature must shift the mean grade, documents that must hold it, most features.
CLEAR, LEAST, MOST = 5.0, 5, 1 << 14
ROUNDS, RATE, PENALTY = 400, 0.1, 1e-4
#: A feature that is absent adds nothing; those of one text are joined with these salts by kind.
_SALTS = [np.uint64(x) for x in (0x1F3D5B79, 0x2E4C6A88, 0x3D5B7997)]


#: Levels of the traits; a text has a feature for each level that it reaches.
_LEVELS = {
    "symbols": (0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32), "digits": (0.02, 0.05, 0.1, 0.2, 0.4), "capitals": (0.05, 0.1, 0.2, 0.4, 0.8),
    "repeated": (0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97), "word length": (3, 4, 5, 6, 7, 8, 10, 15, 30), "words": (1, 5, 20, 50, 100, 1000, 10000),
}


def _traits(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the levels that each text's traits reach."""
    words = Words(texts, SEPARATORS)
    n, raw = len(words.counts), words.raw
    size = np.maximum(1, np.diff(words.offsets))
    capital = (raw >= 0x41) & (raw <= 0x5A)
    digit = (raw >= 0x30) & (raw <= 0x39)
    symbol = (raw < 0x80) & ~ALNUM[raw] & ~SEPARATORS[raw] & ~capital & ~np.isin(raw, [0x2C, 0x2E, 0x27, 0x2D])

    def share(mask: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(running[words.offsets]) / size

    hashes, rows = words.hashes(), words.rows()
    order = np.lexsort((hashes, rows))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    count = np.maximum(1, words.counts)
    repeated = np.where(words.counts >= 20, 1 - np.bincount(rows[order][new], minlength=n) / count, 0)
    values = {
        "symbols": share(symbol), "digits": share(digit), "capitals": share(capital), "repeated": repeated,
        "word length": np.bincount(rows, words.ends - words.starts, n) / count, "words": words.counts,
    }
    found_rows, found = [], []
    for i, (trait, levels) in enumerate(_LEVELS.items()):
        row, level = np.nonzero(values[trait][:, None] >= np.array(levels))
        found_rows.append(row)
        found.append(mix(level.astype(np.uint64) + np.uint64(1000 * (i + 1))))
    return np.concatenate(found_rows), np.concatenate(found)


def features(texts: pa.Array, wanted: np.ndarray | None = None, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once; only ``wanted`` sorted features, by their position, if given.

    ``marks`` is a table over the low bits of the wanted features that lets most others pass by quickly.
    """
    words = Words(texts, ALNUM, lower=True)
    rows = words.rows()
    found_rows, found = [], []

    def take(row, h):
        h = (h >> np.uint64(32)).astype(np.uint32)
        if wanted is not None:
            near = np.flatnonzero(marks[h & np.uint32(len(marks) - 1)])
            at = np.minimum(np.searchsorted(wanted, h[near]), len(wanted) - 1)
            same = wanted[at] == h[near]
            row, h = row[near][same], at[same].astype(np.uint32)
        found_rows.append(row)
        found.append(h)

    kinds = words.hashes(*PREFIXES)
    for k, (h, salt) in enumerate(zip(kinds, _SALTS, strict=True)):
        longer = words.ends - words.starts > PREFIXES[k - 1] if k else slice(None)
        take(rows[longer], mix(h[longer] + salt))
    take(*_traits(texts))
    key = np.unique((np.concatenate(found_rows).astype(np.uint64) << np.uint64(32)) | np.concatenate(found))
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Sorted features with their weights, and the ordered thresholds."""

    def __init__(self, wanted: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, only: int = 0):
        self.wanted, self.weights, self.thresholds, self.only = wanted, weights, thresholds, only
        self.marks = np.zeros(1 << 22, bool)
        self.marks[wanted & np.uint32(len(self.marks) - 1)] = True

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) for k from 1, one column each."""
        if not len(self.thresholds):
            return np.ones((len(texts), self.only))
        score = np.zeros(len(texts))
        if len(self.wanted):
            rows, at = features(texts, self.wanted, self.marks)
            score = np.bincount(rows, self.weights[at], len(texts))
        return 1 - _logistic(self.thresholds[None, :] - score[:, None])


def fit(rows: np.ndarray, found: np.ndarray, grades: np.ndarray) -> Model:
    """Fit to (row, feature) pairs and the rows' grades."""
    kinds = int(grades.max(initial=0)) + 1
    if len(grades) == 0 or (grades == grades[0]).all():
        return Model(np.zeros(0, np.uint32), np.zeros(0), np.zeros(0), int(grades[0]) if len(grades) else 0)
    wanted, n = np.unique(found, return_counts=True)
    wanted, n = wanted[n >= LEAST], n[n >= LEAST]
    at = np.searchsorted(wanted, found).astype(np.int32)
    used = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == found) if len(wanted) else np.zeros(0, np.int64)
    rows, at = rows[used], at[used]
    shift = np.bincount(at, grades[rows], len(wanted)) / np.maximum(1, n) - grades.mean()
    clear = np.abs(shift) / grades.std() * np.sqrt(n)
    keep = np.flatnonzero(clear >= CLEAR)
    keep = np.sort(keep[np.argsort(-clear[keep], kind="stable")[:MOST]])
    place = np.full(len(wanted), -1)
    place[keep] = np.arange(len(keep))
    used = place[at] >= 0
    row, col = rows[used], place[at][used]
    weights = np.zeros(len(keep))
    below = np.clip([(grades <= k).mean() for k in range(kinds - 1)], 1e-3, 1 - 1e-3)
    # Thresholds are the first one and the logarithms of the steps, so they stay in order.
    first = np.log(below / (1 - below))
    steps = np.concatenate([first[:1], np.log(np.maximum(1e-2, np.diff(first)))])
    size = len(grades)
    moment = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, steps)]
    for turn in range(1, ROUNDS + 1):
        thresholds = np.concatenate([steps[:1], steps[0] + np.cumsum(np.exp(steps[1:]))])
        score = np.bincount(row, weights[col], size)
        edge = np.concatenate([np.zeros((size, 1)), _logistic(thresholds[None, :] - score[:, None]), np.ones((size, 1))], axis=1)
        low, high = edge[np.arange(size), grades], edge[np.arange(size), grades + 1]
        gap = np.maximum(high - low, 1e-9)
        by_score = (high + low - 1) / size
        slope = edge * (1 - edge)
        by_threshold = np.zeros(kinds - 1)
        for k in range(kinds - 1):
            by_threshold[k] = -(slope[grades == k, k + 1] / gap[grades == k]).sum() / size + (slope[grades == k + 1, k + 1] / gap[grades == k + 1]).sum() / size
        by_steps = np.array([by_threshold.sum(), *(by_threshold[k:].sum() * np.exp(steps[k]) for k in range(1, kinds - 1))])
        # The loss falls with the score as high + low - 1 tells, so its gradient has the other sign.
        by_weights = -np.bincount(col, by_score[row], len(weights)) + PENALTY * weights
        for x, g, (m, v) in zip((weights, steps), (by_weights, by_steps), moment, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    thresholds = np.concatenate([steps[:1], steps[0] + np.cumsum(np.exp(steps[1:]))])
    return Model(wanted[keep], weights, thresholds)


def train(docs: DataFrame, ratings: DataFrame, sample: int = 6_000) -> Model:
    """Fit to ``ratings`` (doc_id, grade) of ``docs``."""
    rated = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("grade").cast("int")).alias("grade"))
    total = rated.count()
    share = int(min(1.0, sample / max(1, total)) * 1_000_000)
    few = rated.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_000)) < share)

    def take(batches):
        for part in chunks(batches, "text"):
            rows, found = features(part.column("text"))
            cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column("grade"), pa.array([found[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["grade", "found"])

    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    # At most about ``sample`` short rows are broadcast.
    joined = texts.join(F.broadcast(few), "doc_id").select("text", "grade")
    got = joined.mapInArrow(take, "grade int, found binary").toPandas()
    parts = [np.frombuffer(x, np.uint32) for x in got.found]
    rows = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
    found, grades = np.concatenate([np.zeros(0, np.uint32), *parts]), got.grade.to_numpy(np.int64)
    del got, parts
    return fit(rows, found, grades)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with expected_grade and tails, an array of P(grade >= k) for k from 1.

    Existing columns of these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.drop("expected_grade", "tails").withColumns({"expected_grade": F.lit(0.0), "tails": F.array().cast("array<double>")})

    def score(batches):
        for part in chunks(batches, "text"):
            tails = held.value.tails(part.column("text"))
            found = {"expected_grade": pa.array(tails.sum(axis=1)), "tails": pa.array(list(tails), pa.list_(pa.float64()))}
            columns = [found[c].cast(part.schema.field(c).type) if c in found else part.column(c) for c in part.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return out.mapInArrow(score, out.schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades of the labels: 0 toxic, 1 of low quality, 2 neither."""
    low = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("toxic").isNotNull() & F.col("quality").isNotNull(), 2)
    return labels.select("doc_id", low.alias("grade"))


def is_accepted(least: int = 2, probability: float = 0.5) -> "F.Column":
    """Whether P(grade >= least) reaches ``probability``; a model without that grade accepts all."""
    tail = F.when(F.size("tails") >= least, F.element_at("tails", least))
    return F.coalesce(tail >= probability, F.lit(True))
