"""Near-duplicates by HyperMinHash registers, banded, estimated, then confirmed on full sets.

A document's distinct word shingles are hashed once. The first bits of a hash choose one of 128
buckets; a bucket keeps its smallest rest in 16 bits, the count of leading zeros and ten mantissa
bits. Four neighbouring registers are one 64-bit band key, so two documents of similarity s share
one of the 32 bands but for a chance below (1 - s**4) ** 32: 6e-11 at 0.85, 5e-8 at 0.8. Candidates
whose estimate, corrected for registers that agree by chance, is clearly too low go; for the rest
both texts meet and the sets are compared in full.

Equal sets are one class first, so copies are never compared. Within a band's group not all pairs
are tried: the first round compares members with one pivot. Groups that then still hold different
components are compared whole where they have at most ``SMALL`` members. Of larger ones, each
member's shingles that any other such member may hold are counted; no intersection within those
groups is larger than that count, so most members that are far from all others drop out of them
unpaired; in its other groups a member stays.

What is left of the large groups meets on rare elements only, which loses no link. A member's centre
is its likely pivot with the most company, itself without one. Where two members share a centre p,
their differences from it, R(x) = x ^ p and R(y), decide: |x ^ y| = |R(x)| + |R(y)| - 2 |R(x) & R(y)|.
If both are linked with p they are one component; else at least one is far, which asks for so many
common elements of R(x) and R(y) that the rarest ones of both, all but the asked number less one,
must share one. Private edits of a copy are met by nobody, and places that many copies changed are
the most frequent elements, seldom among those. Members of different centres meet on the rarest
shingles of their sets in the same way.

Defined cases: text that is null or without words has an empty set and no links; with fewer words
than a shingle the whole sequence is the one shingle; a document with a null doc_id has no links
and is kept, its component_id null; rows that share a doc_id are one document; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from sluicework.llm.components import components
from sluicework.llm.frames import staged
from sluicework.llm.text import SEPARATORS, Words, chunks, grams, mix

BUCKET_BITS = 7
MANTISSA_BITS = 10
BAND = 4
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // BAND
#: Estimates may lie below the threshold by as much before a candidate goes: six deviations.
MARGIN = 0.2
#: Without effect since large groups meet on rare elements; a test still sets it.
WIDEN = 16
#: Groups of as many members are compared at once after the first round.
SMALL = 64
#: Bits of the table of shared shingles, in so many slices; a full table only drops fewer members.
SHARED_BITS, SLICES = 1 << 27, 256


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, one row after another, and the rows' bounds."""
    words = Words(texts, SEPARATORS, lower=True)
    hashes, counts, heads = words.hashes(), words.counts, words.heads
    all_ = grams(hashes, size) if len(hashes) >= size else np.zeros(0, np.uint64)
    parts, sizes = [], np.zeros(len(counts), np.int64)
    for row in range(len(counts)):
        n, at = int(counts[row]), int(heads[row])
        if n >= size:
            own = np.sort(all_[at : at + n - size + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            own = mix(grams(hashes[at : at + n], n) + np.uint64(n))
        else:
            continue
        parts.append(own)
        sizes[row] = len(own)
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum(sizes)])


def registers(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16-bit registers of every row's buckets; 0 is an empty bucket."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    key = rows * BUCKETS + bucket
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    rest = hashes[first] << np.uint64(BUCKET_BITS)
    # The position of the leading one; conversion to double may round up, so compare again.
    top = np.floor(np.log2(np.maximum(rest, np.uint64(1)).astype(float))).astype(np.int64)
    top -= (np.uint64(1) << np.minimum(top, 63).astype(np.uint64)) > np.maximum(rest, np.uint64(1))
    top = np.minimum(top, 63)
    zeros = np.minimum(63 - top, 62)
    shifted = np.where(zeros < 63, rest << np.minimum(zeros + 1, 63).astype(np.uint64), np.uint64(0))
    mantissa = (shifted >> np.uint64(64 - MANTISSA_BITS)).astype(np.int64)
    out = np.zeros((len(bounds) - 1) * BUCKETS, np.uint16)
    out[key[first]] = ((zeros + 1) << MANTISSA_BITS) | mantissa
    return out.reshape(-1, BUCKETS)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers, less the agreement that chance brings."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    # Two different minima agree where their zeros and mantissa do: about a third of 2 ** -mantissa.
    chance = 1 / 3 / (1 << MANTISSA_BITS)
    return np.clip((same / np.maximum(1, used) - chance) / (1 - chance), 0, 1)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """Per document: doc_id, n_shingles, set_a and set_b (a 128-bit name of its set), registers."""

    def sketch(batches):
        for part in chunks(batches, "text"):
            hashes, bounds = shingle_sets(part.column("text"), size)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            names = np.zeros((2, len(n)), np.uint64)
            if len(full):
                names[0, full] = np.bitwise_xor.reduceat(hashes, bounds[:-1][full])
                names[1, full] = np.add.reduceat(mix(hashes + np.uint64(1)), bounds[:-1][full])
            regs = registers(hashes, bounds)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_shingles": pa.array(n), "set_a": pa.array(names[0].view(np.int64)),
                "set_b": pa.array(names[1].view(np.int64)), "registers": pa.array([r.tobytes() for r in regs], pa.binary()),
            })

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(sketch, "doc_id long, n_shingles long, set_a long, set_b long, registers binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, band, key) of every band that isn't empty."""

    def band(batches):
        for part in batches:
            keys = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.int64).reshape(-1, BANDS)
            row, at = np.nonzero(keys)
            taken = part.select(["doc_id", "n_shingles"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(at, pa.int32()), pa.array(keys[row, at])], names=["doc_id", "n_shingles", "band", "key"])

    return classes.select("doc_id", "n_shingles", "registers").mapInArrow(band, "doc_id long, n_shingles long, band int, key long")


def _slice_and_bit(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(hashes + np.uint64(0x2545F4914F6CDD1D))
    return (h >> np.uint64(56)).astype(np.int64), (h % np.uint64(SHARED_BITS // SLICES)).astype(np.int64)


def shared_table(texts: DataFrame, size: int) -> Broadcast:
    """Bits of the shingles that two documents of ``texts`` hold.

    Hashes go to the slices of a bit table of fixed size; a slice marks bits met by two documents.
    """

    def deal(batches):
        for part in chunks(batches, "text"):
            slices, bits = _slice_and_bit(shingle_sets(part.column("text"), size)[0])
            order = np.argsort(slices, kind="stable")
            cuts = np.searchsorted(slices[order], np.arange(SLICES + 1))
            dealt = bits[order].astype(np.int32)
            here = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), pa.array([dealt[cuts[i] : cuts[i + 1]].tobytes() for i in here], pa.binary())], names=["slice", "bits"])

    def mark(batches):
        tables: dict[int, np.ndarray] = {}
        for part in batches:
            for i, data in zip(part.column("slice").to_pylist(), part.column("bits").to_pylist(), strict=True):
                bits, n = np.unique(np.frombuffer(data, np.int32), return_counts=True)
                once, twice = tables.setdefault(i, np.zeros((2, SHARED_BITS // SLICES), bool))
                twice[bits[once[bits] | (n > 1)]] = True
                once[bits] = True
        for i, (_, twice) in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()])], names=["slice", "twice"])

    dealt = texts.mapInArrow(deal, "slice int, bits binary").repartition(SLICES, "slice")
    rows = {r["slice"]: bytes(r["twice"]) for r in dealt.mapInArrow(mark, "slice int, twice binary").collect()}
    nothing = bytes(SHARED_BITS // SLICES // 8)
    return texts.sparkSession.sparkContext.broadcast(b"".join(rows.get(i, nothing) for i in range(SLICES)))


def _met(hashes: np.ndarray, held: Broadcast) -> np.ndarray:
    """Whether two documents may hold each of the shingles."""
    slices, bits = _slice_and_bit(hashes)
    at = slices * (SHARED_BITS // SLICES) + bits
    return (np.frombuffer(held.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def shared_counts(texts: DataFrame, held: Broadcast, size: int) -> DataFrame:
    """Per document of ``texts``: doc_id, and at most how many of its shingles another one holds."""

    def count(batches):
        for part in chunks(batches, "text"):
            hashes, bounds = shingle_sets(part.column("text"), size)
            running = np.concatenate([[0], np.cumsum(_met(hashes, held))])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(running[bounds]).astype(np.int64))], names=["doc_id", "shared"])

    return texts.mapInArrow(count, "doc_id long, shared long")


def _rare(elements: DataFrame, by: list[str]) -> DataFrame:
    """``elements`` that are among the rarest of their version; ``asked`` - 1 of the most frequent go.

    An element that only one version holds meets nobody. Any order that all versions of ``by`` share would do.
    """
    often = elements.groupBy(*by, "element").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    order = Window.partitionBy(*by, "doc_id", "version").orderBy(F.desc("often"), F.desc("element"))
    return elements.join(often, [*by, "element"]).withColumn("nth", F.row_number().over(order)).drop("often")


def _within_centres(centres: DataFrame, texts: DataFrame, held: Broadcast, size: int, part: int, whole: int) -> DataFrame:
    """Pairs (x, y) of members of one centre that may be linked, but for pairs both linked with it."""

    def differ(batches):
        for rows in chunks(batches, "text", 1 << 19):
            (hx, bx), (hc, bc) = (shingle_sets(rows.column(c), size) for c in ("text", "other"))
            kept, sizes, asked, asked_far = [np.zeros(0, np.uint64)], [], [], []
            for i in range(rows.num_rows):
                x, c = hx[bx[i] : bx[i + 1]], hc[bc[i] : bc[i + 1]]
                own, lost = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
                r, slack = len(own) + len(lost), whole - part
                # Twice whole + part common elements are above the first with a far partner, at least the second with any.
                above, least = r * (whole + part) + slack * (len(c) - len(x)), r * (whole + part) - slack * (len(c) + len(x))
                kept += [own[_met(own, held)], lost]
                sizes.append(len(kept[-2]) + len(lost))
                asked.append(max(1, above // (2 * (whole + part)) + 1))
                asked_far.append(max(1, -(-least // (2 * (whole + part)))) if least > 0 else None)
            at = pa.array(np.repeat(np.arange(rows.num_rows), sizes))
            columns = [rows.column(n) for n in ("centre", "doc_id", "version")] + [pa.array(v, pa.int64()) for v in (asked, asked_far)]
            taken = [c.take(at) for c in columns]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(np.concatenate(kept).view(np.int64))], names=["centre", "doc_id", "version", "asked", "asked_far", "element"])

    others = texts.select(F.col("doc_id").alias("centre"), F.col("text").alias("other"))
    both = texts.join(centres.where("doc_id <> centre").select("doc_id", "centre"), "doc_id").join(others, "centre")
    # A centre whose id has several texts is as many centres.
    both = both.select(F.xxhash64("centre", "other").alias("centre"), "doc_id", F.xxhash64("text").alias("version"), "text", "other")
    elements = staged(both.mapInArrow(differ, "centre long, doc_id long, version long, asked long, asked_far long, element long"), "differences")
    rare = _rare(elements, ["centre"]).where("nth >= asked OR nth >= asked_far")
    rare = staged(rare.join(centres.select("doc_id", "label"), "doc_id"), "rare")
    near = rare.where("nth >= asked").select("centre", "element", F.col("doc_id").alias("x"), F.col("label").alias("label_x"))
    far = rare.where("nth >= asked_far").select("centre", "element", F.col("doc_id").alias("y"), F.col("label").alias("label_y"))
    return near.join(far, ["centre", "element"]).where("label_x <> label_y").select("x", "y")


def _across_centres(centres: DataFrame, texts: DataFrame, held: Broadcast, size: int, part: int, whole: int) -> DataFrame:
    """Pairs (x, y) of members of different centres that may be linked."""

    def spread(batches):
        for rows in chunks(batches, "text"):
            hashes, bounds = shingle_sets(rows.column("text"), size)
            met = _met(hashes, held)
            at = np.repeat(np.arange(rows.num_rows), np.diff(bounds))[met]
            asked = -(-part * np.diff(bounds) // whole)[at]
            taken = rows.select(["doc_id", "version"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(asked), pa.array(hashes[met].view(np.int64))], names=["doc_id", "version", "asked", "element"])

    own = texts.join(centres.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("version"), "text")
    elements = staged(own.mapInArrow(spread, "doc_id long, version long, asked long, element long"), "elements")
    rare = _rare(elements, []).where("nth >= asked").select("element", "doc_id")
    rare = staged(rare.distinct().join(centres.select("doc_id", "label", "centre"), "doc_id"), "rare")
    # The centres that meet on an element first, so that the members of one never meet there.
    at = rare.select("element", "centre").distinct()
    meet = at.join(at.withColumnRenamed("centre", "further"), "element").where("centre < further")
    one = rare.select("element", "centre", F.col("doc_id").alias("x"), F.col("label").alias("label_x"))
    two = rare.select("element", F.col("centre").alias("further"), F.col("doc_id").alias("y"), F.col("label").alias("label_y"))
    pairs = one.join(meet, ["element", "centre"]).join(two, ["element", "further"])
    return pairs.where("label_x <> label_y").select("x", "y")


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose estimate isn't clearly too low."""

    def keep(batches):
        for part in batches:
            if part.num_rows:
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
                yield part.select(["a", "b"]).filter(pa.array(estimate(a, b) >= least - MARGIN))

    for side in ("a", "b"):
        own = classes.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("registers").alias(f"r{side}"))
        pairs = pairs.join(own, side)
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(least - 1e-9)
    return pairs.where(fits).select("a", "b", "ra", "rb").mapInArrow(keep, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, part: int, whole: int) -> DataFrame:
    """Pairs of which whole * intersection >= part * union, on the full sets of both texts."""

    def compare(batches):
        for rows in chunks(batches, "ta", 1 << 20):
            (ha, ba), (hb, bb) = (shingle_sets(rows.column(c), size) for c in ("ta", "tb"))
            keep = []
            for i in range(rows.num_rows):
                x, y = ha[ba[i] : ba[i + 1]], hb[bb[i] : bb[i + 1]]
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(whole * same >= part * (len(both) - same) and same > 0)
            yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = texts.join(pairs.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi")
    second = texts.join(pairs.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi")
    pairs = pairs.join(first.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    pairs = pairs.join(second.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return pairs.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")


def links_of(docs: DataFrame, classes: DataFrame, size: int, part: int, whole: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between classes that connect every component, and the classes' labels (node, label)."""
    least = part / whole
    bands = _bands(classes)
    groups = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    bands = staged(bands.join(groups, ["band", "key"]), "bands")
    # The pivot is the member with the most company over all bands, the original of most copies.
    company = bands.groupBy("doc_id").agg(F.sum("members").alias("company"))
    central = F.min(F.struct((-F.col("company")).alias("c"), F.xxhash64(F.lit(3), "doc_id").alias("u"), "doc_id"))
    first = bands.join(company, "doc_id").groupBy("band", "key").agg(central.alias("pivot"))
    stars = bands.select("band", "key", "doc_id").join(first.select("band", "key", F.col("pivot.doc_id").alias("pivot")), ["band", "key"])

    def fits(one: str, other: str) -> "F.Column":
        """Whether two members' shared counts and sizes allow the similarity."""
        return F.least(f"s{one}", f"s{other}") * F.lit(1 + least) >= (F.col(f"n{one}") + F.col(f"n{other}")) * F.lit(least - 1e-9)

    def confirm(pairs: DataFrame, tried: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        pairs = pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = staged(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        likely = staged(_estimated(pairs, classes, least), "likely")
        return pairs, likely, staged(_confirmed(likely, docs, size, part, whole), "links")

    tried, likely, links = confirm(stars.select(F.col("doc_id").alias("x"), F.col("pivot").alias("y")), None)
    labels = components(links)
    own = bands.select("band", "key", "members", "doc_id", F.col("n_shingles").alias("nx"), F.col("n_shingles").alias("sx"))
    # Members of groups that still hold two components.
    own = own.join(labels, own.doc_id == labels.node, "left").select(*own.columns, F.coalesce("label", "doc_id").alias("label"))
    mixed = own.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band", "key")
    own = staged(own.join(mixed, ["band", "key"]), "mixed")
    many = own.where(F.col("members") > SMALL).select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    crowded = staged(texts.join(many, "doc_id", "left_semi").distinct(), "crowded")
    held = shared_table(crowded, size)
    counts = staged(shared_counts(crowded, held, size).groupBy("doc_id").agg(F.max("shared").alias("shared")), "shared")
    # Only in the large groups are all partners counted; in others every shingle may be shared.
    bound = F.when(F.col("members") > SMALL, F.least("sx", F.coalesce("shared", "sx"))).otherwise(F.col("sx"))
    own = own.join(counts, "doc_id", "left").withColumn("sx", bound).drop("shared")
    # The smallest partner that a group offers, and that the similarity allows.
    smallest = own.groupBy("band", "key").agg(F.min("nx").alias("smallest"))
    own = own.join(smallest, ["band", "key"]).withColumns({"sy": F.col("sx"), "ny": F.greatest("smallest", F.col("nx") * F.lit(least))})
    own = own.where(F.col("sx") * F.lit(1 + least) >= (F.col("nx") + F.col("ny")) * F.lit(least - 1e-9)).drop("smallest", "sy", "ny")
    own = staged(own, "able")
    if not own.limit(1).count():
        return links, labels
    few = own.where(F.col("members") <= SMALL)
    other = few.select("band", "key", F.col("doc_id").alias("y"), F.col("nx").alias("ny"), F.col("sx").alias("sy"), F.col("label").alias("other"))
    pairs = few.join(other, ["band", "key"]).where((F.col("label") != F.col("other")) & (F.col("doc_id") < F.col("y")) & fits("x", "y"))
    pairs = pairs.select(F.col("doc_id").alias("x"), "y")
    crowd = own.where(F.col("members") > SMALL).groupBy("doc_id").agg(F.min("label").alias("label"), F.min("nx").alias("n"), F.max("sx").alias("s"))
    crowd = staged(crowd, "crowd")
    if crowd.limit(1).count():
        ends = likely.select(F.col("a").alias("doc_id"), F.col("b").alias("centre")).unionByName(likely.select(F.col("b").alias("doc_id"), F.col("a").alias("centre")))
        ends = ends.unionByName(crowd.select("doc_id", F.col("doc_id").alias("centre"))).join(crowd, "doc_id")
        ends = ends.join(company.withColumnRenamed("doc_id", "centre"), "centre")
        centres = ends.groupBy("doc_id", "label", "n", "s").agg(F.max(F.struct("company", "centre"))["centre"].alias("centre"))
        centres = staged(centres, "centres")
        needed = centres.select("doc_id").unionByName(centres.select(F.col("centre").alias("doc_id"))).distinct()
        whole_texts = staged(texts.join(needed, "doc_id", "left_semi").distinct(), "centred")
        met = _within_centres(centres, whole_texts, held, size, part, whole).unionByName(_across_centres(centres, whole_texts, held, size, part, whole))
        met = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        for side in ("x", "y"):
            met = met.join(centres.select(F.col("doc_id").alias(side), F.col("n").alias(f"n{side}"), F.col("s").alias(f"s{side}")), side)
        pairs = pairs.unionByName(met.where(fits("x", "y")).select("x", "y"))
    _, _, found = confirm(pairs, tried)
    if not found.limit(1).count():
        return links, labels
    links = links.unionByName(found)
    return links, components(links)


def near_duplicates(docs: DataFrame, size: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id it is linked to, over any steps), kept.

    Documents are linked where whole * intersection >= part * union of their shingle sets.
    """
    all_ = staged(sketches(docs, size), "sketches")
    sets = ["set_a", "set_b", "n_shingles"]
    able = all_.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = staged(able.groupBy(*sets).agg(F.min("doc_id").alias("doc_id"), F.min("registers").alias("registers")), "classes")
    _, labels = links_of(docs, classes, size, part, whole)
    named = classes.join(labels, classes.doc_id == labels.node, "left").select(*sets, F.coalesce("label", "doc_id").alias("component_id"))
    linked = all_.join(named, sets, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    out = linked.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(component, "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
