"""Every operator on small tables with nulls, empty and long texts, ties, repeated and no rows, and clashing columns."""

import importlib.util
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402
from sluicework.llm import (  # noqa: E402
    chat, components, decontamination, language, licences, meeting, near_duplicates, nearest, packing, quality, substrings, token_files,
)
from sluicework.llm.tokens import encoder  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ce di fo gu".split() for b in "la me ni ro su ta".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def family(seed=5, n=40):
    """Texts with exact and near copies, common passages, odd spaces and edge cases, ids out of order."""
    rng = random.Random(seed)
    base, passage = prose(rng, 120), prose(rng, 60)
    texts = [None, "", " \t\n", "one", "two words", "Ünïcode é  x", "a " * 70, base, base, base.upper(), base.replace(" ", "\n")]
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = rng.choice(WORDS) + str(rng.randrange(99))
        texts.append(" ".join(words))
    texts += [f"{prose(rng, rng.randrange(5, 80))} {passage} {prose(rng, 30)}" for _ in range(10)]
    texts += [prose(rng, rng.randrange(1, 200)) for _ in range(20)] + [prose(rng, 20_000)]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


def frame(spark, rows, parts=5):
    full = [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, family())


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name,lower", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_give_the_library_s_ids(name, lower):
    import pyarrow as pa

    odd = [
        "Hello, w-x don't we'll! a.b.c x's't (hi)", "K'S İa, éa. a\tb\x0bc  \n  d", "ÉTÉ İs ǅx Ñandú straße", "é è\u0085 z", "x 　 y",
        "<|endoftext|> hi<|endoftext|>", "日本 語 x", "á b ́c", "\x7f \x1c a\x1f b", "12 3４5", "a\n\n b  c \t\n", "", None, "  q",
    ]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    ids, at = encoder(public_tokenizers.path(name), lower).encode(pa.array(odd, pa.string()), 7)
    for i, text in enumerate(odd):
        assert ids[at[i] : at[i + 1]].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 7], text


def test_token_files_round_trip(spark, docs, work):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.unionByName(frame(spark, [(None, "no id"), (3, "again"), (3, "again")]))
    manifest = token_files.write_tokens(rows, work + "/t", path)
    got = token_files.read_tokens(spark, work + "/t").orderBy("start").collect()
    tokenizer = Tokenizer.from_file(path)
    start, want = 0, []
    for d, t in sorted(((r.doc_id, r.text) for r in rows.collect()), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    some = manifest.orderBy("shard").first()
    first = next(r for r in got if r.doc_id is not None)
    assert zlib.crc32(token_files.read_documents(some.path, [first.doc_id])[first.doc_id].tobytes()) == first.ids_crc32
    token_files.write_tokens(empty(spark), work + "/e", path)
    assert token_files.read_tokens(spark, work + "/e").count() == 0


def test_a_damaged_frame_is_found(spark, docs, work):
    manifest = token_files.write_tokens(docs, work + "/t", public_tokenizers.path("byte_bpe_50k.json")).first()
    with open(manifest.path.removeprefix("file:"), "r+b") as f:
        f.seek(40)
        f.write(b"\0\1\2\3")
    with pytest.raises(Exception, match="checksum|ZstdError|zstd|decompress"):
        token_files.read_tokens(spark, work + "/t").collect()


@pytest.mark.parametrize("size,part", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, docs, size, part):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_duplicates.near_duplicates(docs.withColumn("registers", F.lit(1)), size, part, 100).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute.near_duplicates(rows, size, part, 100)


def test_near_duplicates_in_crowded_groups(spark, monkeypatch):
    """The way of large groups, on groups of three."""
    monkeypatch.setattr(near_duplicates, "SMALL", 2)
    monkeypatch.setattr(near_duplicates, "WIDEN", 2)
    rows = family(11, 60)
    got = near_duplicates.near_duplicates(frame(spark, rows), 3, 85, 100).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute.near_duplicates(rows, 3, 85, 100)


def test_near_duplicates_of_a_crowded_and_an_uncrowded_member(spark):
    """x shares one word with a crowd and is y's draft; in all their groups the pivot is a third text, far from both."""
    import pyarrow as pa

    made = [f"w{i}" for i in range(6000)]
    by_band = {}
    for word, h in zip(made, near_duplicates.shingle_sets(pa.array(made), 1)[0].tolist(), strict=True):
        by_band.setdefault((h >> (64 - near_duplicates.BUCKET_BITS)) // near_duplicates.BAND, []).append(word)
    common, (crowd, *_), friends = [by_band[b][0] for b in range(8)], by_band[8], [by_band[b][0] for b in range(9, 31)]
    own = by_band[31]
    texts = [[*common, crowd], common, [*common, *friends]]
    texts += [[*friends, own[i]] for i in range(40)] + [[crowd, own[40 + i]] for i in range(near_duplicates.SMALL + 6)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates.near_duplicates(frame(spark, rows), 1, 80, 100).collect()}
    assert got[1] == (8, 0, False)
    assert got == brute.near_duplicates(rows, 1, 80, 100)


def copies_of_one_base(seed, size, most):
    """Copies linked with the base (up to ``most`` edits), couples linked with each other only, far ones linked through a near one."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]

    def edited(edits):
        return " ".join(edits.get(i, w) for i, w in enumerate(base))

    def some(n, name):
        return {size * p + size // 2: f"{name}{p}" for p in rng.sample(range(120 // size - 1), n)}

    texts = [" ".join(base)] + [edited(some(rng.randrange(1, most + 1), f"c{i}x")) for i in range(60)]
    for i in range(40):
        both = list(some(most + 2, f"d{i}x").items())
        texts += [edited(dict(both[:-1])), edited(dict(both[:most] + both[-1:] if i < 30 else both[:most]))]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture
def tried(monkeypatch):
    """The numbers of pairs that each round of near-duplicates tries, with all groups of three and more large."""
    monkeypatch.setattr(near_duplicates, "SMALL", 2)
    numbers, real = [], near_duplicates._estimated

    def counted(pairs, classes, least):
        numbers.append(pairs.count())
        return real(pairs, classes, least)

    monkeypatch.setattr(near_duplicates, "_estimated", counted)
    return numbers


def test_near_duplicates_of_a_family_try_few_pairs(spark, tried):
    rows = copies_of_one_base(7, 3, 3)
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates.near_duplicates(frame(spark, rows), 3, 85, 100).collect()}
    want = brute.near_duplicates(rows, 3, 85, 100)
    assert got == want
    assert sorted(Counter(v[1] for v in want.values()).values()) == [2] * 30 + [81]
    assert sum(tried) < 10 * len(rows), tried


@pytest.mark.skipif(not importlib.util.find_spec("corpus_pipeline"), reason="no pipeline here")
def test_the_pipeline_keeps_one_of_a_family_and_tries_few_pairs(spark, tried):
    import corpus_pipeline

    rows = copies_of_one_base(9, 5, 2)
    want = {d for d, (_, _, kept) in brute.near_duplicates(rows, 5, 80, 100).items() if kept}
    assert len(want) == 31
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, frame(spark, rows), "").collect()} == want
    assert sum(tried) < 10 * len(rows), tried


def test_near_duplicates_without_ids_or_rows(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e")]
    got = near_duplicates.near_duplicates(frame(spark, rows), 3).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (4, 4, True), (4, 4, True)]
    assert near_duplicates.near_duplicates(empty(spark)).count() == 0


def test_register_estimates_are_close():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
        b = np.concatenate([a[: int(4000 * share)], rng.integers(0, 1 << 63, 4000 - int(4000 * share), dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
        r = [near_duplicates.registers(np.sort(x), np.array([0, len(x)])) for x in (a, b)]
        assert abs(near_duplicates.estimate(*r)[0] - share / (2 - share)) < 0.15


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(20)]
    star = [(999, i) for i in range(100, 130)]
    got = components.components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 130)}, 999: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("window,frequent", [(20, 1000), (20, 2), (50, 1000)])
def test_repeats_match_brute_force(spark, docs, monkeypatch, window, frequent):
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    left = substrings.remove_repeats(docs.withColumn("kept", F.lit("clash")), window)
    got = left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute.repeats(rows, window)


def test_repeated_rows_and_missing_ids_are_left_whole(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (2, text), (0, None)]
    got = substrings.remove_repeats(frame(spark, rows, 3)).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, r.n_removed) for r in got) == [(-1, 30, 0), (0, 0, 0), (1, 30, 0), (1, 30, 0), (2, 30, 30)]
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_suffix_automaton_finds_where_words_first_ended():
    rng = random.Random(2)
    for _ in range(200):
        parts = [[rng.choice("ab") for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        automaton, seen = substrings.SuffixAutomaton(), {}
        for k, part in enumerate(parts):
            found = automaton.firsts(part, 3)
            assert found == [seen.get(tuple(part[i - 2 : i + 1])) if i >= 2 else None for i in range(len(part))]
            automaton.add(part, [(k, i) for i in range(len(part))])
            for i in range(2, len(part)):
                seen.setdefault(tuple(part[i - 2 : i + 1]), (k, i))


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and runs away from here now"), (10, "short item"), (2, "short item"), (None, "void id"), (3, ""), (4, None)]


@pytest.mark.parametrize("windows", [200_000, 2])
def test_overlaps_match_brute_force(spark, windows):
    item = ITEMS[0][1]
    rows = [
        (1, None), (2, ""), (3, item), (4, f"Intro. {item.upper().replace(' ', '-- ')} end"), (5, "a short  ITEM, twice: short item"), (6, "short\nitems"),
        (7, " ".join(["pad"] * 500) + " short item"), (8, "Void ID"), (9, "x " + " ".join(item.split()[:12])), (10, "é short item é"),
    ]
    docs = frame(spark, rows).withColumn("n_hit", F.lit("clash"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.overlaps(docs, bench, 13, windows)
    got = found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long"), F.sha2(F.array_join("item_ids", ","), 256), decontamination.is_contaminated()).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute.overlaps(rows, ITEMS, 13)
    spans = {r.doc_id: [bytes(r.text, "utf-8")[s.begin : s.end].decode() for s in r.spans] for r in found.collect() if r.spans}
    assert spans[5] == ["short  ITEM", "short item"] and spans[8] == ["Void ID"]
    none = decontamination.overlaps(docs, bench.limit(0))
    assert none.agg(F.sum("n_hit")).first()[0] == 0
    assert decontamination.overlaps(empty(spark), bench).count() == 0


def test_licences_match_brute_force_and_read_tags(spark):
    rows = [
        (1, None), (2, ""), (3, "GNU General\nPublic-License and the Apache License"), (4, "x cc by cc by"), (5, "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0\ncode"),
        (6, "/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */"), (7, "SPDX-License-Identifier: MIT OR OR"), (8, "mit license " * 3000), (9, "SPDX license identifier MIT"),
    ]
    got = {r.doc_id: r for r in licences.scan(frame(spark, rows).withColumn("labels", F.lit(3))).collect()}
    assert {d: tuple(getattr(r, c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for d, r in got.items()} == brute.licences(rows, licences.BASE)
    assert (got[5].labels, got[5].permissive) == ("apache-2.0,gpl-3.0-only,mit", True)
    assert (got[6].labels, got[6].permissive) == ("gpl-2.0-only", False)
    assert (got[7].labels, got[7].permissive, got[9].expressions) == ("", None, [])
    assert all(0 <= r.score <= 1 for r in got.values())
    assert licences.scan(empty(spark)).count() == 0


def test_expressions_bind_with_before_and_before_or():
    assert licences.postfix("a OR b AND c WITH d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert licences.evaluate("MIT AND GPL-3.0-only OR ISC") == (["mit", "gpl-3.0-only", "isc"], True)
    for wrong in ("", "MIT AND", "(MIT", "MIT)", "MIT ISC", "AND MIT", "()", "MIT, ISC"):
        with pytest.raises(ValueError):
            licences.evaluate(wrong)


def test_languages_are_told_apart(spark):
    rng = random.Random(9)
    kinds = {"xa": "lor mip dan".split(), "xb": "quz yek vof".split(), "xc": "ähn öst brü".split()}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=3)) for _ in range(60)), k) for i, k in enumerate(rng.choices(sorted(kinds), k=400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language.train(docs)
    got = language.identify(docs, model).withColumn("held", language.held_out()).collect()
    assert any(r.held for r in got) and all(r.lang_pred == r.lang for r in got) and all(0 < r.score <= 1 for r in got)
    assert [r.held for r in got] == [zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?!"), (4, "日本"), (None, "lor")], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[4][0] in kinds and found[None][0] == "xa"
    nothing = language.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_many_languages_need_more_than_one_word_of_bits():
    grams = {f"l{i:03d}": np.array([i * 1000 + j for j in range(50)]) for i in range(70)}
    model = language.Model(grams, "l000")
    for i in (0, 63, 64, 69):
        places = model._places(np.array([i * 1000 + 7], np.uint32))
        mask = np.bitwise_and.reduce([model.cells[:, p[0]] for p in places])
        assert int(mask[i // 64]) >> (i % 64) & 1


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=24)]) for i in range(300)]
    vectors += [(300, vectors[10][1]), (301, vectors[10][1]), (302, None), (303, [None] * 24), (304, [float("nan")] * 24), (305, [1.0, 2.0]), (306, [2.0, 1.0]), (307, []), (None, vectors[0][1]), (1, vectors[1][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash")).repartition(7)
    ready = nearest.quantised(df)
    exact = [(r.vec_id, r.v) for r in ready.collect()]
    got = {}
    for r in nearest.top_k(ready.where("vec_id % 50 = 0 or vec_id in (305, 1)"), ready).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in {i for i, _ in exact if i % 50 == 0 or i in (305, 1)}:
        v = min(v for i, v in exact if i == q)
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in exact if i != q and len(w) == len(v)))[:5]
        assert got[q] == [(i, -s) for s, i in best], q
    assert nearest.top_k(ready.limit(0), ready).count() == 0


def test_top_k_copies_no_queries_through_the_driver(spark):
    rng = np.random.default_rng(5)
    ready = nearest.quantised(spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(500)], "vec_id long, embedding array<float>"))
    found = nearest.top_k(ready.where("vec_id % 50 = 0"), ready)
    assert len(found.collect()) == 50
    # Copies of the queries grow far beyond the size that Spark expects of a broadcast side.
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_every_asker_meets_every_offer_once_in_any_grid(spark, monkeypatch):
    assert meeting.grid(meeting.Sizes(0, 0, 0, 0), 8) == (1, 1) and meeting.grid(meeting.Sizes(100, 100, 800, 800), 8) == (1, 1)
    wide = meeting.grid(meeting.Sizes(10**6, 5 * 10**7, 10 * meeting.HELD + 1, 0), 48)
    assert wide[0] == 11 and 48 <= wide[0] * wide[1] <= 48 + wide[0]
    assert meeting.grid(meeting.Sizes(10, 10**7, 80, 90 * meeting.PASSING), 48) == (1, 90)
    monkeypatch.setattr(meeting, "PAIRS", 1)
    for held, cells in ((1 << 20, 4), (800, 4), (200, 1)):
        monkeypatch.setattr(meeting, "HELD", held)
        asked = spark.createDataFrame([(i, [i, i]) for i in range(50)], "vec_id long, v array<long>")
        offered = spark.createDataFrame([(i % 90, [i // 2, 1], "x") for i in range(200)], "vec_id long, v array<long>, label string")
        of = meeting.sizes(asked.select("v", F.lit(True).alias("a")).unionByName(offered.select("v", F.lit(False).alias("a"))), F.col("a"), ~F.col("a"))
        assert of == (50, 200, 800, 3200)
        met = meeting.meet(asked, offered, of).select("*", F.spark_partition_id().alias("cell")).collect()
        lines, columns = meeting.grid(of, 4)
        assert lines >= -(-800 // held) and lines * columns > 1
        cells = {}
        for r in met:
            cells.setdefault(r.cell, ([], []))[r.side].append((r.vec_id, tuple(r.v)))
        pairs = sorted((a, o) for asks, offers in cells.values() for a in asks for o in offers)
        assert pairs == sorted(((i, (i, i)), (j % 90, (j // 2, 1))) for i in range(50) for j in range(200))
        for cell in cells:
            sides = [r.side for r in met if r.cell == cell]
            assert sides == sorted(sides)


def test_top_k_of_ties_in_small_blocks_and_many_cells(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 5)
    monkeypatch.setattr(meeting, "PAIRS", 1)
    monkeypatch.setattr(meeting, "HELD", 100)
    rng = np.random.default_rng(6)
    rows = [(int(i) % 70, [int(x) for x in rng.integers(-2, 3, size=3)]) for i in rng.permutation(140)]
    rows += [(70, []), (71, []), (80, [1 << 31, 1 << 30, 3]), (90, [1 << 31, 1 << 30, 1]), (91, [1 << 31, 1 << 30, 2])]
    table = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(5)
    got = {}
    for r in nearest.top_k(table.where("vec_id % 10 = 0"), table, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in {i for i, _ in rows if i % 10 == 0}:
        v = min(v for i, v in rows if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))[:3]
        assert got[q] == [(i, -s) for s, i in best], q


def test_bounds_never_lie_below_the_score():
    rng = np.random.default_rng(8)
    a, b = rng.integers(-500, 500, (40, 30)), rng.integers(-500, 500, (50, 30))
    for segments in nearest.LEVELS:
        bound = np.hstack(nearest.statistics(a, segments)) @ np.hstack(nearest.statistics(b, segments)).T
        assert (bound >= a @ b.T - 1e-6).all()


def test_packing_is_whole_and_tight(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.unionByName(frame(spark, [(None, "no id"), (5, "twice"), (5, "twice")])).withColumn("piece", F.lit("clash"))
    tokenizer = Tokenizer.from_file(path)
    want = sorted((r.doc_id or -1, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in rows.collect())
    got = packing.pack(rows, path, capacity=512).collect()
    assert sorted((r.doc_id or -1, r.start, r.length, r.ids_crc32) for r in got) == sorted(
        (d, s, len(ids[s : s + 512]), zlib.crc32(np.array(ids[s : s + 512], "<u4").tobytes())) for d, ids in want for s in range(0, len(ids), 512))
    assert all(r.start == r.piece * 512 for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:i]) for i in range(len(items))] and sum(n for _, n in items) <= 512
    # Bins merge whole, so many small tasks may need a few more than one best-fit over all pieces.
    assert len(bins) <= 1.1 * len(packing.best_fit([r.length for r in got], 512)) + 1
    assert packing.pack(empty(spark), path).count() == 0


def test_a_small_carry_loses_no_piece(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    few, many = (packing.pack(docs, path, capacity=300, carry=c) for c in (2, 4096))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, few.select(columns).collect())) == sorted(map(tuple, many.select(columns).collect()))


def test_packing_tops_up_long_documents_of_one_split(spark, monkeypatch):
    """More underfull bins in one split than a task may carry, and short documents in others."""
    monkeypatch.setattr(packing, "SPREAD", 3000, raising=False)
    path = public_tokenizers.path("word_bpe_49k.json")
    long = [(i, "the " * (36 + i % 5)) for i in range(4500)]
    short = [(10_000 + i, "the " * (5 + i % 3)) for i in range(2500)]
    rows = frame(spark, long, 1).unionByName(frame(spark, short, 3))
    got = packing.pack(rows, path, capacity=64).select("length", "sequence_id").collect()
    assert len(got) == 7000 and {r.length for r in got if r.length > 30} == set(range(37, 42))
    # Three tasks, so at most three bins more than one best-fit over all.
    least = len(packing.best_fit([r.length for r in got], 64))
    assert least == 4500 and len({r.sequence_id for r in got}) <= least + 3


def test_closing_by_carry_costs_no_sequence(spark, monkeypatch):
    monkeypatch.setattr(packing, "SPREAD", 300, raising=False)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = frame(spark, [(i, "the " * (34 + i % 11 if i % 40 else 12)) for i in range(2000)])
    few, all_ = (packing.pack(rows, path, capacity=64, carry=c).select("sequence_id").distinct().count() for c in (2, 1 << 30))
    assert few == all_


def test_best_fit_takes_the_least_room():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
    assert packing.best_fit([], 10) == []


def test_grades_on_held_out_texts(spark):
    rng = random.Random(1)

    def text(grade):
        words = [rng.choice(WORDS) for _ in range(60)]
        if grade == 0:
            words[rng.randrange(60)] = rng.choice(["vilest", "vileness", "vilely"])
        return " | ".join(words) if grade == 1 else " ".join(words)

    rows = [(i, text(g), g) for i, g in enumerate(rng.choices([0, 1, 2], [1, 1, 4], k=900))] + [(5000, None, 2), (5001, "", None), (None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int").withColumn("tails", F.lit("clash"))
    model = quality.train(docs, docs.where("doc_id % 3 > 0").select("doc_id", "grade"))
    assert list(model.thresholds) == sorted(model.thresholds)
    got = quality.grade(docs, model).withColumn("accepted", quality.is_accepted()).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id % 3 == 0 and r.doc_id < 5000]
    assert sum(r.accepted == (r.grade == 2) for r in held) > 0.97 * len(held)
    assert all(1 >= r.tails[0] >= r.tails[1] >= 0 and abs(sum(r.tails) - r.expected_grade) < 1e-9 for r in got)
    only = quality.train(docs, docs.where("grade = 2").select("doc_id", "grade"))
    assert all(quality.grade(docs, only).select(quality.is_accepted()).toPandas().iloc[:, 0])
    assert quality.grade(empty(spark), model).count() == 0
    assert quality.grade(docs, quality.train(docs, docs.limit(0).select("doc_id", "grade"))).where(quality.is_accepted()).count() == len(rows)


def test_ratings_order_toxic_below_low_below_good(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 0), (4, None, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in quality.ratings_of(labels).collect()} == {1: 0, 2: 1, 3: 2, 4: None, 5: 0}


def test_only_maximal_conversations_stay(spark):
    turns = lambda c, *texts: [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    rows = [
        *turns(1, "a"), *turns(2, "a", "b"), *turns(3, "a", "b", "c"), *turns(4, "a", "x"), *turns(6, "a", "x"), *turns(5, "a", "x"),
        *turns(None, "q", None), *turns(7, "q", ""), *turns(8, None), (9, None, None, "z"), *turns(10, "l" * 100_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash")).repartition(5)
    got = {r.conv_id: r for r in chat.render(df).collect()}
    assert {c: (r.n_turns, r.n_copies) for c, r in got.items()} == {3: (3, 1), 4: (2, 3), None: (2, 1), 7: (2, 1), 8: (1, 1), 9: (1, 1), 10: (1, 1)}
    assert got[4].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert chat.render(df.limit(0)).count() == 0


def test_chat_collapse_runs_no_python(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "c"))
    plan = chat.render(spark.read.parquet(str(tmp_path / "c")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert ("pipeline" in names) == (importlib.util.find_spec("corpus_pipeline") is not None)
