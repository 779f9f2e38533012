"""Clustering, hard negatives and page text against plain versions and edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicework.llm import clustering, hard_negatives, meeting, page_text

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def random_rows(n=300, dim=8, seed=3, labels=4):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]
    # Repeats, ties and rows that take no part.
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, None, 1), (n + 2, [1.0] * (dim - 1) + [None], 1), (n + 3, [float("nan")] * dim, 1),
             (n + 4, rows[5][1], None), (n + 5, [0.5] * (dim + 2), 1)]
    return rows


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows, every=50, k_pos=5, k_neg=3, low=50, high=95):
    usable = []
    for vec_id, e, label in rows:
        if vec_id is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        usable.append((vec_id, label, [math.floor(256 * float(x)) for x in e]))
    out = []
    for a_id, a_label, a in usable:
        if a_id % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, c, strict=True)), cid, cl) for cid, cl, c in usable if cid != a_id and len(c) == len(a)]
        scored.sort()
        positives = [(cid, -s) for s, cid, cl in scored if cl == a_label][:k_pos]
        for pid, ps in positives:
            negs = [(cid, -s) for s, cid, cl in scored if cl != a_label and low * ps <= -100 * s <= high * ps][:k_neg]
            out += [(a_id, pid, r + 1, nid, ps, ns) for r, (nid, ns) in enumerate(negs)]
    return sorted(out)


def test_residue_scores_are_exact():
    rng = np.random.default_rng(1)
    for scale in (1, 300, 10**6, 10**9):
        a, c = rng.integers(-scale, scale, (7, 70)), rng.integers(-scale, scale, (9, 70))
        got = hard_negatives.residue_scores(a, c)
        assert [[int(x) for x in r] for r in got] == [[int(x) for x in r] for r in a.astype(object) @ c.astype(object).T]
    assert hard_negatives.residue_scores(np.zeros((2, 3), np.int64), np.zeros((4, 3), np.int64)).shape == (2, 4)


def test_hard_negatives_match_a_plain_search(spark):
    rows = random_rows(n=400, dim=6, labels=3)
    got = hard_negatives.mine(hard_negatives.labelled(vectors(spark, rows)), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def test_hard_negatives_copy_no_anchors_through_the_driver(spark):
    mined = hard_negatives.mine(hard_negatives.labelled(vectors(spark, random_rows())), F.col("vec_id") % 50 == 0)
    mined.collect()
    final = mined._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    # Anchors may meet their positives by a broadcast, but their copies meet the candidates by none.
    assert final.count("BroadcastHashJoin") <= 1


def test_hard_negatives_of_ties_in_small_blocks_and_many_cells(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 6)
    monkeypatch.setattr(meeting, "PAIRS", 1)
    monkeypatch.setattr(meeting, "HELD", 100)
    rng = random.Random(9)
    rows = [(i, [rng.randrange(-2, 3) / 256 * 40 for _ in range(3)], rng.randrange(3)) for i in range(130)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(30)]
    rows += [(1000 + i, [4e6, 4e6 * rng.random(), -4e6 * rng.random(), 4.0], i % 3) for i in range(40)]
    got = hard_negatives.mine(hard_negatives.labelled(vectors(spark, rows)), F.col("vec_id") % 10 == 0)
    rows = [(i, None if v is None else [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, every=10)


def test_hard_negatives_small_blocks_and_edges(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    rows = random_rows(n=120, dim=4, labels=2) + [(1000, [0.0] * 4, 0), (1050, [0.0] * 4, 1), (1100, [-0.5] * 4, 0)]
    got = hard_negatives.mine(hard_negatives.labelled(vectors(spark, rows)), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)
    empty = hard_negatives.mine(hard_negatives.labelled(spark.createDataFrame([], VECTORS)), F.col("vec_id") % 50 == 0)
    assert empty.count() == 0


# ---------------------------------------------------------------- clustering


def plain_lloyd(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * float(x)) for x in e]) for i, e, _ in rows
            if i is not None and e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min(range(len(centroids)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, centroids[c], strict=True)), c))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        for c, members in groups.items():
            centroids[c] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    out = []
    for i, v in kept:
        c = nearest(v)
        out.append((i, c, sum((a - b) ** 2 for a, b in zip(v, centroids[c], strict=True))))
    per = {}
    for _, c, d in out:
        per[c] = per.get(c, 0) + d
    total = sum(per.values())
    return sorted((i, c, d, per[c], total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in out)


def test_clustering_matches_plain_lloyd(spark):
    rows = random_rows(n=250, dim=8)
    got = clustering.cluster(clustering.kept(vectors(spark, rows), dim=8), k=5, dim=8)
    assert sorted(tuple(r) for r in got.collect()) == plain_lloyd(rows, k=5, dim=8)


def test_clustering_edges(spark):
    # Fewer vectors than centroids, equal vectors (ties), and a constant dimension.
    rows = [(i, [0.25, 0.0, float(i % 2)], 0) for i in range(5)] + [(9, None, 0), (10, [0.1, float("inf"), 0.0], 0)]
    got = clustering.cluster(clustering.kept(vectors(spark, rows), dim=3), k=16, dim=3)
    assert sorted(tuple(r) for r in got.collect()) == plain_lloyd(rows, k=16, dim=3)
    assert clustering.cluster(clustering.kept(spark.createDataFrame([], VECTORS), dim=3), dim=3).count() == 0


def test_va_bounds_hold():
    rng = np.random.default_rng(4)
    m = rng.integers(-50, 50, (200, 6))
    lo = m.min(0)
    width = m.max(0) - lo + 1
    edges = lo[:, None] + (width[:, None] * np.arange(9)[None, :]) // 8
    codes = clustering._codes(m, edges).astype(np.intp)
    centroids = rng.integers(-60, 60, (4, 6))
    least, most = clustering._tables(centroids, edges)
    low = least[:, np.arange(6), codes].sum(axis=2).T
    high = most[:, np.arange(6), codes].sum(axis=2).T
    exact = ((m[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (low <= exact).all() and (exact <= high).all()


# ---------------------------------------------------------------- page text


def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{x:1}}</style><script>var s='</p>';</script></head><body>{body}</body></html>"


def site(i, rng):
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    paragraphs = "".join(f"<p>{text(rng.randrange(5, 30))}</p>" for _ in range(rng.randrange(1, 6)))
    extra = rng.choice(["", f"<aside>{text(6)}</aside>", f"<div id=\"comments\"><p>{text(8)}</p></div>", f"<div class=\"cookie-notice\">{text(5)}</div>"])
    return page(
        f"<header><a href=/>{text(2)}</a></header><nav><ul><li><a href=/a>{text(1)}</a></li><li><a href=/b>{text(1)}</a></li></ul></nav>"
        f"<div class=\"ad\">{text(4)}</div><article><h1>{text(4)}</h1><p><b>{text(6)}<br>{paragraphs}{extra}</article>"
        f"<form><label>{text(2)}</label><button>{text(1)}</button></form><footer>&copy; {text(3)} &amp; more</footer>"
    )


def test_blocks_decode_close_and_skip():
    html = page("<div>a &amp;  b<p>one<b>two</b>\n three<p>four<br>five</div><ul><li>x<li>y</ul>")
    assert [b.text for b in page_text.blocks_of(html)] == ["a & b", "onetwo three", "four", "five", "x", "y"]
    assert page_text.blocks_of(None) == [] and page_text.blocks_of("") == []
    assert [b.text for b in page_text.blocks_of("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>")] == ["yes"]


def test_labeller_learns_the_structure(spark):
    rng = random.Random(2)
    rows = [(i, f"https://e.example/{i}", site(i, rng)) for i in range(300)]
    rows += [(900, "u", None), (901, "u", ""), (902, None, "<html><body><nav>only menu</nav></body></html>"), (903, "u", site(0, random.Random(2))),
             (904, "u", page("<article><p>" + "long words here " * 5000 + "</p></article>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r for r in page_text.extract(pages, page_text.train(pages.where("page_id < 200"))).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        assert got[page_id].text == page_text.by_teacher(html), page_id
        assert got[page_id].n_chars == len(got[page_id].text)
    assert got[900].text == "" and got[901].text == "" and got[903].text == got[0].text
    assert "menu" not in got[0].text and "more" not in got[0].text


def test_labeller_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert page_text.extract(pages, page_text.train(pages)).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_fit_lowers_the_loss(seed):
    rng = random.Random(seed)
    described = []
    for i in range(40):
        found = page_text.blocks_of(site(i, rng))
        described.append((page_text.features(found).astype(float), page_text.teacher(found)))
    x, m, y = page_text._padded(described)
    before, _ = page_text.BiLSTM.initial().gradients(x, m, y)
    after, _ = page_text.fit(described, epochs=8).gradients(x, m, y)
    assert after < before / 4


def test_extra_and_clashing_columns_are_not_carried(spark):
    rows = random_rows(n=120, dim=4, labels=3)
    clashing = vectors(spark, rows).select(
        "*", F.lit(1).alias("cluster"), F.lit(2).alias("distance"), F.lit("x").alias("_bucket"), F.lit(3).alias("anchor_id"), F.lit(4).alias("v"),
    )
    got = clustering.cluster(clustering.kept(clashing, dim=4), k=4, dim=4)
    assert sorted(tuple(r) for r in got.collect()) == plain_lloyd(rows, k=4, dim=4)
    mined = hard_negatives.mine(hard_negatives.labelled(clashing), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in mined.collect()) == plain_negatives(rows)
    pages = spark.createDataFrame(
        [(1, "u", page("<article><p>kept text.</p></article><nav>menu</nav>"), "old", 5), (None, None, None, "x", 6)],
        "page_id long, url string, html string, text string, n_chars long",
    )
    model = page_text.fit([(page_text.features(page_text.blocks_of(site(i, random.Random(i)))).astype(float),
                            page_text.teacher(page_text.blocks_of(site(i, random.Random(i))))) for i in range(60)], epochs=6)
    out = {r.page_id: (r.text, r.n_chars) for r in page_text.extract(pages, model).collect()}
    assert out[None] == ("", 0) and set(out) == {1, None}


def test_pipeline_stages_take_clashing_columns_nulls_and_empty_texts(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", "s", 0), (900002, None, "en", "s", None)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(extra).select(
        "*", F.lit("x").alias("own_text"), F.lit(1).alias("kept"), F.lit(2).alias("n_removed"), F.lit(False).alias("accepted"),
        F.lit("y").alias("_doc"), F.lit(3).alias("_hash"), F.lit(4).alias("__input_row_x"),
    )
    total = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.count() <= total, name
