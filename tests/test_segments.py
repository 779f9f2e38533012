"""Greedy segments against a plain sequential model, for ordinary and for hot keys."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sluicework.operators.correlate import assign_batches, correlate
from sluicework.operators.dedup import dedup_ttl
from sluicework.operators.segments import Bounds, _solve, segment

import numpy as np


def model(rows, bounds):
    """rows: sorted (key, t, id, branch) -> {(key, id): (start id, complete)}"""
    out, by_key = {}, {}
    for r in rows:
        by_key.setdefault(r[0], []).append(r)
    for key, items in by_key.items():
        i = 0
        while i < len(items):
            members, seen, complete = [], set(), False
            while i < len(items):
                _, t, tie, branch = items[i]
                first = members[0][1] if members else t
                apart = (t is None) != (first is None) or (t is not None and bounds.max_span is not None and t >= first + bounds.max_span)
                if members and bounds.max_span is not None and apart:
                    break
                members.append(items[i])
                if branch is not None:
                    seen.add(branch)
                i += 1
                by_branch = (bounds.required and set(bounds.required) <= seen) or (
                    not bounds.required and bounds.branch_count and len(seen) >= bounds.branch_count
                )
                if (bounds.max_rows and len(members) >= bounds.max_rows) or by_branch:
                    complete = True
                    break
            for m in members:
                out[(key, m[2])] = (members[0][2], complete)
    return out


BOUNDS = [
    Bounds(max_rows=3),
    Bounds(max_span=7),
    Bounds(max_rows=4, max_span=9),
    Bounds(required=("a", "b")),
    Bounds(required=("a", "b", "c"), max_span=12),
    Bounds(branch_count=2, max_span=20),
    Bounds(branch_count=3),
]


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.sampled_from("abc")), min_size=1, max_size=40),
       st.sampled_from(BOUNDS))
def test_array_rule_matches_the_model(raw, bounds):
    rows = sorted((k, t, i, b) for i, (k, t, b) in enumerate(raw))
    group = np.unique([r[0] for r in rows], return_inverse=True)[1]
    is_start, start, complete = _solve(
        group, np.array([r[1] for r in rows]), np.array([r[3] for r in rows], dtype=object), bounds)
    got = {(r[0], r[2]): (rows[s][2], bool(c)) for r, s, c in zip(rows, start, complete)}
    assert got == model(rows, bounds)
    assert all((s == i) == bool(f) for i, (s, f) in enumerate(zip(start, is_start)))


def _random_rows(seed, n):
    rng = random.Random(seed)
    # One key holds about a third of all rows, with many equal times.
    return [(("hot" if rng.random() < 0.35 else rng.choice("wxyz")) if rng.random() > 0.05 else None,
             rng.randrange(0, n // 2), i, rng.choice("abc")) for i in range(n)]


def _with_nulls(rows):
    """Some times and branches missing, in hot and in ordinary keys."""
    return [(k, None if i % 13 == 0 else t, i, None if i % 7 == 0 else b) for k, t, i, b in rows]


@pytest.mark.parametrize("bounds", BOUNDS, ids=str)
@pytest.mark.parametrize("hot_rows", [10_000, 40])
def test_segments_match_the_model(spark, bounds, hot_rows):
    rows = _with_nulls(_random_rows(7, 400))
    df = spark.createDataFrame(rows, "k string, t long, id long, b string").repartition(3)
    out = segment(df, ["k"], "t", "id", bounds, "b" if bounds.required or bounds.branch_count else None, hot_rows).collect()
    ordered = sorted(rows, key=lambda r: (r[0] or "", -1 if r[1] is None else r[1], r[2]))
    expected = model(ordered, bounds)
    assert len(out) == len(rows)
    assert {(r.k, r.id): (r.run_id, r.run_complete) for r in out} == expected
    assert all(r.run_start == (r.run_id == r.id) for r in out)


def test_dedup_ttl_and_batches_agree_for_hot_and_ordinary(spark):
    rows = [(k or "none", t * 1_000_000, i) for k, t, i, _ in _random_rows(3, 300)]
    df = spark.createDataFrame(rows, "k string, us long, id long").selectExpr("k", "timestamp_micros(us) as ts", "id")
    for hot in (10_000, 25):
        kept = {r.id for r in dedup_ttl(df, "k", "ts", "id", 9, hot).collect()}
        expected = model(sorted((k, t, i, "") for k, t, i in rows), Bounds(max_span=9_000_000))
        assert kept == {i for (_, i), (s, _) in expected.items() if s == i}
        got = {r.id: r.batch_start for r in assign_batches(df, "k", "ts", "id", 4, 12, hot).collect()}
        expected = model(sorted((k, t, i, "") for k, t, i in rows), Bounds(max_rows=4, max_span=12_000_000))
        assert got == {i: s for (_, i), (s, _) in expected.items()}


@pytest.mark.parametrize("hot_rows", [10_000, 1])
def test_any_number_of_branches_and_null_ones(spark, hot_rows):
    rows = [("g", i, i, f"b{i}") for i in range(1500)] + [("g", 1500, 1500, None), ("h", 1, 9000, None), ("h", 2, 9001, "x")]
    df = spark.createDataFrame(rows, "cid string, s long, id long, source string").selectExpr(
        "cid", "timestamp_seconds(s) as ts", "id", "source", "concat('d', id) as doc")
    got = correlate(df, "cid", "ts", "id", branch_by="source", expected_count=1500, timeout_seconds=10_000, hot_rows=hot_rows).collect()
    assert {(r.cid, r.group_id): (r.complete, r.n, len(r.docs)) for r in got} == {
        ("g", 0): (True, 1500, 1500), ("g", 1500): (False, 1, 0), ("h", 9000): (False, 2, 1)}


@pytest.mark.parametrize("hot_rows", [10_000, 1])
def test_a_null_time_never_hides_another_row(spark, hot_rows):
    df = spark.createDataFrame([("k", 0, 1), ("k", None, 2), ("k", 5, 3)], "k string, s long, id long").selectExpr(
        "k", "timestamp_seconds(s) as ts", "id")
    assert sorted(r.id for r in dedup_ttl(df, "k", "ts", "id", 60, hot_rows).collect()) == [1, 2]


def test_correlate_modes(spark):
    rows = [("g", 1, 1, "inventory"), ("g", 2, 2, "pricing"), ("g", 3, 3, "pricing"), ("h", 1, 4, "pricing"), ("g", 90, 5, "inventory")]
    df = spark.createDataFrame(rows, "cid string, s long, id long, source string").selectExpr(
        "cid", "timestamp_seconds(s) as ts", "id", "source", "concat('d', id) as doc")
    counted = {(r.cid, r.group_id): list(r.docs) for r in correlate(df, "cid", "ts", "id", expected_count=2).collect()}
    assert counted == {("g", 1): ["d1", "d2"], ("g", 3): ["d3", "d5"]}
    fired = correlate(df, "cid", "ts", "id", branch_by="source", required=["inventory", "pricing"], timeout_seconds=5)
    assert {(r.cid, r.group_id): (r.complete, r.docs) for r in fired.collect()} == {
        ("g", 1): (True, {"inventory": "d1", "pricing": "d2"}), ("g", 3): (False, {"pricing": "d3"}),
        ("g", 5): (False, {"inventory": "d5"}), ("h", 4): (False, {"pricing": "d4"})}
    kept = correlate(df, "cid", "ts", "id", branch_by="source", expected_count=2, timeout_seconds=5, on_timeout="discard")
    assert [r.group_id for r in kept.collect()] == [1]
    with pytest.raises(ValueError):
        correlate(df, "cid", "ts", "id")
    with pytest.raises(ValueError):
        correlate(df, "cid", "ts", "id", expected_count=1, on_timeout="wait")
