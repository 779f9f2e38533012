"""Correlation: records that share a key become one record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.operators.segments import HOT_ROWS, Bounds, segment


def correlate(
    df: DataFrame,
    group_by: str | Sequence[str],
    ts: str,
    tie: str,
    doc: str = "doc",
    *,
    expected_count: int | None = None,
    branch_by: str | None = None,
    required: Sequence[str] = (),
    timeout_seconds: float | None = None,
    on_timeout: str = "fire",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join records of a key into groups, in ``(ts, tie)`` order.

    Count mode gives ``docs``, an array of ``expected_count`` documents.  Branch mode gives
    ``docs``, a map from branch to its last document; a group is complete with all ``required``
    branches, or with ``expected_count`` different ones.  A group opens at its first row and
    closes ``timeout_seconds`` later; an incomplete one is emitted (``fire``) or dropped
    (``discard``).  At the end of a batch open groups count as timed out when a timeout is set,
    and are dropped otherwise, since they would still be waiting.  A row with a null branch is a
    member of its group and counts in ``n``, but is no branch.  Rows without a time form a group
    of their own, before the others of their key.
    """
    if on_timeout not in ("fire", "discard"):
        raise ValueError(f"on_timeout must be fire or discard, not {on_timeout}")
    if not required and not expected_count:
        raise ValueError("give expected_count or required")
    keys = [group_by] if isinstance(group_by, str) else list(group_by)
    span = None if timeout_seconds is None else round(timeout_seconds * 1_000_000)
    if branch_by is None:
        bounds = Bounds(max_rows=expected_count, max_span=span)
    elif required:
        bounds = Bounds(max_span=span, required=tuple(required))
    else:
        bounds = Bounds(max_span=span, branch_count=expected_count)
    runs = segment(df, keys, ts, tie, bounds, branch_by, hot_rows)
    if on_timeout == "discard" or span is None:
        runs = runs.where("run_complete")
    group = [*keys, F.col("run_id").alias("group_id"), "run_complete"]
    if branch_by is None:
        # A group holds at most expected_count rows, so the list is bounded.
        gathered = runs.groupBy(*group).agg(
            F.array_sort(F.collect_list(F.struct(ts, tie, doc))).alias("_rows"),
        )
        docs = F.transform("_rows", lambda r: r[doc])
        return gathered.select(
            *keys, "group_id", F.col("run_complete").alias("complete"),
            F.size("_rows").cast("bigint").alias("n"), docs.alias("docs"),
        )
    # One row per branch first, so repeats of a branch never pile up in a group.
    last = runs.groupBy(*group, branch_by).agg(
        F.max_by(doc, F.struct(ts, tie)).alias("_doc"), F.count(F.lit(1)).alias("_n")
    )
    named = last.groupBy(*keys, "group_id", "run_complete").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col(branch_by).isNotNull(), F.struct(branch_by, "_doc"))))
        ).alias("docs"),
        F.sum("_n").alias("n"),
    )
    return named.select(*keys, "group_id", F.col("run_complete").alias("complete"), "n", "docs")


def assign_batches(
    df: DataFrame,
    key: str | Sequence[str],
    ts: str,
    tie: str,
    max_messages: int,
    max_delay_seconds: float,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``batch_start``: the ``tie`` of the first row of the batch a row belongs to.

    A batch closes with ``max_messages`` rows, or when ``max_delay_seconds`` have passed since
    its first row, whichever comes first.
    """
    keys = [key] if isinstance(key, str) else list(key)
    bounds = Bounds(max_rows=max_messages, max_span=round(max_delay_seconds * 1_000_000))
    runs = segment(df, keys, ts, tie, bounds, hot_rows=hot_rows)
    return runs.select(*df.columns, F.col("run_id").alias("batch_start"))
