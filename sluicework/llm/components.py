"""Connected components of a table of links, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluicework.llm.frames import staged


def _roots(parents: DataFrame) -> DataFrame:
    """Follow (node, parent) pairs to their ends; parents are never larger than their nodes."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("further"))
        longer = parents.join(up, "parent", "left").select("node", F.coalesce("further", "parent").alias("to"), "parent")
        longer = staged(longer, "roots")
        moved = longer.where("to <> parent").limit(1).count()
        parents = longer.select("node", F.col("to").alias("parent"))
        if not moved:
            return parents


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node that it reaches) for every node of ``links`` (a, b).

    Every round each node hooks to its smallest neighbour if that is smaller, trees collapse to
    their roots, and links between different roots remain. Minima combine before the shuffle, so a
    node with very many links is no burden.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    labels = None
    while True:
        links = staged(links, "links")
        if not links.limit(1).count():
            break
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parents = staged(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("parent")), "parents")
        parents = _roots(parents)
        if labels is None:
            labels = parents.withColumnRenamed("parent", "label")
        else:
            moved = parents.select(F.col("node").alias("label"), F.col("parent").alias("moved"))
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("moved", "label").alias("label"))
        labels = staged(labels, "labels")
        left = parents.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        right = parents.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        links = (
            links.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label"))
