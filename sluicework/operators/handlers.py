"""User functions over batches of records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BatchFunction = Callable[[pd.DataFrame], pd.DataFrame]


def apply_handler(df: DataFrame, fn: BatchFunction, schema: str) -> DataFrame:
    """A command handler over Arrow batches: each row gives one row or none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = fn(batch)
            if len(done) > len(batch):
                raise ValueError("a handler gives at most one row per row")
            yield done

    return df.mapInPandas(run, schema)


def type_handler(
    df: DataFrame, handlers: dict[str, tuple[str, BatchFunction]], schema: str,
    payload: str = "payload", metadata: str = "metadata",
) -> DataFrame:
    """Dispatch on ``metadata.kind``: parse the payload by the kind's schema, call its function.

    One scan: rows carry the parsed struct of their own kind only, and each Arrow batch is
    split by kind inside the task.  Rows of other kinds are dropped.
    """
    kind = F.col(metadata)["kind"]
    parsed = df.where(kind.isin(list(handlers))).select(
        kind.alias("kind"),
        *[
            F.when(kind == name, F.from_json(payload, row)).alias(f"doc_{i}")
            for i, (name, (row, _)) in enumerate(handlers.items())
        ],
    )
    numbered = {name: (i, fn) for i, (name, (_, fn)) in enumerate(handlers.items())}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("kind", sort=False):
                index, fn = numbered[name]
                yield fn(pd.DataFrame(list(part[f"doc_{index}"])))

    return parsed.mapInPandas(run, schema)


def on_batch(sdf: DataFrame, handlers: list[Callable[[DataFrame, int], None]], checkpoint: str, **trigger):
    """Event handlers: terminal, and each sees the same rows of every micro-batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for handler in handlers:
                handler(batch, batch_id)
        finally:
            batch.unpersist()

    writer = sdf.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def register_endpoint(spark: SparkSession, source: type) -> None:
    """Make a Python data source usable by name in ``spark.read`` and ``df.write``."""
    spark.dataSource.register(source)
