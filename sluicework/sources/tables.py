"""Table, query, incremental and change-feed sources."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.functions.expressions import compile_expr


def jdbc_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a JDBC read: a table split into ranges, or one user query."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    options = {"url": url, "fetchsize": str(fetch_size)}
    options["dbtable"] = table if table is not None else f"({query}) AS source"
    if partition_column:
        if not bounds or not partitions:
            raise ValueError("a partitioned read needs bounds and a partition count")
        options |= {
            "partitionColumn": partition_column, "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]), "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, **parts: Any) -> DataFrame:
    """Non-destructive read; filters and columns are pushed to the database by Spark."""
    return spark.read.format("jdbc").options(**jdbc_options(url, **parts)).load()


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 1000, create: bool = True) -> None:
    """Append rows in batches; a missing table is created only when ``create`` is set."""
    if not create:
        read_jdbc(df.sparkSession, url, table=table).schema  # fails when the table is missing
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch_size)).mode("append").save()


def read_table(spark: SparkSession, path: str, predicate: str | None = None) -> DataFrame:
    """A stored table; a predicate is a Column filter, so it reaches the scan."""
    df = spark.read.parquet(path)
    return df if predicate is None else df.where(compile_expr(predicate, df))


def read_query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """A user SELECT as the source; tables are named as ``{name}`` in the text."""
    return spark.sql(sql, **tables)


def read_incremental(df: DataFrame, cursor: str, last: Any | None) -> DataFrame:
    """Rows after the last cursor value. One ranged read, so no ordering is needed."""
    return df if last is None else df.where(F.col(cursor) > F.lit(last))


def read_changes(
    df: DataFrame, operation: str, lsn: str, ordinal: str | None = None
) -> DataFrame:
    """Name the change columns ``op``, ``lsn``, ``ordinal`` and refuse unknown operations."""
    known = F.lower(F.col(operation))
    checked = F.when(known.isin(list(OPERATIONS)), known).otherwise(
        F.raise_error(F.concat(F.lit("unknown change operation: "), F.coalesce(known, F.lit("null"))))
    )
    out = df.withColumn("op", checked).withColumn("lsn", F.col(lsn).cast("bigint"))
    number = F.col(ordinal).cast("bigint") if ordinal else F.lit(0).cast("bigint")
    return out.withColumn("ordinal", number)


# Operations of a change feed.
OPERATIONS = ("insert", "update", "replace", "delete", "truncate")


def capture_all(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """Existing rows as inserts at position 0, then the changes."""
    first = snapshot.withColumns(
        {"op": F.lit("insert"), "lsn": F.lit(0).cast("bigint"), "ordinal": F.lit(0).cast("bigint")}
    )
    return first.unionByName(changes)


def capture(mode: str, snapshot: DataFrame, changes: DataFrame, since: int | None = None) -> DataFrame:
    """``snapshot``: existing rows once. ``capture_new``: changes after ``since``. ``capture_all``: both."""
    if mode == "snapshot":
        return snapshot
    if mode == "capture_all":
        return capture_all(snapshot, changes)
    if mode == "capture_new":
        return changes if since is None else changes.where(F.col("lsn") > since)
    raise ValueError(f"unknown capture mode {mode}")


def start_position(
    df: DataFrame, start: str, order: list[str], subject: str | None = None, since: Column | None = None
) -> DataFrame:
    """Where a reader begins: ``all``, ``new``, ``last`` or ``last_per_subject``.

    The last record comes from a partial aggregate, so one busy subject is not gathered.
    """
    if start == "all":
        return df
    if start == "new":
        if since is None:
            raise ValueError("start=new needs the position to start after")
        return df.where(since)
    newest = F.max_by(F.struct("*"), F.struct(*order)).alias("r")
    if start == "last":
        return df.agg(newest).where(F.col("r").isNotNull()).select("r.*")
    if start == "last_per_subject":
        return df.groupBy(F.col(subject).alias("_subject")).agg(newest).select("r.*")
    raise ValueError(f"unknown start position {start}")
