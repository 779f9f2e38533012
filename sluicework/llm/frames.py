"""Small helpers on tables and staged files shared by the operators."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluicework.session import cut_lineage, staging_path  # noqa: F401

LEAST_LONG = -(1 << 63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_key(column: str = "doc_id") -> Column:
    """A document's key as long; a null key is the smallest."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LEAST_LONG).cast("long"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that later steps don't redo it."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a path or URI."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)],
        schema=schema,
    )
