"""Two tables of vectors dealt so that every row of one meets every row of the other in one task.

Tasks are the cells of a grid: the rows that ask are cut into as many groups as the grid has lines
and copied to each of its columns, the offered rows into as many groups as it has columns and copied
to each line. The grid is the one of enough cells that copies the fewest rows; a group of askers is
small enough to be held, the offered rows of a cell are read batch after batch.

Rows meet by one shuffle of the union of both tables, not by a join: Spark can't know how far copies
and blocks grow a table, so a join may broadcast copies of many times its limit through the driver.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sluicework.llm.frames import tasks

#: Bytes of vectors, as 64-bit integers, that a task holds while the offered rows pass.
HELD = 32 << 20
#: Bytes of the offered vectors of a task, which are sorted behind those that ask.
PASSING = 128 << 20
#: Pairs of rows that are worth a task of their own.
PAIRS = 1 << 20
#: Cells for each core of the cluster.
WAVES = 4


class Sizes(NamedTuple):
    """Rows that ask, rows offered, and the bytes of the vectors of each."""

    asked: int
    offered: int
    held: int
    passing: int


def sizes(rows: DataFrame, asks: Column, offers: Column | None = None) -> Sizes:
    """Of the rows that ask and those that are offered (all, if not told), in one pass."""
    offers = F.lit(True) if offers is None else offers
    width = 8 * F.size("v")
    return Sizes(*rows.agg(F.count_if(asks), F.count_if(offers), *[F.coalesce(F.sum(F.when(x, width)), F.lit(0)) for x in (asks, offers)]).first())


def grid(of: Sizes, cells: int) -> tuple[int, int]:
    """Lines and columns: at most about ``cells`` cells, unless more are needed to bound what a task holds and sorts."""
    wanted = max(1, min(cells, -(-of.asked * of.offered // PAIRS)))
    least = max(1, -(-of.held // HELD))

    def columns(lines: int) -> int:
        return max(1, -(-wanted // lines), -(-of.passing // PASSING))

    lines = min(range(least, max(least, wanted) + 1), key=lambda n: n * of.offered + columns(n) * of.asked)
    return lines, columns(lines)


def meet(asked: DataFrame, offered: DataFrame, of: Sizes) -> DataFrame:
    """The rows of both tables, each partition a cell: first those that ask, ``side`` 0, then side 1.

    Both tables have vec_id and v; columns that only one of them has are null in the other's rows.
    """
    lines, columns = grid(of, min(tasks(asked), WAVES * asked.sparkSession.sparkContext.defaultParallelism))

    def copies(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = asked.select("*", F.lit(0).alias("side"), F.pmod(F.xxhash64("vec_id"), F.lit(lines)).alias("line"), copies(columns).alias("column"))
    offered = offered.select("*", F.lit(1).alias("side"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(columns)).alias("column"), copies(lines).alias("line"))
    cell = (F.col("line") * columns + F.col("column")).cast("int")
    both = asked.unionByName(offered, allowMissingColumns=True)
    return both.repartitionById(lines * columns, cell).drop("line", "column").sortWithinPartitions("side")


def sides(batches):
    """The batches of ``meet`` cut where the sides change: (side, rows)."""
    for part in batches:
        cut = int(np.searchsorted(part.column("side").to_numpy(), 1))
        if cut:
            yield 0, part.slice(0, cut)
        if cut < part.num_rows:
            yield 1, part.slice(cut)


def by_length(part: pa.RecordBatch, most: int):
    """Rows with vectors of one length, at most ``most`` at once: (dim, rows)."""
    lengths = np.diff(part.column("v").offsets.to_numpy())
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        for i in range(0, len(rows), most):
            yield int(dim), part.take(pa.array(rows[i : i + most]))


def held(parts: list[pa.RecordBatch], most: int):
    """``by_length`` over several batches together."""
    for part in pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else ():
        yield from by_length(part, most)


def matrix(part: pa.RecordBatch, dim: int) -> np.ndarray:
    return part.column("v").flatten().to_numpy().astype("<i8", copy=False).reshape(part.num_rows, dim)
