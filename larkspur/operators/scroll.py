"""A filtered table in pages of its key's order, numbered without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators.rounds import checkpoint

PAGE = 256
_ROW_BITS = 33
#: Parts of groups in ranges up to which their numbers are broadcast.
BROADCAST_PARTS = 200_000


def numbered(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """df with the place (from 0) of each row in the order of a unique key.

    Ranges of the key are sorted each by itself and written; then a row's place is its place in its range, after all rows of the ranges
    before, of which there are as many numbers as partitions.  Rows with a null key come first.
    """
    ranges = checkpoint(df.repartitionByRange(F.col(key)).sortWithinPartitions(key))
    at = F.monotonically_increasing_id()
    rows = ranges.withColumns({"_range": F.shiftright(at, _ROW_BITS).cast("int"), "_at": at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))})
    sizes = sorted(tuple(r) for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect())
    offsets, before = [], 0
    for r, n in sizes:
        offsets.append((r, before))
        before += n
    before_it = F.broadcast(df.sparkSession.createDataFrame(offsets, "_range int, _before bigint"))
    return rows.join(before_it, "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def numbered_within(df: DataFrame, by: str, order: list[str], ranges: list | None = None, name: str = "position") -> DataFrame:
    """df with the place (from 1) of each row among those of its group, in the order of columns that tell its rows apart.

    Groups are cut into ranges of their order, so that a large one is sorted by many tasks; ranges are sought by ``ranges``, monotone
    in the order, where the order's own columns are too long to be sampled.
    """
    cut = checkpoint(df.repartitionByRange(F.col(by), *(ranges or order)).sortWithinPartitions(by, *order))
    at = F.monotonically_increasing_id()
    rows = cut.withColumns({"_range": F.shiftright(at, _ROW_BITS).cast("int"), "_at": at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))})
    parts = rows.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_in")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_by").orderBy("_in").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = checkpoint(parts.select("_by", "_in", (before - F.col("_first") + 1).alias("_add")))
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_PARTS else parts
    return rows.join(parts, rows["_range"].eqNullSafe(parts["_in"]) & rows[by].eqNullSafe(parts["_by"])).withColumn(name, (F.col("_at") + F.col("_add")).cast("int")).drop("_range", "_at", "_by", "_in", "_add")


def pages(df: DataFrame, key: str, size: int = PAGE) -> DataFrame:
    """df with position and page (from 0)."""
    if size < 1:
        raise ValueError("a page has a row at least")
    return numbered(df, key).withColumn("page", F.floor(F.col("position") / size))


def cursors(paged: DataFrame, key: str) -> DataFrame:
    """(page, n, first, last): the pages of ``pages``; ``scroll`` goes on after ``last``."""
    return paged.groupBy("page").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))


def scroll(df: DataFrame, key: str, after=None, limit: int = PAGE) -> tuple[list, object]:
    """(rows, cursor) of one page by its key: the ``limit`` rows after the cursor, and the next one, or None at the end; rows with a null key are in no page."""
    rows = df.where(F.col(key).isNotNull() if after is None else F.col(key) > F.lit(after)).orderBy(key).limit(limit + 1).collect()
    return rows[:limit], rows[limit - 1][key] if len(rows) > limit else None
