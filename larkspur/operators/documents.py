"""Category documents of any length, in numbered parts of a bounded size.

All bullets are sorted in ranges; the length of what a category has before a bullet is summed within its range and carried
over ranges, a number for each category and range.  So a category with a third of all memories is no single task's,
and no row holds more than a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators.rounds import checkpoint

PART_CHARS = 65_536
KEY = ["user_id", "memory_type", "memory_category"]


def running(rows: DataFrame, by: list[str], order: dict[str, Column], size: Column, name: str) -> DataFrame:
    """rows with ``name``: the sum of ``size`` over the rows before in the order of its group, in parallel for any size of group.

    order: the columns to sort by, ascending, by name; together with ``by`` they are unique.
    """
    named = rows.withColumns(order).withColumn("_size", size)
    keys = [*by, *order]
    ranges = checkpoint(named.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id()))
    within = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    parts = ranges.groupBy("_range", *by).agg(F.sum("_size").alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("_range", *by, F.coalesce(before, F.lit(0)).alias("_before"))
    out = ranges.withColumn("_own", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(parts, ["_range", *by])
    return out.withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before", "_size")


def category_parts(memories: DataFrame, most: int = PART_CHARS) -> DataFrame:
    """(user_id, memory_type, memory_category, part, n, body): the bullets of each category's active memories, most important first.

    A part has the bullets that begin within its ``most`` characters; its last one may reach beyond.  Blank memories have no bullet.
    """
    active = memories.where((F.col("status") == "active") & (F.trim("memory_content") != ""))
    rows = active.select(*KEY, "memory_id", "importance", "created_at", F.format_string("- (%.2f) %s\n", "importance", "memory_content").alias("bullet"))
    order = {"_i": -F.col("importance"), "_t": -F.col("created_at").cast("double"), "_m": F.col("memory_id")}
    placed = running(rows, KEY, order, F.length("bullet").cast("long"), "_at").withColumn("part", F.floor(F.col("_at") / most))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "bullet"))), lambda x: x["bullet"]), "")
    return placed.groupBy(*KEY, "part").agg(F.count("*").alias("n"), body.alias("body"))


def put(parts: DataFrame, root: str) -> None:
    """Writes each category's parts as a folder of its own, in place of what was there; other categories stay.

    Spark's commit puts the folders in place only when all tasks are done: a repeated task or job leaves the same state.
    """
    where = {"_user": T.safe_name(F.col("user_id")), "_dir": T.type_dir(T.type_or_default(F.col("memory_type"), F.col("memory_category"))), "_category": T.safe_name(F.col("memory_category"))}
    rows = parts.select(*[c.alias(n) for n, c in where.items()], "part", "n", "body")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*where).parquet(root)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(user, dir, category, parts, n) of what is there."""
    rows = spark.read.schema("part long, n long, body string, _user string, _dir string, _category string").parquet(root)
    return rows.groupBy(F.col("_user").alias("user"), F.col("_dir").alias("dir"), F.col("_category").alias("category")).agg(F.count("*").alias("parts"), F.sum("n").alias("n"))


def get(spark: SparkSession, root: str, user: str, memory_type: str, category: str) -> list[str]:
    """The document's parts in order: one category's text, which the caller asked for; empty if there is none."""
    of = spark.range(1).select(T.safe_name(F.lit(user)).alias("u"), T.type_dir(T.type_or_default(F.lit(memory_type), F.lit(category))).alias("d"), T.safe_name(F.lit(category)).alias("c")).first()
    rows = spark.read.schema("part long, n long, body string, _user string, _dir string, _category string").parquet(root)
    found = rows.where((F.col("_user") == of.u) & (F.col("_dir") == of.d) & (F.col("_category") == of.c)).orderBy("part").select("body").collect()
    summary = f"# {of.d} / {category}\n\n"
    return [summary + r.body if i == 0 else r.body for i, r in enumerate(found)]
