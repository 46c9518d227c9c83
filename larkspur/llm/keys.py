"""A key for every document, null ids included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: late (no doc_id) and k: documents are ordered by both; those without an id come last, each under a hash of its text.
KEY = ["late", "k"]
KEY_SCHEMA = "late boolean, k long"


def text_column() -> Column:
    return F.col("text").cast("string")


def key_columns() -> list[Column]:
    doc_id = F.col("doc_id").cast("long")
    return [doc_id.isNull().alias("late"), F.coalesce(doc_id, F.xxhash64(text_column())).alias("k")]


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, late, k): all columns of a document in one struct, so that no name clashes; the text as a string."""
    columns = [text_column().alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), *key_columns())


def text_of(batch):
    """The texts of a batch of whole rows."""
    return batch.column("row").field("text")


def unfolded(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
