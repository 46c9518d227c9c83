"""From raw documents to packed training sequences, in five stages.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame.  All but the last return the columns of documents.  ``run`` writes what a
stage returns to the shared folder before the next one reads it several times over.

Defined results: a null or blank text fails the quality rules; a text of any length goes through whole; of repeated rows with one
doc_id one stays; of rows with equal lines those of the least doc_id keep them, rows without an id last, and a row that loses all its
lines stays as an empty text; an empty table gives no rows; other columns of documents are carried along, whatever their names,
and dropped by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.decontaminate import without_leaks
from larkspur.llm.jaccard_join import keep_one
from larkspur.llm.line_dedup import line_dedup
from larkspur.llm.packing import best_fit_packing, default_tokenizer
from larkspur.llm.quality_rules import keep_good
from larkspur.llm.session import checkpoint


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that have an earlier like go; n_chars follows the text."""
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by 0.8 of their five-word shingles, the one with the least doc_id stays."""
    return keep_one(docs, k=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their places in the sequences."""
    return best_fit_packing(docs, default_tokenizer())


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", packing),
]

#: Fuzzy line deduplication and edit distances have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
