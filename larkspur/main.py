"""``spark-submit larkspur/main.py extract|update|retrieve ...`` over a snapshot store."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from larkspur.plans.engine import Engine
from larkspur.sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larkspur")
    p.add_argument("--store", required=True, help="folder of the snapshot store, on any file system that Spark knows")
    p.add_argument("--now", required=True, help="time of the run, YYYY-MM-DD HH:MM:SS")
    commands = p.add_subparsers(dest="command", required=True)
    e = commands.add_parser("extract", help="histories and replayed model answers to memories")
    e.add_argument("--histories", required=True)
    e.add_argument("--answers", required=True, help="Parquet of (prompt_md5, response)")
    u = commands.add_parser("update", help="a sleep pass over all users")
    u.add_argument("--decisions", required=True, help="Parquet of merge decisions")
    r = commands.add_parser("retrieve", help="ranked memories of all queries")
    r.add_argument("--queries", required=True, help="Parquet of (query_id, user_id, text)")
    r.add_argument("--out", required=True)
    r.add_argument("--top-k", type=int, default=10)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("larkspur").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, args.store)
    if args.command == "extract":
        engine.answer = spark.read.parquet(args.answers)
        counts, rejected = engine.extract(tables.histories(spark, args.histories), args.now)
        print(counts, "rejected", rejected.groupBy("error").agg(F.count("*").alias("n")).collect())
    elif args.command == "update":
        engine.update(spark.read.parquet(args.decisions), args.now).show()
    else:
        hits = engine.retrieve(spark.read.parquet(args.queries), args.now, args.top_k)
        hits.select("query_id", "memory_id", "memory_content", "final_score", "rank").write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
