"""Very long, empty and repeated inputs, and names that clash, for operators whose own tests do not have them."""

from pyspark.sql import functions as F
from tests.llm.test_pipeline import brute_quality
from tests.llm.test_quality_rules import texts
from tests.llm.test_secret_scan import brute as brute_secrets

import corpus_pipeline
from larkspur.llm.decontaminate import leaks
from larkspur.llm.html_extract import html_extract
from larkspur.llm.quality_rules import quality_rules
from larkspur.llm.secret_scan import base_spans
from larkspur.llm.url_filter import key_table, url_filter


def test_very_long_url(spark):
    path = "/en/" + "x/" * 200_000
    pages = spark.createDataFrame([(1, "http://a.example.com" + path), (2, "http://" + "sub." * 3000 + "x.net/es/?q")], "page_id long, url string")
    got = {r.page_id: r for r in url_filter(pages, key_table(spark)).collect()}
    assert got[1].path == path and got[1].verdict == "block" and got[2].rule == "net/es/"


def test_very_long_texts(docs):
    text = " ".join(f"w{i} the of" for i in range(4_000)) + " password=abcdef1 AKIA" + "Z" * 30
    rows = [(1, text), (1, text), (2, None)]
    assert [(r.doc_id, r.kept) for r in quality_rules(docs(rows)).orderBy("doc_id").collect()] == [(1, brute_quality(text))] * 2 + [(2, False)]
    assert base_spans(text) == brute_secrets(text) and len(base_spans(text)) == 2


def test_empty_tables(spark, docs):
    none = docs([])
    items = spark.createDataFrame([(1, "a passage of the benchmark that is long enough to be sought in texts")], "item_id long, text string")
    assert quality_rules(none).count() == 0
    assert leaks(none, items).count() == 0 and leaks(docs([(1, items.first().text)]), items.limit(0)).count() == 0
    assert html_extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_clashing_names(spark, docs):
    more = {c: F.lit(1) for c in ("_w", "_k", "_p", "words", "n_words", "late", "row", "item_id", "spans")}
    text = "The cat of the house is on the mat. " * 30
    table = docs([(1, text), (2, "short")]).withColumns(more)
    assert sorted((r.doc_id, r.kept) for r in quality_rules(table).collect()) == sorted((r.doc_id, r.kept) for r in quality_rules(docs([(1, text), (2, "short")])).collect())
    items = spark.createDataFrame([(7, "the cat of the house is on the mat. the cat of the house is on the mat.", 1, 2)], "item_id long, text string, doc_id int, k int")
    assert {(r.doc_id, r.item_id) for r in leaks(table, items).collect()} == {(1, 7)}


def test_pipeline_on_repeats(spark, docs, tmp_path):
    text = texts()[4]
    assert brute_quality(text)
    spark.createDataFrame([(1, "no such passage is in any of these documents at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(5, text), (5, text), (9, text), (None, text), (3, None), (None, None)]
    docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got if r.length > 1} == {5} and sum(r.length > 1 for r in got) == 1
    assert {r.doc_id for r in got} == {5, 9, None}  # what loses all its lines stays as an empty text
