"""Rule-based document quality, as one projection of built-in functions.

``RULES`` is a threshold table; ``quality_rules`` compiles it into Columns.  All
comparisons are between whole numbers, so that every engine agrees on the edge.

Defined results: a null or blank text has no words and fails the base rules; a
null doc_id is kept as null; repeated rows are judged alike, each by itself; a text of
any length is judged by all its words; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and a in that have with was for is on are this it as by at from or an "
    "de la le et les des en un une du que qui dans pour est au sur par pas ne "
    "der die und den von zu das mit sich ist ein eine auf nicht dem es auch "
    "el y los del se las por con no su para al lo como"
).split()

#: (name, left side, comparison, right side): a document must meet every row. Sides are sums of factor * measure.
RULES = (
    ("mean word length, least", {"word_chars": 10}, ">=", {"n_words": 20}),
    ("mean word length, most", {"word_chars": 1}, "<=", {"n_words": 15}),
    ("symbols to words", {"n_symbols": 100}, "<=", {"n_words": 25}),
    ("stop words, least", {"n_stop": 100}, ">=", {"n_words": 2}),
    ("repeated lines", {"n_dup_lines": 100}, "<=", {"n_lines": 40}),
    ("lines that end in an ellipsis", {"n_ellipsis": 100}, "<=", {"n_lines": 50}),
)


def compile_rules(rules=RULES) -> Column:
    """The threshold table as one boolean Column over the measures."""
    verdict = F.lit(True)
    for _, left, op, right in rules:
        a, b = (sum((F.col(m) * f for m, f in side.items()), F.lit(0)) for side in (left, right))
        verdict = verdict & ((a >= b) if op == ">=" else (a <= b))
    return verdict


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs and the measures of each whole text (bigint)."""
    t = F.coalesce(F.col(text), F.lit(""))
    gone = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    # Each array stands in a projection of its own: it is computed once a row, not once an element.
    out = docs.withColumns(
        {
            "_w": F.filter(F.split(t, BLANKS), lambda w: w != ""),
            "_l": F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
            "_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")),
            "_symbols": gone(t, SYMBOLS),
        }
    )
    at = lambda i: F.get("_w", i)
    out = out.withColumn(
        "_k",
        F.when(
            F.size("_w") >= 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.size("_w") - 3),
                    lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("k"), i.alias("i")),
                )
            ),
        ).otherwise(F.expr("CAST(array() AS array<struct<k:string,i:int>>)")),
    )
    key = lambda j: F.get("_k", j)["k"]
    out = out.withColumn(
        "_p",
        F.sort_array(
            F.transform(
                F.filter("_k", lambda x, j: F.coalesce(key(j - 1) == x["k"], F.lit(False)) | F.coalesce(key(j + 1) == x["k"], F.lit(False))),
                lambda x: x["i"],
            )
        ),
    )
    # A repeated window covers three words, less those that the next repeated window covers as well.
    covered = F.aggregate(
        F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_p", j + 1), p + 3) - p)),
        F.lit(0),
        lambda a, x: a + x,
    )
    stop = F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))
    return out.withColumns(
        {
            "n_words": F.size("_w").cast("bigint"),
            "word_chars": F.col("_chars").cast("bigint"),
            "n_symbols": F.col("_symbols").cast("bigint"),
            "n_lines": F.size("_l").cast("bigint"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"),
            "n_repeat_words": covered.cast("bigint"),
            "n_stop": F.size(stop).cast("bigint"),
            "n_ellipsis": F.size(F.filter("_l", lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))).cast("bigint"),
        }
    ).drop("_w", "_l", "_k", "_p", "_chars", "_symbols")


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of docs (it needs doc_id and text)."""
    out = measures(docs.select("doc_id", "text")).drop("text")
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    return out.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that base and method rules keep; all columns, whatever their names."""
    rows = measures(docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text")))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    # The random column keeps Catalyst from pushing the filter below the measures, which would copy each array into every use of it.
    rows = rows.withColumns({"_good": ~failed & compile_rules(rules), "_fence": F.rand(0)})
    return rows.where(F.col("_good") & (F.col("_fence") >= 0)).select("_row.*")


# --- the registered query -------------------------------------------------


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    side = lambda x: " + ".join(f"{f} * {m}" for m, f in x.items())
    rules = " AND ".join(f"{side(a)} {op} {side(b)}" for _, a, op, b in RULES)
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents
), a AS (
  SELECT r, doc_id, x,
    regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM t
), k AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, key) AS c FROM (
    SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS key
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM a)
  )
), rep AS (
  SELECT r, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (
    SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM k WHERE c > 1
  ) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda q: lower(q) IN ({stops})))::BIGINT AS n_stop,
    len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis
  FROM a LEFT JOIN rep USING (r)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {rules} AS kept FROM f
"""


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {"op9_quality_rules": _sql()}
