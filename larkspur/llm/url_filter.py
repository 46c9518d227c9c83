"""URL filtering by a blocked Bloom filter and an exact join.

The list holds canonical keys, host + path, each with a verdict; a key fits its host
and all subdomains where the url's path starts with the key's.  Every distinct
(host, path) is expanded into the keys that could fit it: its host suffixes times
the path lengths that the list has.  A blocked Bloom filter of the list, one row of
four 64-bit lanes a block and broadcast with a bounded number of blocks, passes the
possible hits to a hash join with the list itself, which removes false positives.
Contract rules beat plain list entries; the longest rule wins, then the longer host.

Defined results: a null url, or one without ``://``, has an empty host and path and
is allowed; a url of any length is judged in whole; an empty list allows all, and an
empty table gives no rows; repeated rows are judged alike; null page ids stay null;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_KEY = 16
LANES = 4
#: The filter's bound: so many blocks of 256 bits. A longer list gets a fuller filter; the join keeps the result exact.
MAX_BLOCKS = 1 << 20

# The rules of the query's contract, and hosts listed as spam.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
LISTED = ("cheap-pills.example.com/", "cheap-pills.example.net/", "cheap-pills.example.org/", "spam-farm.example.com/", "spam-farm.example.net/", "spam-farm.example.org/")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end; A-Z lower-cased; empty if there is none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_table(spark: SparkSession, rules=RULES, listed=LISTED) -> DataFrame:
    """(key, verdict, is_rule) from literal lists; larger lists come as a DataFrame of these columns."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = [f"({q(k)}, {q(v)}, true)" for k, v in rules] + [f"({q(k)}, 'block', false)" for k in listed]
    if not rows:
        return spark.sql("SELECT '' AS key, '' AS verdict, true AS is_rule WHERE false")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(key, verdict, is_rule)")


def _masks(key: Column) -> list[Column]:
    """The bit that a key sets in each lane of its block."""
    h = F.xxhash64(key, F.lit("lane"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int")) for j in range(LANES)]


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, lane0..lane3): at most n_blocks rows."""
    block = F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block")
    rows = keys.select(block, *[m.alias(f"m{j}") for j, m in enumerate(_masks(F.col("key")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"m{j}").alias(f"lane{j}") for j in range(LANES)])


def url_filter(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and listed for every row of pages (page_id, url); keys: (key, verdict, is_rule)."""
    keys = keys.where(F.col("key").isNotNull())
    slash = F.instr("key", "/")
    path_chars = F.when(slash > 0, F.length("key") - slash + 1).otherwise(0)
    # Two small facts of the list: its size, and which path lengths it has (no more than a url is long).
    n, lengths = keys.agg(F.count("*"), F.collect_set(path_chars)).first()
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not n:
        return judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(False).alias("listed"))
    n_blocks = max(1, min(MAX_BLOCKS, -(-n * BITS_PER_KEY // 256)))
    urls = judged.where("host != ''").select("host", "path").distinct()
    labels = F.split("host", "\\.")
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= x, F.substring("path", 1, x)) for x in sorted(lengths)]), lambda p: p.isNotNull())
    candidates = (
        urls.withColumn("_l", labels)
        .withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size("_l")), lambda i: F.array_join(F.slice(F.col("_l"), i, F.size("_l")), "."))))
        .withColumn("prefix", F.explode(prefixes))
        .select("host", "path", F.concat("suffix", "prefix").alias("key"), F.length("suffix").alias("host_chars"))
        .withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)))
    )
    bloom = F.broadcast(bloom_blocks(keys, n_blocks))
    hit = F.col("c.block") == F.col("b.block")
    for j, m in enumerate(_masks(F.col("c.key"))):
        hit = hit & (F.col(f"b.lane{j}").bitwiseAND(m) == m)
    possible = candidates.alias("c").join(bloom.alias("b"), hit, "left_semi")
    exact = possible.join(keys, "key")
    rule = F.struct(F.length("key").alias("n"), F.col("host_chars").alias("h"), F.col("key").alias("rule"), F.col("verdict").alias("verdict"))
    best = exact.groupBy("host", "path").agg(F.max(F.when(F.col("is_rule"), rule)).alias("r"), F.bool_or(~F.col("is_rule")).alias("listed"))
    return judged.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("listed"), "block"), F.lit("allow")).alias("verdict"),
        F.coalesce("listed", F.lit(False)).alias("listed"),
    )


# --- the registered query -------------------------------------------------


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), key_table(spark))


_KEYS = ", ".join([f"('{k}', '{v}', true)" for k, v in RULES] + [f"('{k}', 'block', false)" for k in LISTED])
_SQL = rf"""
WITH k AS (
  SELECT key, verdict, is_rule, split_part(key, '/', 1) AS kh, substr(key, strpos(key, '/')) AS kp FROM (VALUES {_KEYS}) t(key, verdict, is_rule)
), p AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), b AS (
  SELECT r, max(CASE WHEN is_rule THEN {{'n': length(key), 'h': length(kh), 'rule': key, 'verdict': verdict}} END) AS best, bool_or(NOT is_rule) AS listed
  FROM p JOIN k ON (host = kh OR ends_with(host, '.' || kh)) AND starts_with(path, kp) GROUP BY r
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, coalesce(listed, false) AS listed
FROM p LEFT JOIN b USING (r)
"""

QUERIES = {"op2_url_filter": op2_url_filter}
ORACLES = {"op2_url_filter": _SQL}
