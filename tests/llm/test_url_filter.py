import re

from larkspur.llm.url_filter import LISTED, RULES, bloom_blocks, key_table, url_filter


def judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    best, listed = None, False
    for key, verdict, rule in [(k, v, True) for k, v in RULES] + [(k, "block", False) for k in LISTED]:
        h, p = key[: key.index("/")], key[key.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if rule:
                best = max(best or (0, 0, "", ""), (len(key), len(h), key, verdict))
            else:
                listed = True
    return host, path, best[2] if best else None, best[3] if best else ("block" if listed else "allow")


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "https://a.example.com/en/", "https://a.example.com/en", "https://www.example.com/enough",
    "https://sub.www.example.com/en/1", "http://net/es/", "http://x.net/fr/9", "http://x.net:80/fr/9", "http://notcom/", "http://com/", "http://com", "http://com?x", "http://x.com//",
    "a://b://c.com/", "http://spam-farm.example.org/x", "http://m.spam-farm.example.net/es/", "http://exämple.COM/É", "http://x.net/fr\n/",
]


def test_against_plain_rules(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, "http://x.com/", "x", "y"), (3, "http://x.com/", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, key_table(spark)).collect()), key=repr)
    assert got == sorted(((i, *judge(u)) for i, u, *_ in rows), key=repr)


def test_filter_is_exact_when_full(spark):
    """False positives of a one-block filter do not reach the result."""
    keys = spark.range(3000).selectExpr("concat('h', id, '.org/p', id) AS key", "'block' AS verdict", "false AS is_rule")
    pages = spark.range(4000).selectExpr("id AS page_id", "concat('http://h', id, '.org/p', id, '/x') AS url")
    assert url_filter(pages, keys).where("verdict = 'block'").count() == sum(any(str(i).startswith(str(j)) for j in [i]) for i in range(3000))
    assert bloom_blocks(keys, 1).count() == 1


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://x.com/")], "page_id long, url string")
    assert [r.verdict for r in url_filter(pages, key_table(spark, (), ())).collect()] == ["allow"]
    assert url_filter(pages.limit(0), key_table(spark)).count() == 0
