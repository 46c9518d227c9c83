"""Hand-computed cases of the Column functions."""

import datetime as dt
import hashlib
import json
import math
import re
import uuid

import pytest
from pyspark.sql import functions as F

from larkspur.functions import json as J
from larkspur.functions import text as T
from larkspur.functions import time as D
from larkspur.functions import vector as V


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} {t}" for k, t in zip(values or ["x"], [_kind(v) for v in values.values()] or ["int"], strict=True)))
    return row.select(column.alias("r")).first()["r"]


def _kind(v):
    return {str: "string", float: "double", int: "long", list: "array<double>", type(None): "string", dict: "map<int, float>"}[type(v)]


def test_terms_and_counts(spark):
    text = "Hello WORLD x2 Frühstück 汉字㐀"
    assert one(spark, T.bm25_terms(F.col("t")), t=text) == ["hello", "world", "x", "2", "fr", "hst", "ck", "汉", "字"]
    assert one(spark, T.token_count(F.col("t")), t=text) == 3 + 6  # three CJK, six ASCII runs
    assert one(spark, T.token_count(F.col("t")), t=None) == 0
    assert one(spark, T.approx_tokens(F.col("t")), t="ab, c汉字 9") == ["ab", ",", "c", "汉", "字", "9"]
    assert one(spark, T.strip_blanks(F.col("t")), t=" a\tb\nc ") == "abc"


def test_ids(spark):
    assert one(spark, T.content_id(F.col("t")), t="é") == hashlib.md5("é".encode()).hexdigest()
    for s in ("memory-1", "x", "汉"):
        assert one(spark, T.point_id(F.col("t")), t=s) == str(uuid.uuid5(uuid.NAMESPACE_OID, s))
    assert one(spark, T.point_id(F.col("t")), t="12") == "12"
    assert one(spark, T.point_id(F.col("t")), t="6ba7b812-9dad-11d1-80b4-00c04fd430c8") == "6ba7b812-9dad-11d1-80b4-00c04fd430c8"
    parts = one(spark, T.snowflake_parts(F.col("v")), v=(1000 << 22) | (3 << 17) | (5 << 12) | 7)
    assert tuple(parts) == (1704067201000, 3, 5, 7)
    assert one(spark, T.item_key(F.col("c"), F.col("a"), F.col("b")), c="text", a="", b=None) == "content:text"


def test_keys_and_markdown(spark):
    key = T.object_key("/docs/", F.col("u"), F.col("t"), F.col("c"))
    assert one(spark, key, u="a b/c", t="", c="current_focus") == "docs/a_b_c/Core Memory/current_focus.md"
    assert one(spark, key, u="ü", t="odd", c="x") == "docs/ü/Memory/x.md"
    none = T.render_section(F.lit("profile"), F.lit("fact"), F.lit(" s "), F.array(F.lit(" ")))
    assert one(spark, none) == "# Profile Memory / fact\n\n## 摘要\ns\n\n## 详细记忆\n- (暂无)\n"
    norm = lambda t: one(spark, T.normalise_markdown(F.col("t"), F.lit("profile"), F.lit("fact")), t=t)
    assert norm("```markdown\n# T\nx\n```") == "# T\nx\n"
    assert norm(" x ") == "# Profile Memory / fact\n\nx\n"
    assert one(spark, T.mask(F.col("t")), t="abcdefgh") == "abcd***"
    assert tuple(one(spark, T.speaker(F.col("t"), F.lit("Lin"), F.lit("Chen")), t="Speaker_A")) == ("Lin", True)
    assert tuple(one(spark, T.speaker(F.col("t"), F.lit("Lin"), F.lit("Chen")), t="Lin")) == ("Lin", False)


def test_times(spark):
    wall = lambda t: one(spark, D.wall_clock(F.col("t")), t=t)
    assert wall("2025-01-02T13:21:00+08:00") == "2025-01-02 13:21:00.000"
    assert wall("2025-01-02T13:21:00.123987Z") == "2025-01-02 13:21:00.123"
    assert wall("garbage") == "garbage"
    norm = lambda t: one(spark, D.normalise_timestamp(F.col("t")), t=t)
    assert norm("2025/12/02 (Tue) 17:06") == "2025-12-02 17:06:00"
    assert norm(" 2025-12-02T17:06:00.5 ") == "2025-12-02 17:06:00"
    assert norm("nope") is None
    decay = lambda t, tau=30.0: one(spark, D.time_decay(F.try_to_timestamp("t"), F.lit("2025-01-31 00:00:00"), tau), t=t)
    assert decay("2025-01-01 00:00:00") == pytest.approx(math.exp(-1))
    assert decay("2026-01-01 00:00:00") == decay("garbage") == decay(None) == decay("2025-01-01 00:00:00", 0) == 1.0
    assert one(spark, D.beijing(F.lit(dt.datetime(2025, 1, 1, 20)))) == "2025-01-02 04:00:00"


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, V.cosine(a, b), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, V.cosine(a, b), a=[0.0, 0.0], b=[1.0, 1.0]) == 0.0
    assert one(spark, V.euclid(a, b), a=[0.0, 3.0], b=[4.0, 0.0]) == 5.0
    assert one(spark, V.manhattan(a, b), a=[0.0, 3.0], b=[4.0, 0.0]) == 7.0
    assert V.distance("L2")[1] and V.distance("what")[0] is V.cosine
    v = one(spark, V.hash_embedding(T.bm25_terms(F.col("t"))), t="a b a")
    place = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64 for w in "ab"}
    assert v[place["a"]] == pytest.approx(2 / math.sqrt(5)) and v[place["b"]] == pytest.approx(1 / math.sqrt(5))
    assert one(spark, V.hash_embedding(T.bm25_terms(F.col("t"))), t="") == [0.0] * 64
    assert one(spark, V.lexical_score(a, b), a={1: 0.5, 2: 2.0}, b={2: 3.0, 9: 1.0}) == 6.0


def test_json(spark):
    unit = lambda t: one(spark, J.safe_unit(F.col("t")), t=t)
    assert [unit(x) for x in ("0.3", "7", "-1", "high", None)] == [0.3, 1.0, 0.0, 0.5, 0.5]
    got = lambda t: one(spark, J.parse_object(F.col("t")).cast("string"), t=t)
    assert got('{"a":1}') == '{"a":1}'
    assert got('Sure! {"a": [1, 2]} done') == '{"a":[1,2]}'
    assert got("no") is None
    ints = J.int_list(F.try_parse_json("t"))
    assert one(spark, ints, t='[1, true, "2", 3.5, 4]') == [1, 4]
    assert one(spark, J.repair(F.col("t")), t='{"a"：1，"b": [2,],}') == '{"a":1,"b": [2]}'


def extracted(text):
    """The reading of answers in plain Python, for tests: strings are left aside where brackets are counted."""

    def parses(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    text = text.strip()
    fence = re.search(r"```(?:json)?\s*([\s\S]*?)```", text)
    found = [fence.group(1).strip()] if fence else []
    found.append(text)
    for opener, closer in ("{}", "[]"):
        start, depth, quoted, escaped = text.find(opener), 0, False, False
        for i in range(start, len(text)) if start >= 0 else ():
            c = text[i]
            if quoted:
                quoted, escaped = escaped or c != '"', c == "\\" and not escaped
            elif c == '"':
                quoted = True
            depth += (c == opener) - (c == closer) if not quoted else 0
            if not depth:
                found.append(text[start : i + 1])
                break
    return next((t for t in found if t and parses(t)), None)


def test_outermost_json(spark):
    texts = [
        '{"a":1}', "pre {\"a\": {}} tail", 'x ```json\n{"a": 1}``` y', '```\nnot json\n``` then {"b": 2}', "```json\n[1, 2]\n```", '{"a": 1} and {"b": 2}', 'see {"s": "}{", "t": "\\"}"} end',
        '{"open": [1, 2', "[1, [2, {\"k\": 3}]] x", "a {bad} [1] b", "no json", "", "  ", "7", '"text"', " \u00a0[1]\u3000", 'say "hi" {"k": "v"}', "} { }", "x } {\"a\": 1}", '{"a": "' + "y" * 20000 + '\\\\"} z',
        "```json\n{\"outer\": \"```inner```\"}\n```", 'q " { "a": 1 }', "[" * 50 + "]" * 50 + "!", "{}" * 3, '{"a": "unclosed } string', "[1,2] {3}",
    ]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string")
    got = {r.i: r.j for r in df.select("i", J.outermost(F.col("t")).alias("j")).collect()}
    want = {i: None if t is None else extracted(t) for i, t in enumerate([*texts, None])}
    assert got == want and sum(v is not None for v in want.values()) > 15
