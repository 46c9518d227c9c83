import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import collocations as C
from larkspur.llm.collocations import collocations, frequent_runs, scored
from larkspur.llm.text_hash import U


def brute(rows, least, most_words=5, top=2000, share=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most_words + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = {}
    for (lang, w), a in f.items():
        longer = [v for (x, z), v in f.items() if x == lang and len(z) > len(w) and any(z[i : i + len(w)] == w for i in range(len(z)))]
        if len(w) > 1 and not any(100 * v >= share * a for v in longer):
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top])]


def check(spark, rows, least, **options):
    df = spark.createDataFrame([(i, t, g, "x", 1) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n long")
    got = collocations(df.repartition(3), least, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(tuple(r) for r in got.collect())
    assert got == sorted(brute(rows, least, **options))
    return got


def texts(seed, n=60):
    """Pieces with all separators, odd blanks, several langs, phrases that only occur within longer ones."""
    rnd = random.Random(seed)
    vocab = ["The", "cat", "sat", "on", "Mat", "É", "é", "día", "x\xa0y", "a-b", "über", "it's", "\x1c", "𝄞"]
    fixed = ["red herring in the soup", "New York", "new york city", "one one one one"]
    out = []
    for i in range(n):
        parts = [rnd.choice(fixed) if rnd.random() < 0.3 else " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 12))]
        text = "".join(p.replace(" ", rnd.choice([" ", "  ", "\t", " \t "])) + rnd.choice([". ", ",", ";", ":", "!", "? ", "\n", "\x0b", "\x0c", "\r\n", " "]) for p in parts)
        out.append((rnd.choice(["en", "de", None, "und", "e\nn"]), text))
    return out + [("en", None), ("fr", ""), (None, " \t\n"), ("", "lone word"), *[("", "empty lang")] * 9, *out[:3] * 2]


@pytest.mark.parametrize(("seed", "least", "options"), [(1, 4, {}), (2, 2, {"top": 7}), (3, 3, {"most_words": 3, "share": 60}), (4, 6, {"most_words": 2})])
def test_against_plain_python(spark, seed, least, options):
    assert check(spark, texts(seed), least, **options)


def test_nothing_is_lost_when_sketches_are_full(spark, monkeypatch):
    """Sixteen cells for thousands of runs: estimates let all through, counts stay exact."""
    monkeypatch.setattr(C, "LEAST_CELLS", 16)
    monkeypatch.setattr(C, "MOST_CELLS", 16)
    assert check(spark, texts(5, 30), 3)


def test_high_thresholds_use_wider_cells(spark):
    rows = [("en", "so it goes. " * 40)] * 5
    assert [r[2] for r in check(spark, rows, 150)] == ["so it goes"]


def test_estimates_are_never_too_low():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 64, 500, dtype=U)
    counts = rng.integers(1, 40, 500)
    cells, least = 64, 20
    table = np.zeros((C.ROWS, cells), np.int64)
    for r in range(C.ROWS):
        np.add.at(table[r], C.places(h, r, cells), counts)
    bits = np.packbits(table >= least, axis=1, bitorder="little")
    assert C.passes(h, bits, cells)[counts >= least].all()


def test_sketches_merge_across_batches():
    """A block that two batches share, and sums past what a cell holds."""
    rows = [(0, 90), (0, 9), (1, 99), (1, 99), (1, 99), (2, 1)]
    batch = lambda x: pa.record_batch([pa.array([b for b, _ in x], pa.int32()), pa.array([bytes([n] * 16) for _, n in x])], names=["block", "body"])
    got = {b: bits for out in C._merged(99)(iter([batch(rows[:1]), batch(rows[1:3]), batch(rows[3:])])) for b, bits in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
    assert got == {0: b"\xff\xff", 1: b"\xff\xff", 2: b"\0\0"}


def test_long_text_and_few_cells_a_task(spark):
    rnd = random.Random(6)
    text = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + rnd.choice(["", "", ","]) for _ in range(60_000))
    check(spark, [("en", text), ("en", text[:1000])], 400)


def test_scores_past_64_bits_are_exact(spark):
    f = [("en", "a", 1, 10**15 + 7), ("en", "b", 1, 10**15 + 1), ("en", "a b", 2, 10**15 - 1)]
    n = 10**16 + 3
    frequent = spark.createDataFrame(f, "lang string, phrase string, words int, f long")
    r = scored(frequent, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert r.score == 1000 * (10**15 - 1) * n // ((10**15 + 7) * (10**15 + 1))


def test_equal_cuts_and_ranks(spark):
    """Ties after flooring go to the shorter head; equal scores to the greater count, then the phrase's bytes."""
    rows = [("x", "a a a a a"), *[("x", "p q")] * 4, *[("x", "r s")] * 4, *[("x", "é t")] * 4, *[("x", "z t2")] * 4]
    assert check(spark, rows, 2)


def test_empty_tables_and_clashing_names(spark):
    assert check(spark, [], 1) == [] and check(spark, [("en", "one")], 2) == []
    df = spark.createDataFrame([("a b", "en")] * 3, "text string, lang string").select("*", *[F.lit(1).alias(c) for c in ("phrase", "n", "f", "words", "rank", "left", "block")])
    assert [tuple(r) for r in collocations(df, 2).collect()] == [("en", 1, "a b", 3, 3, 3, 6, 2000)]
    assert frequent_runs(df, 4)[0].count() == 0
