import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import simhash
from larkspur.llm.simhash import cells, fingerprint, fingerprint_components, meeting_places, points, simhash_components
from larkspur.llm.text_hash import U

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    h = [xxhash.xxh64(" ".join(w[i : i + n]).encode(), 42).intdigest() for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labels(prints, distance=2):
    """Component numbers by all pairs."""
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    return label


def brute(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    label = labels(prints)
    ids = {}
    for (doc, _), x in zip(rows, label, strict=True):
        ids.setdefault(x, []).append(doc)
    least = {x: min((i for i in v if i is not None), default=None) for x, v in ids.items()}
    return [(doc, f"{p:016x}", least[x]) for (doc, _), p, x in zip(rows, prints, label, strict=True)]


def check(docs, rows):
    got = sorted((tuple(r) for r in simhash_components(docs(rows), 3).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_against_all_pairs(docs):
    rnd = random.Random(4)
    vocab = [f"W{i}é" for i in range(200)]
    stem = [rnd.choice(vocab) for _ in range(120)]
    rows = [(5, None), (3, ""), (4, " \t\n"), (None, ""), (6, "one"), (7, "ONE"), (8, "two words"), (9, "a\x0bb\x0cc\x1cd"), (None, "no id"), (None, "no id"), (6, "one")]
    for i in range(10, 160):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))] if i % 3 else list(stem)
        for _ in range(rnd.randint(0, 2)):
            if w:
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, "  ".join(w)))
    check(docs, rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(*(c.to_pylist() for c in t.columns), strict=True))
    assert sorted(tuple(r) for r in simhash_components(docs, 3).collect()) == sorted(brute(rows))


def test_long_text(docs):
    rnd = random.Random(5)
    text = " ".join(f"w{rnd.randrange(5000)}" for _ in range(80_000))
    assert fingerprint(text, 3) == plain_fingerprint(text)
    check(docs, [(1, text), (2, text + " more"), (3, "other")])


def test_empty_table_and_clashing_names(docs):
    assert simhash_components(docs([])).count() == 0
    table = docs([(1, "a b c"), (2, "a b c")]).select("*", *[F.lit(1).alias(c) for c in ("f", "late", "k", "n", "first", "component", "least", "fingerprint")])
    assert {tuple(r)[::2] for r in simhash_components(table).collect()} == {(1, 1), (2, 1)}


def ball(rng, center, n, most):
    return {int(center) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, most + 1)), replace=False)) for _ in range(n)}


@pytest.mark.parametrize("distance", [1, 2])
def test_crowds_and_chains(spark, monkeypatch, distance):
    """Thousands of fingerprints around one, whose cells are refined, chains of 2 bits, and strangers."""
    rng = np.random.default_rng(distance)
    prints = ball(rng, 0x0F0F123456789ABC, 1500, 3) | ball(rng, (1 << 64) - 1, 300, 5) | {int(x) for x in rng.integers(0, 1 << 63, 500)}
    x = 0x1111222233334444
    for i in range(0, 60, 2):
        x ^= 3 << i
        prints.add(x)
    prints = sorted(prints)
    signed = np.array(prints, U).view(np.int64).tolist()
    monkeypatch.setattr(simhash, "DENSE", 3)
    assert (np.unique(points(np.array(prints, U)), return_counts=True)[1] > simhash.DENSE).sum() > 9
    got = dict(tuple(r) for r in fingerprint_components(spark.createDataFrame([(f,) for f in signed], "f long"), distance).collect())
    label = labels(prints, distance)
    least = {}
    for f, y in zip(signed, label, strict=True):
        least[y] = min(least.get(y, f), f)
    assert {f: got.get(f, f) for f in signed} == {f: least[y] for f, y in zip(signed, label, strict=True)}


def test_links_meet_whatever_is_refined():
    """Both ends of any link share a meeting place, for no, some or all cells refined."""
    rng = np.random.default_rng(7)
    f = rng.integers(0, 1 << 64, 400, dtype=U)
    f[:4] = [0, (1 << 64) - 1, 1, 1 << 63]
    some = rng.integers(0, 1 << 64, 64, dtype=U)
    for dense in (None, some, np.full(16, (1 << 64) - 1, U)):
        place = lambda g: set(meeting_places(np.array([g], U), dense)[0].tolist())  # noqa: E731, B023
        for x in f.tolist():
            a, b = (int(i) for i in rng.choice(64, 2, replace=False))
            for y in (x ^ 1 << a, x ^ 1 << a ^ 1 << b):
                assert place(x) & place(y)
                assert np.abs(counts(x) - counts(y)).sum() <= (x ^ y).bit_count()


def counts(x):
    return np.array([int(points(np.array([x], U))[0]) >> 4 * i & 15 for i in range(16)])


def test_cells_stay_in_range():
    at, exists = cells(points(np.array([0, (1 << 64) - 1], U)))
    assert exists.sum(1).tolist() == [17, 17] and len(set(at[0][exists[0]].tolist())) == 17
