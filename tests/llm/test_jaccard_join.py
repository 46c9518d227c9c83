import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm.jaccard_join import jaccard_join, keep_one
from larkspur.llm.links import Bound, sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and den * inter >= num * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    key = lambda i: float("inf") if i is None else i
    least = {}
    for (doc, _), x in zip(rows, label, strict=True):
        least[x] = min(least.get(x, float("inf")), key(doc))
    return [(doc, len(s), None if least[x] == float("inf") else least[x]) for (doc, _), s, x in zip(rows, sets, label, strict=True)]


def rows_for(seed, n, group):
    """Documents with a line that all share, copies, chains of edits, and a large group of near copies."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    say = lambda m: [rnd.choice(vocab) for _ in range(m)]
    common, stem = say(25), say(80)
    rows = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.3 and rows:
            w = WORD.findall(rnd.choice(rows)[1] or "")
            for _ in range(rnd.randint(0, 3)):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocab)
            text = " ".join(w)
        else:
            text = " ".join(common + say(rnd.randint(0, 120)))
        rows.append((i, text.upper() if rnd.random() < 0.2 else text))
    for i in range(group):
        w = list(stem)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((n + i, "\n".join([" ".join(w[:40]), " ".join(w[40:])])))
    return rows


@pytest.mark.parametrize(("k", "num", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_against_brute_force(docs, k, num, seed):
    rows = [*rows_for(seed, 60, 70), (200, None), (201, ""), (202, " "), (203, "one"), (204, "ONE"), (None, "no id here at all now"), (5, "same id other text"), (300, "é É")]
    got = sorted((tuple(r) for r in jaccard_join(docs(rows), k, num, 100).collect()), key=repr)
    assert got == sorted(brute(rows, k, num, 100), key=repr)


def test_keep_one(docs):
    rows = [*rows_for(3, 30, 20), (90, ""), (90, ""), (91, None), (95, "again again again"), (95, "again again again")]
    got = keep_one(docs(rows), 5, 80, 100).collect()
    want = {doc for doc, _, least in brute(rows, 5, 80, 100) if doc == least}
    assert sorted(r.doc_id for r in got) == sorted(want)
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "score", "key", "kept"}


def test_null_ids_long_texts_and_clashing_columns(docs):
    long = " ".join(f"w{i % 977}q{i // 3}" for i in range(60_000))
    rows = [*[(None, f"a text that has no id {i % 7} " + "word " * i) for i in range(40)], (4, long), (5, long + " end"), (6, None), (None, None), (None, "")]
    got = sorted((tuple(r) for r in jaccard_join(docs(rows), 5, 80, 100).collect()), key=repr)
    assert got == sorted(brute(rows, 5, 80, 100), key=repr)
    names = ["_k", "_id", "_keep", "_n", "row", "late", "k", "id", "n", "component", "keep"]
    table = docs(rows).select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    kept = keep_one(table)
    assert kept.columns == table.columns
    kept = kept.collect()
    assert all([r[c] for c in names] == list(range(len(names))) for r in kept)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [4, 6]


def test_empty(docs):
    assert jaccard_join(docs([])).count() == 0
    assert keep_one(docs([])).count() == 0


def test_prefixes_and_sketches_lose_no_link():
    rng = np.random.default_rng(1)
    for num in (80, 90):
        bound = Bound(num, 100)
        for _ in range(3000):
            n, extra = int(rng.integers(1, 120)), int(rng.integers(0, 14))
            pool = np.unique(rng.integers(0, 1 << 63, n + extra, dtype=np.uint64))
            rng.shuffle(pool)
            cut = int(rng.integers(0, extra + 1))
            a, b = np.sort(pool[cut:]), np.sort(pool[: len(pool) - (extra - cut)])
            inter = len(np.intersect1d(a, b))
            if not len(a) or not len(b) or not bound.linked(inter, len(a), len(b)):
                continue
            assert set(a[: bound.prefix(len(a))].tolist()) & set(b[: bound.prefix(len(b))].tolist())
            pairs = lambda s: set(zip(s[:-1].tolist(), s[1:].tolist(), strict=True))
            if len(a) > 1 and len(b) > 1 and not np.array_equal(a, b):
                assert pairs(a[: bound.pair_prefix(len(a))]) & pairs(b[: bound.pair_prefix(len(b))])
            apart = int(np.bitwise_count(sketch(a, 8).view(np.uint64) ^ sketch(b, 8).view(np.uint64)).sum())
            assert bound.may(apart, len(a), len(b))


def test_keys_are_packed_for_some_texts_at_once(monkeypatch):
    """However long a batch is, its keys are not gathered whole; a set that an earlier part has is not sent again."""
    import pyarrow as pa

    from larkspur.llm import jaccard_join as J

    monkeypatch.setattr(J, "_TEXTS", 100, raising=False)
    one = [f"text {i} of many with these words" for i in range(200)]
    batch = pa.record_batch([pa.array(one + one[:50] + [None])], names=["text"])
    bound = J.Bound(90, 100)
    out = list(J._single(3, bound, 4)([batch]))
    keys = sum(bound.prefix(len(s)) for _, s in J.shingle_sets(pa.array(one), 3))
    assert len(out) == 2 and sum(sum(o.column("n").to_pylist()) for o in out) == keys
