import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm.packing import Encoder, best_fit_packing, default_tokenizer, plan_bins
from larkspur.llm.text_hash import utf8

TEXTS = ["", None, "a", "Hello  world\n\n x", "é ñ ß\t\tfoo'll don't  \n bar ", " lead", "tail ", "\n", "a\x85b c d", "x  <|endoftext|> y", "汉字 テスト 12,345.67!!", "a\x1cb \x1c c"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def test_encoder_matches_tokenizer(tokenizer):
    rnd = random.Random(3)
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice("ab é1,'\n \t　\x85ll") for _ in range(200)) for _ in range(200)]
    enc = Encoder(default_tokenizer())
    # slices with and without an added token's string, one text at a time and all at once
    for some in ([t for t in texts if "<|" not in t], texts, *[[t] for t in texts]):
        data, offsets = utf8(pa.array(some, pa.string()))
        for _ in range(2):
            ids, bounds = enc.encode(data, offsets)
            for i, t in enumerate(some):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_encoder_on_every_white_space(tokenizer):
    """All white space of the pattern and its neighbours, single, doubled, and mixed with spaces, between words and at the ends."""
    enc = Encoder(default_tokenizer())
    around = [chr(c) for c in (*range(0x08, 0x10), *range(0x1B, 0x22), 0x84, 0x85, 0x86, 0x9F, 0xA0, 0xA1, 0x167F, 0x1680, 0x1681, *range(0x1FFF, 0x200D), *range(0x2027, 0x2030), 0x205E, 0x205F, 0x2060, 0x2FFF, 0x3000, 0x3001)]
    texts = [f"{a}ab{a}cd{a}{a}ef {a}g{a} h{a}" for a in around] + [a + b + "x" + b + a for a in around for b in around]
    data, offsets = utf8(pa.array(texts, pa.string()))
    ids, bounds = enc.encode(data, offsets)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_on_whole_documents(spark, tokenizer):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    enc = Encoder(default_tokenizer())
    assert enc.plain
    data, offsets = utf8(pa.array(texts, pa.string()))
    ids, bounds = enc.encode(data, offsets)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def naive_bins(pieces, capacity):
    """Best-two-fit piece by piece: greedy with the largest that fits, then the smallest gives way to the two that fill most."""
    left, bins = sorted(pieces, reverse=True), []
    while left:
        mine, rest = [], []
        for k in left:
            if sum(mine) + k <= capacity:
                mine.append(k)
            else:
                rest.append(k)
        gap = capacity - sum(mine)
        if gap and mine:
            best, pair = mine[-1], None
            for i in range(len(rest)):
                for j in range(i):
                    if best < rest[i] + rest[j] <= gap + mine[-1]:
                        best, pair = rest[i] + rest[j], (i, j)
            if pair:
                small, i, j = mine.pop(), *pair
                mine += [rest[i], rest[j]]
                rest = sorted([x for p, x in enumerate(rest) if p not in pair] + [small], reverse=True)
        bins.append(sorted(mine, reverse=True))
        left = rest
    return bins


def test_plan_against_naive_best_two_fit():
    """As full as piece by piece, bin for bin; pairs that fill the same may be others, so that later bins can differ by one."""
    rnd = random.Random(8)
    for _ in range(40):
        pieces = [rnd.randint(1, 60) for _ in range(rnd.randint(1, 60))]
        planned, naive = plan_bins(dict(Counter(pieces)), 60), naive_bins(pieces, 60)
        assert sum(k * n for k, n in planned[0][1]) == sum(naive[0])
        assert abs(sum(times for times, _ in planned) - len(naive)) <= 1
        assert sum(times for times, _ in planned) >= -(-sum(pieces) // 60)


def test_plan_holds_every_piece_once():
    rnd = random.Random(5)
    for _ in range(50):
        counts = Counter(rnd.randint(1, 100) for _ in range(rnd.randint(0, 400)))
        seen = Counter()
        for times, items in plan_bins(dict(counts), 100):
            assert sum(k * n for k, n in items) <= 100
            for k, n in items:
                seen[k] += n * times
        assert seen == counts


def test_plan_swaps_one_for_two():
    assert plan_bins({60: 1, 30: 1, 22: 1, 18: 1}, 100) == [(1, [(60, 1), (22, 1), (18, 1)]), (1, [(30, 1)])]


def test_pieces_and_places(docs, tokenizer):
    long = " ".join(f"word{i % 37}" for i in range(5000))
    rows = [*enumerate(TEXTS), (50, long), (51, long), (51, long), (None, "null id")]
    out = best_fit_packing(docs(rows), default_tokenizer()).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        pieces = pieces[::2] if doc == 51 else pieces
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces[:-1]]]).tolist()
        assert sum(r.length for r in pieces) == len(ids)
        assert all(r.length == 2048 for r in pieces[1:])
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_empty(docs):
    assert best_fit_packing(docs([]), default_tokenizer()).count() == 0
