import hashlib
import random
import re

import pyarrow as pa

from larkspur.llm.recompression import Symbols, Windows
from larkspur.llm.substring_dedup import GRAM, WINDOW, anchors, substring_dedup
from larkspur.llm.text_hash import Words, utf8


def brute(rows, window=WINDOW):
    """One pass over all windows, by their words."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    key = lambda i: float("inf") if i is None else i
    first: dict = {}
    for (doc, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            first[g] = min(first.get(g, key(doc)), key(doc))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone, seen = set(), set()
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            if first[g] < key(doc) or g in seen:
                gone |= set(range(s, s + window))
            seen.add(g)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def rows_for(seed):
    rnd = random.Random(seed)
    vocab = ["a", "b", "ü", "dd"] if seed % 2 else [f"w{i}" for i in range(500)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    shared = [say(rnd.choice([19, 20, 21, 22, 45])) for _ in range(12)] + [["x"] * 50, ["x", "y"] * 30]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            parts += rnd.choice([say(rnd.randint(0, 30)), rnd.choice(shared)])
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(parts)))
    return rows


def test_against_brute_force(docs):
    for seed in range(4):
        rows = [*rows_for(seed), (100, None), (101, ""), (102, " \n"), (None, "x " * 60), (None, "q " * 25), (7, "z " * 30), (7, "z " * 30)]
        got = sorted((tuple(r) for r in substring_dedup(docs(rows)).collect()), key=repr)
        assert got == sorted(brute(rows), key=repr)


def test_empty(docs):
    assert substring_dedup(docs([])).count() == 0


def test_copies_share_an_anchor():
    """Whatever stands around two copies of a window, they have a shared symbol at the same place."""
    rnd = random.Random(1)
    for _ in range(300):
        vocab = [f"v{i}" for i in range(rnd.choice([1, 2, 3, 200]))]
        say = lambda n: [rnd.choice(vocab) for _ in range(n)]
        window, found = say(WINDOW), []
        for _ in range(2):
            left, right = say(rnd.randint(0, 9)), say(rnd.randint(0, 9))
            at, keys = anchors(Words(*utf8(pa.array([" ".join(left + window + right)]))))
            at = at - len(left)
            inside = (at >= 0) & (at + GRAM <= WINDOW)
            found.append(set(zip(at[inside].tolist(), keys[inside].tolist(), strict=True)))
        assert found[0] & found[1]


def test_long_text(docs):
    text = " ".join(f"w{i % 9973}" for i in range(200_000))
    row = substring_dedup(docs([(1, text)])).first()
    assert row.n_words == 200_000
    assert row.n_removed == 200_000 - 9973


def _words(*texts):
    return Words(*utf8(pa.array(list(texts))))


def test_symbols_stand_for_their_words():
    """Equal names, equal words; copies of a passage share symbols, which reach to near its ends."""
    rnd = random.Random(2)
    for vocab in (2, 5, 300):
        say = lambda n: [f"v{rnd.randrange(vocab)}" for _ in range(n)]  # noqa: B023, E731
        passage = say(400)
        texts = [say(rnd.randint(0, 50)) + passage + say(rnd.randint(0, 50)) for _ in range(4)] + [["r"] * 90]
        words = _words(*(" ".join(t) for t in texts))
        s = Symbols(words, 1)
        meant: dict = {}
        for name, at, size, text in zip(s.name.tolist(), s.at.tolist(), s.size.tolist(), s.text.tolist(), strict=True):
            lo = at - int(words.bounds[text])
            assert meant.setdefault(name, texts[text][lo : lo + size]) == texts[text][lo : lo + size]
        names = [set(s.name[s.text == i].tolist()) for i in range(4)]
        common = set.intersection(*names)
        assert max(len(meant[n]) for n in common) >= 40


def test_copies_are_settled_by_their_symbols():
    rnd = random.Random(3)
    passage = [f"w{rnd.randrange(5000)}" for _ in range(3000)]
    first, second = _words(" ".join(passage)), _words("other " * 3 + " ".join(passage) + " end")
    names, _ = Windows(first, WINDOW, [None]).open_names()
    known = names.astype("<u8").tobytes()
    windows = Windows(second, WINDOW, [known])
    assert windows.live.sum() < 0.4 * len(passage)
    assert windows.known_words().sum() > 0.8 * len(passage)
    assert Windows(_words("", ""), WINDOW, [None, known]).live.sum() == 0
