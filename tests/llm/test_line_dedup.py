import random

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm.line_dedup import SHINGLE, Lines, band_keys, line_components, line_dedup

BLANKS = " \t\v\f\r"


def form(line: str) -> str:
    for b in BLANKS:
        line = line.replace(b, " ")
    return " ".join("".join(c.lower() if c.isascii() else c for c in line).split(" ")).strip() if "  " not in line else form(line.replace("  ", " "))


def shingle_set(f: str) -> set:
    return {f[i : i + SHINGLE] for i in range(max(1, len(f) - SHINGLE + 1))}


def brute(rows, num=80, den=100):
    """All pairs of distinct forms, then a walk through the documents by id."""
    forms = list({form(x) for _, t in rows for x in (t or "").split("\n") if form(x)})
    sets = [shingle_set(f) for f in forms]
    label = list(range(len(forms)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(forms)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if den * inter >= num * (len(sets[i]) + len(sets[j]) - inter):
                label[root(i)] = root(j)
    of = {f: root(i) for i, f in enumerate(forms)}
    key = lambda r: (1e18, 0) if r[0] is None else (r[0], 0)
    first = {}
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if form(x):
                c = of[form(x)]
                first[c] = min(first.get(c, key(r)), key(r))
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None))
            continue
        seen, kept = set(), []
        for x in r[1].split("\n"):
            c = of.get(form(x))
            if c is None:
                kept.append(x)
            elif first[c] == key(r) and c not in seen:
                kept.append(x)
            seen.add(c)
        out.append((r[0], "\n".join(kept)))
    return out


def make_rows(seed, n=80):
    rnd = random.Random(seed)
    base = [" ".join(f"{rnd.choice('abcdefghéß漢字')}word{rnd.randint(0, 999)}" for _ in range(rnd.randint(1, 14))) for _ in range(25)]

    def line():
        x = rnd.choice(base)
        kind = rnd.random()
        if kind < 0.4:
            return x
        if kind < 0.6:
            return x.upper() + "  "
        at = rnd.randint(0, len(x))
        return x[:at] + rnd.choice(["é", "x", " extra", "", "漢"]) + x[at + rnd.randint(0, 6) :]

    return [(i, "\n".join(rnd.choice([line(), line(), "", " "]) for _ in range(rnd.randint(0, 6)))) for i in range(n)]


def test_against_brute_force(docs):
    for seed in range(2):
        rows = [*make_rows(seed), (200, None), (201, ""), (202, "\n\n"), (None, "alone\nalone"), (5, "same id"), (5, "same id")]
        got = line_dedup(docs(rows)).collect()
        assert {"doc_id", "text", "lang", "score", "key", "kept"} <= set(got[0].asDict())
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(brute(rows), key=repr)


def test_counts_and_empty(docs):
    out = line_dedup(docs([(1, "a line here\na line here\nother"), (2, "other")]).select("doc_id", "text"), counts=True)
    assert sorted(map(tuple, out.collect())) == [(1, "a line here\nother", 3, 1), (2, "", 1, 1)]
    assert line_dedup(docs([])).count() == 0


def test_large_group_of_near_copies(docs):
    stem = " ".join(f"part{i}" for i in range(60))
    rows = [(i, f"{stem} number {i}") for i in range(300)]
    out = line_dedup(docs(rows)).collect()
    assert [r.doc_id for r in out if r.text] == [0]


def test_bands_recall():
    """Pairs at the threshold are found as often as the formula says."""
    rnd = random.Random(9)
    hit = total = 0
    for _ in range(400):
        x = "".join(rnd.choice("abcdefghijklmnopé ") for _ in range(300)).strip().replace("  ", " q")
        at = rnd.randint(30, 200)
        y = x[:at] + "#" * 20 + x[at + 20 :]
        a, b = shingle_set(x), shingle_set(y)
        if len(a & b) / len(a | b) < 0.8:
            continue
        keys = band_keys(Lines([x.encode(), y.encode()]), np.arange(2))
        total += 1
        hit += bool(np.any(keys[0] == keys[1]))
    assert total > 100 and hit / total > 0.98


def test_near_copy_recall_against_all_pairs(spark):
    """Of all pairs of lines with a Jaccard index of 0.8 or more in the whole table, at least 0.9 end in one component; all of them are linked truly."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    forms = sorted({form(x) for r in docs.collect() for x in (r.text or "").split("\n") if form(x)})
    lines = Lines(["\n".join(forms).encode()])
    of = dict(zip(lines.names().tolist(), forms, strict=True))
    component = {of[r.id]: r.component for r in line_components(docs).collect()}
    sets = [shingle_set(f) for f in forms]
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    shared = {}
    for ids in by.values():
        for p, i in enumerate(ids):
            for j in ids[:p]:
                shared[i, j] = shared.get((i, j), 0) + 1
    linked = [(i, j) for (i, j), n in shared.items() if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n)]
    found = sum(component.get(forms[i], i) == component.get(forms[j], j) for i, j in linked)
    assert len(linked) > 5 and found >= 0.9 * len(linked)
    partners = {forms[x] for pair in linked for x in pair}
    assert set(component) <= partners


def test_names_differ():
    forms = [f"{a} {b}" for a in range(300) for b in range(300)] + ["a", "b", "ab", "ba", "aaaa", "aaaaa", "aaaaaa", "é", "漢字"]
    assert len(np.unique(Lines(["\n".join(forms).encode()]).names())) == len(forms)


def test_least_edits_that_link(docs):
    """Copies with one changed character, of one byte or more, and with one replaced word of six letters, as the docstring states."""
    rnd = random.Random(3)
    cases = [(n, at, put, ok) for put in "#é漢" for n, at, ok in ((49, 24, True), (48, 24, False), (13, 12, True), (12, 11, False))]
    cases += [(94, 40, "#$%&*+", True), (93, 40, "#$%&*+", False), (94, 40, "äöüßéè", True), (93, 40, "äöüßéè", False)]
    rows = []
    for i, (size, at, put, _) in enumerate(cases):
        line = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
        rows += [(2 * i, line), (2 * i + 1, line[:at] + put + line[at + len(put) :])]
    left = {r.doc_id: r.text for r in line_dedup(docs(rows)).collect()}
    assert all(left[2 * i] == rows[2 * i][1] for i in range(len(cases)))
    assert [left[2 * i + 1] == "" for i in range(len(cases))] == [x[3] for x in cases]


def test_clashing_columns_null_ids_and_long_texts(docs):
    line = "the very same line of words that stands in each of the documents"
    rows = [(7, line), *[(None, f"{line}\nown {i} {'xyz' * i}") for i in range(5)], (8, "\n".join([line] * 20000)), (9, "z" * 300_000), (10, "z" * 300_000 + "\nshort")]
    names = ["_key", "_lines", "row", "late", "k", "lines", "id", "component", "least", "_parts", "_salt", "n", "first"]
    table = docs(rows).select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    out = line_dedup(table)
    assert out.columns == table.columns
    got = out.collect()
    assert all([r[c] for c in names] == list(range(len(names))) for r in got)
    texts = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in got))
    assert texts[:4] == [(False, 7, line), (False, 8, ""), (False, 9, "z" * 300_000), (False, 10, "short")]
    assert [t for _, _, t in texts[4:]] == [f"own {i} {'xyz' * i}" for i in range(5)]


def test_bands_are_packed_for_some_texts_at_once(monkeypatch):
    """However long a batch is, its keys are not gathered whole; equal lines of two parts meet by their keys."""
    import pyarrow as pa

    from larkspur.llm import line_dedup as L

    monkeypatch.setattr(L, "_TEXTS", 100, raising=False)
    batch = pa.record_batch([pa.array([f"line number {i} of many\nthe same line in all" for i in range(250)])], names=["text"])
    out = list(L._send_bands(4)([batch]))
    assert len(out) == 3 and sum(sum(o.column("n").to_pylist()) for o in out) == L.BANDS * (250 + 3)


def test_band_keys_are_mixed_for_all_bands_at_once(monkeypatch):
    """Keys do not depend on which other lines are asked for, and the bands of many lines cost three calls, not one a value."""
    from larkspur.llm import line_dedup as L

    lines = Lines([("\n".join(f"line {i} with {'word ' * (i % 9)}and {i * 7919}" for i in range(40)) + "\nab\né").encode(), b"", b"x\n\ny"])
    calls, mix = [], L.mix
    monkeypatch.setattr(L, "mix", lambda x: calls.append(1) or mix(x))
    every = band_keys(lines, np.arange(len(lines.full)))
    assert len(calls) <= 3
    for some in ([3], [], list(range(1, len(lines.full))), list(range(0, len(lines.full), 3))):
        assert np.array_equal(band_keys(lines, np.array(some, int)), every[some])
    assert all(len(np.unique(every[:, b])) > 20 for b in range(L.BANDS))


def test_texts_that_lose_nothing_are_not_parsed_again(monkeypatch):
    """A document whose lines are all first, each of another component, keeps its text without being cut into lines' forms."""
    import pyarrow as pa

    from larkspur.llm import line_dedup as L

    names = L.Lines([b"one line\nanother line"]).names().tolist()
    monkeypatch.setattr(L, "_slices", lambda texts: iter(()) if not texts else (_ for _ in ()).throw(AssertionError("parsed")))
    row = pa.StructArray.from_arrays([pa.array([1]), pa.array(["one line\nanother line\n \n"])], names=["doc_id", "text"])
    same = pa.array([[{"id": x, "component": i} for i, x in enumerate(names)]], pa.list_(pa.struct([("id", pa.int64()), ("component", pa.int64())])))
    batch = pa.record_batch([row, pa.array([[]], pa.list_(pa.int64())), same, pa.array([False])], names=["row", "gone", "same", "again"])
    (out,) = L._cut(["doc_id", "text"], True)([batch])
    assert out.to_pylist() == [{"doc_id": 1, "text": "one line\nanother line\n \n", "n_lines": 2, "n_removed": 0}]


def test_lines_and_cut_texts_are_sent_for_some_texts_at_once(monkeypatch):
    """A long batch goes out in parts, with a form once in all of them."""
    import pyarrow as pa

    from larkspur.llm import line_dedup as L

    class All:
        value = np.full(1024, 2**64 - 1, np.uint64)

    monkeypatch.setattr(L, "_TEXTS", 100)
    texts = pa.array([f"line number {i} of many\nthe same line in all" for i in range(250)])
    n = pa.array(range(250))
    out = list(L._lines_of(All)([pa.record_batch([pa.array([False] * 250), n, texts], names=["late", "k", "text"])]))
    assert [o.num_rows for o in out] == [200, 200, 100]
    assert [k for o in out for k in sorted(set(o.column("k").to_pylist()))] == list(range(250))
    forms = [f for o in out for f in o.column("form").to_pylist() if f]
    assert len(forms) == 251 == len(set(forms))
    none = pa.nulls(250)
    rows = pa.record_batch([pa.StructArray.from_arrays([n, texts], names=["doc_id", "text"]), none, none, none], names=["row", "gone", "same", "again"])
    out = list(L._cut(["doc_id", "text"], True)([rows]))
    assert [o.num_rows for o in out] == [100, 100, 50] and [x for o in out for x in o.column("text").to_pylist()] == texts.to_pylist()
