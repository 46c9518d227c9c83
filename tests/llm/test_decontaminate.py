import random

from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm.decontaminate import budget, compared, leaks, myers, pieces, without_leaks
from tests.llm.test_pipeline import distance_to_part


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abcd", max_size=30))
def test_myers(p, t):
    d, end = myers(p, t)
    assert d == distance_to_part(p, t) and (d == len(p) or distance_to_part(p, t[:end]) == d)


def test_long_patterns():
    rnd = random.Random(1)
    p = "".join(rnd.choice("abcd ") for _ in range(300))
    t = "".join(rnd.choice("abcd ") for _ in range(80)) + p[:100] + "x" + p[103:] + "tail"
    assert myers(p, t)[0] == distance_to_part(p, t)


def test_pieces_and_budget():
    assert [p for _, p in pieces("abcdefgh", 2)] == ["ab", "cde", "fgh"]
    assert budget(100, 0.05) == 5
    assert compared(" The  CAT,\n(sat) é!! -- x-y ") == "the cat sat é x-y"


def test_leaks_against_full_distance(docs, spark):
    rnd = random.Random(2)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(n))
    items = [(i, say(20)) for i in range(4)] + [(7, None), (8, "tiny"), (0, "again " + say(15))]
    rows = [(i, say(60)) for i in range(10)]
    for i in range(10, 26):
        p = list(rnd.choice(items[:4])[1])
        for _ in range(rnd.randint(0, 8)):
            p[rnd.randrange(len(p))] = rnd.choice(["z", "", "qq"])
        text = "".join(p)
        rows.append((i, f"{say(10)} {text.upper() if i % 2 else text}!! {say(10)}"))
    rows += [(30, None), (31, ""), (None, say(5) + " " + items[0][1]), (10, rows[10][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc, t in rows:
        for item, p in items:
            p = compared(p)
            if p:
                d = distance_to_part(p, compared(t))
                if d <= budget(len(p)):
                    want.append((doc, item, d))
    got = [(r.doc_id, r.item_id, r.distance) for r in leaks(docs(rows), bench).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and want
    kept = without_leaks(docs(rows), bench)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in rows if i not in {d for d, *_ in want}), key=repr)
    assert leaks(docs([]), bench).count() == 0 and leaks(docs(rows), bench.limit(0)).count() == 0 and without_leaks(docs(rows), bench.limit(0)).count() == len(rows)


def test_short_passages(docs, spark):
    """Passages without an error to spare are found as they are, at words' borders; whole sentences without blanks anywhere."""
    bench = spark.createDataFrame([(1, "Short leak here"), (2, "漢字の短い文です"), (3, ""), (4, None), (5, "ok")], "item_id long, text string")
    rows = [(1, "so a short  LEAK here!"), (2, "a short leak hereby"), (3, "前漢字の短い文です後"), (4, "short leak"), (5, "look"), (6, "is it OK?"), (7, None), (8, "x " * 100_000 + "short leak here")]
    got = sorted((r.doc_id, r.item_id, r.distance) for r in leaks(docs(rows), bench).collect())
    assert got == [(1, 1, 0), (3, 2, 0), (6, 5, 0), (8, 1, 0)]
    assert sorted(r.doc_id for r in without_leaks(docs(rows), bench).collect()) == [2, 4, 5, 7]
