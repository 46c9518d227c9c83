import random
import re

import pytest

import corpus_pipeline
from larkspur.llm.decontaminate import budget, compared
from larkspur.llm.packing import default_tokenizer
from larkspur.llm.quality_rules import RULES, STOP_WORDS
from tests.llm.test_line_dedup import brute as brute_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    w = WORD.findall(text or "")
    ls = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    m = {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_lines": len(ls),
        "n_dup_lines": len(ls) - len(set(ls)),
        "n_stop": sum(x.lower() in STOP_WORDS for x in w),
        "n_ellipsis": sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in ls),
    }
    if len(w) < 50 or 100 * len(covered) > 50 * len(w):
        return False
    side = lambda s: sum(f * m[k] for k, f in s.items())
    return all(side(a) >= side(b) if op == ">=" else side(a) <= side(b) for _, a, op, b in RULES)


def brute_near(rows):
    def shingles(t):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rows = sorted(rows)
    sets, kept, group = [shingles(t) for _, t in rows], [], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and 100 * inter >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    for i, r in enumerate(rows):
        if group[i] == i:
            kept.append(r)
    return kept


def distance_to_part(p, t):
    """Least edit distance of p to any part of t, by the whole table."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@pytest.fixture()
def tables(spark, tmp_path):
    rnd = random.Random(4)
    vocab = [f"{rnd.choice('bcdfglmnprst')}{rnd.choice('aeiou')}{rnd.choice('bcdfglmnprst')}{rnd.choice('aeiou')}{i % 7}" for i in range(400)] + ["the", "of", "and", "is"] * 30
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(18)) for i in range(5)] + [(9, None), (10, "tiny")]
    shared = [say(12) for _ in range(4)]
    rows = []
    for i in range(60):
        text = "\n".join([say(rnd.randint(20, 50)) for _ in range(3)] + ([rnd.choice(shared)] if rnd.random() < 0.5 else []))
        rows.append((i, text))
    for i in range(60, 80):  # near copies, leaks, junk
        _, text = rows[rnd.randint(0, 59)]
        w = text.split(" ")
        w[len(w) // 2] = "changed"
        rows.append((i, " ".join(w)))
    for i in range(80, 86):
        passage = items[i % 5][1]
        if i % 2:
            passage = passage.upper()[:-1] + "x"
        rows.append((i, say(40) + " " + passage + "\n" + say(40)))
    rows += [(90, "spam spam " * 60), (91, None), (92, ""), (93, "too short"), (94, "*** $$$ ### the " * 30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, kept string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "k") for i, t in rows], schema)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, items


def test_run_against_brute_force(spark, tables):
    sf_dir, rows, items = tables
    docs, left = spark.read.parquet(f"{sf_dir}/documents.parquet"), rows
    columns = docs.columns

    def check(stage, want):
        nonlocal docs
        docs = corpus_pipeline.STAGES[stage][1](spark, docs, sf_dir)
        assert docs.columns == columns
        docs = docs.cache()
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want)
        return want

    left = check(0, [r for r in left if brute_quality(r[1])])
    assert 60 < len(left) < 90
    left = check(1, brute_lines(left))
    left = check(2, brute_near(left))
    sought = [compared(t) for _, t in items if compared(t)]
    left = check(3, [r for r in left if not any(distance_to_part(p, compared(r[1])) <= budget(len(p)) for p in sought)])
    assert not {i for i, _ in left} & set(range(80, 86))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    out = corpus_pipeline.run(spark, sf_dir).collect()
    lengths = {}
    for r in out:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in left}
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
