from tests.llm.test_pipeline import brute_quality

from larkspur.llm.quality_rules import RULES, keep_good, quality_rules


def texts():
    good = "The cat of the house is on the mat and it was there for a day with all of us. " * 1 + " ".join(f"word{i} the of thing{i}" for i in range(40))
    return [
        None, "", " \n\t", "short", good, good + "\n" + good, "a b c " * 40, ("x " * 49).strip(), " ".join(f"w{i}" for i in range(50)), good + " $$$ ### ***" * 40,
        "\n".join([good] + ["same line here"] * 20), "\n".join(f"line {i} of the text..." for i in range(30)), "é " * 60, " ".join(["extraordinarily-long-compounded"] * 2 + [f"superlongword{i}superlongword the" for i in range(40)]),
        "one two three one two three four " + " ".join(f"q{i} of" for i in range(60)), "\x0bvt\x0cff the of and\x1cx " * 3,
    ]


def test_against_plain_python(docs):
    rows = [*enumerate(texts()), (None, texts()[4]), (4, texts()[4])]
    got = sorted(((r.doc_id, r.kept) for r in quality_rules(docs(rows)).collect()), key=repr)
    assert got == sorted(((i, brute_quality(t)) for i, t in rows), key=repr)
    assert any(k for _, k in got) and not all(k for _, k in got)


def test_repeat_words_are_counted_once(docs):
    r = quality_rules(docs([(1, "a b c a b c a b x y z")])).first()
    assert (r.n_words, r.word_chars, r.n_repeat_words) == (11, 11, 8)
    r = quality_rules(docs([(1, "l one\n\nl one\n l one\nl one#|")])).first()
    assert (r.n_lines, r.n_dup_lines, r.n_symbols) == (4, 1, 2)


def test_keep_good_keeps_columns_and_rows(docs):
    rows = [*enumerate(texts()), (4, texts()[4])]
    df = docs(rows)
    got = keep_good(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, t in rows if brute_quality(t))
    assert keep_good(docs([])).count() == 0 and quality_rules(docs([])).count() == 0


def test_rules_are_a_table():
    assert all(len(r) == 4 and r[2] in ("<=", ">=") for r in RULES)


def test_plan_is_native(docs):
    plan = quality_rules(docs([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
