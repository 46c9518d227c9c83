import random
import zlib

from larkspur.llm.quality_classifier import fit, quality_scores

WORDS = ["the", "river", "house", "green", "walks", "under", "little", "stone", "bright", "and", "of", "was"]


def corpus(n=240):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        w = [rnd.choice(WORDS) for _ in range(rnd.randint(20, 80))]
        rows.append((i, " ".join(w) if good else rnd.choice([" ".join(x.upper() + "!!" for x in w), " ".join(x + "$$$" for x in w), " ".join([w[0]] * len(w))])))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_columns(docs, spark):
    rows, labels = corpus()
    extra = [(1000, None), (1001, ""), (None, "the river"), (3, rows[3][1]), (1002, rows[5][1] + " " + "the river of stone " * 2000)]
    out = quality_scores(docs(rows + extra), spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) + len(extra)
    truth = {i: y for i, y, _ in labels}
    held = [r for r in out if r.doc_id in truth and r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    scores = {r.doc_id: r.score for r in out}
    assert scores[1000] == scores[1001] and len({r.score for r in out if r.doc_id == 3}) == 1


def test_held_out_labels_do_not_matter(docs, spark):
    rows, labels = corpus(120)
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y, t) for i, y, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (sorted((r.doc_id, r.score) for r in quality_scores(docs(rows), spark.createDataFrame(x, schema)).collect()) for x in (labels, flip))
    assert a == b


def test_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality_scores(docs([(1, "x"), (2, None)]), none).collect()] == [0.5, 0.5]
    assert quality_scores(docs([]), none).count() == 0


def test_repeated_rows_do_not_push_a_class_out(docs, spark):
    """A doc_id that holds most rows counts once, so both classes are learned from; with other texts under it, the same fit on any order."""
    rows, labels = corpus(60)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    hot = next(i for i, y, _ in labels if y == 0 and zlib.crc32(str(i).encode()) % 3 != 1)
    plain, none = fit(docs(rows), labelled, 20)
    assert plain.any()
    for per_class in (20, 60):
        want = fit(docs(rows), labelled, per_class)
        got = fit(docs(rows + [rows[hot]] * 300).repartition(5), labelled, per_class)
        assert (got[0] == want[0]).all() and got[1] == want[1]
    more = rows + [(hot, f"other text {i}") for i in range(300)]
    a, b = fit(docs(more), labelled, 20), fit(docs(more[::-1]).repartition(3), labelled, 20)
    assert a[0].any() and (a[0] == b[0]).all() and a[1] == b[1]
