"""The compressor against plain Python."""

import math
import random
import re

import pytest

from larkspur.operators import compress as C
from larkspur.operators.compress import CHUNK_END_TOKENS, FORCE_TOKENS, compress


def brute(rows, rate, budget, force=FORCE_TOKENS, drop=True, given=None):
    words = {k: re.findall(r"[^\W_]+|\n|[^\s]", t or "") for k, t in rows}
    terms = {k: [w.lower() for w in v] for k, v in words.items()}
    n = sum(1 for v in terms.values() if v)
    df = {t: sum(t in v for v in terms.values()) for v in terms.values() for t in v}
    weight = {t: round(math.log(1 + (n - d + 0.5) / (d + 0.5)), 9) for t, d in df.items()} if given is None else given
    out = {}
    for k, w in words.items():
        starts, end = [0], -1
        for i, x in enumerate(w):
            if i - starts[-1] >= budget:
                starts.append(end + 1 if end >= starts[-1] else i)
            end = i if x in CHUNK_END_TOKENS else end
        labels = []
        for a, b in zip(starts, [*starts[1:], len(w)], strict=True):
            s = sorted(weight.get(t, 0.0) for t in terms[k][a:b])
            labels += [(x, x in force or weight.get(t, 0.0) >= s[math.floor(len(s) * (1 - rate) + 1e-9)]) for x, t in zip(w[a:b], terms[k][a:b], strict=True)]
        kept = [x for x, y in labels if y]
        if drop:
            kept = [x for i, x in enumerate(kept) if not (i and x in force and x == kept[i - 1])]
        out[k] = (len(w), len(starts) if w else 0, len(kept), " ".join(kept), labels)
    return out


def texts(seed):
    rnd = random.Random(seed)
    vocab = ["the", "The", "tea", "Ünder", "x2", "of", "rare%d", "、", "!", ".", ",", "\n", "?", "..", "—"]
    rows = [(i, " ".join(rnd.choice(vocab).replace("%d", str(rnd.randrange(30))) for _ in range(rnd.randint(0, 90)))) for i in range(25)]
    return [*rows, (100, None), (101, " \t"), (102, "one"), (103, "no end here " * 20), (104, "." * 30)]


@pytest.mark.parametrize(("rate", "budget", "options"), [(0.5, 20, {}), (0.8, 512, {}), (1.0, 7, {"drop_consecutive": False}), (0.3, 1, {"force": ("!",)})])
def test_against_plain_python(spark, rate, budget, options):
    rows = texts(int(rate * 10))
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    got = {r.id: (r.n_tokens, r.n_chunks, r.n_kept, r.compressed, [tuple(x) for x in r.labels]) for r in compress(df, "id", "text", rate, budget=budget, **options).collect()}
    assert got == brute(rows, rate, budget, options.get("force", FORCE_TOKENS), options.get("drop_consecutive", True))


def test_given_weights_cjk_and_bounds(spark):
    df = spark.createDataFrame([("a", "订 tea 好吧 tea.")], "id string, text string")
    given = spark.createDataFrame([("tea", 2.0), ("好", 1.0)], "term string, weight double")
    r = compress(df, "id", "text", 0.5, given=given).first()
    assert (r.n_tokens, r.compressed) == (6, "tea 好 tea .")
    with pytest.raises(ValueError):
        compress(df, "id", "text", 0)
    with pytest.raises(ValueError):
        compress(df, "id", "text", budget=0)
    assert compress(df.limit(0), "id", "text").count() == 0


def test_terms_too_many_to_broadcast(spark, monkeypatch):
    """Weights are joined by term; the tokens of a long text of many chunks stay in one row."""
    monkeypatch.setattr(C, "BROADCAST_TERMS", 0)
    rows = [*texts(5), (200, " ".join(f"w{i % 997} the" for i in range(5000)))]
    got = {r.id: (r.n_tokens, r.n_chunks, r.n_kept, r.compressed) for r in compress(spark.createDataFrame(rows, "id int, text string"), "id", "text", 0.5, budget=5, labels=False).collect()}
    assert got == {k: v[:4] for k, v in brute(rows, 0.5, 5).items()}


def exchanged(spark, run):
    """What run() returns, and the bytes that its stages wrote for exchanges."""
    sc, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()
    sc.setJobGroup("exchanged", "", False)
    got = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("exchanged") for s in sc.statusTracker().getJobInfo(j).stageIds}
    sc.setLocalProperty("spark.jobGroup.id", None)
    return got, sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def test_words_that_cannot_change_a_chunk_are_not_exchanged(spark, monkeypatch):
    """Half of a chunk's words are frequent and broadcast; its rare ones stay whatever they weigh, and only a text with a chunk of rare words asks for theirs."""
    monkeypatch.setattr(C, "BROADCAST_TERMS", 40)
    rnd = random.Random(1)
    rows = [(i, " ".join(f"f{rnd.randrange(20)} f{rnd.randrange(20)} r{i}x{j}" if j % 2 else f"f{j % 20}" for j in range(100))) for i in range(60)]
    rows += [(500 + i, " ".join(f"{'RARE'[: rnd.randint(1, 4)]}{rnd.randrange(60)}" for _ in range(30))) for i in range(4)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(2).cache()
    assert df.count() == len(rows)
    got, sent = exchanged(spark, lambda: {r.id: (r.n_tokens, r.n_chunks, r.n_kept, r.compressed) for r in compress(df, "id", "text", 0.5, budget=50, labels=False).collect()})
    df.unpersist()
    assert got == {k: v[:4] for k, v in brute(rows, 0.5, 50).items()}
    size = sum(len(t) for _, t in rows)
    assert sent < size, (sent, size)


@pytest.mark.parametrize("terms", [0, 7, 200_000])
@pytest.mark.parametrize(("rate", "budget"), [(0.5, 3), (0.9, 20)])
def test_labels_and_repeated_keys_whatever_is_broadcast(spark, monkeypatch, terms, rate, budget):
    monkeypatch.setattr(C, "BROADCAST_TERMS", terms)
    monkeypatch.setattr(C, "BYTES_AT_ONCE", 50)
    rows = texts(9)
    more = [(3, rows[3][1]), (101, None), (7, None), (None, "no key . no key"), (None, None)]
    df = spark.createDataFrame([*rows, *more], "id int, text string").repartition(3)
    got = {r.id: (r.n_tokens, r.n_chunks, r.n_kept, r.compressed, [tuple(x) for x in r.labels]) for r in compress(df, "id", "text", rate, budget=budget).collect()}
    assert got == brute([*rows, more[3]], rate, budget)
