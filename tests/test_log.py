"""Tables changed by deltas: folding, compaction, and writers that race."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larkspur.operators import log
from larkspur.operators.log import Conflict, Delta, Store

DDL = "id string, owner string, text string, hits int, at string, tags array<string>, refs map<string, array<int>>"


def rows_of(spark, rows, ddl=DDL):
    return spark.createDataFrame(rows, ddl)


def full(i, owner="o", text="t", hits=0, at=None):
    return (i, owner, text, hits, at, ["x"], {"k": [1]})


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/store", buckets=4)
    s.ensure(things=(DDL, "id", ("owner",)))
    return s


def content(store, *cols):
    return sorted(tuple(r[c] for c in cols) for r in store.read("things").collect())


def test_each_kind_of_delta(spark, store):
    assert content(store, "id") == []
    store.append(Delta("things", "upsert", rows_of(spark, [full("a"), full("b", hits=5), full("c"), (None, "o", "no key", 0, None, None, None)])))
    store.append(Delta("things", "upsert", rows_of(spark, [full("a", owner="other", text="new", hits=2)])))
    bump = spark.createDataFrame([("a", 1, "t1"), ("a", 2, "t3"), ("b", 1, "t0"), ("nobody", 9, "t")], "id string, hits int, at string")
    store.append(Delta("things", "bump", bump), Delta("things", "delete", spark.createDataFrame([("c",), ("nobody",)], "id string")))
    store.append(Delta("things", "patch", spark.createDataFrame([("b", "patched", None), ("c", "gone", None)], "id string, text string, at string")))
    want = [("a", "o", "new", 5, "t3"), ("b", "o", "patched", 6, "t0")]
    assert content(store, "id", "owner", "text", "hits", "at") == want
    assert [(r.tags, r.refs) for r in store.read("things").collect()] == [(["x"], {"k": [1]})] * 2
    store.compact("things")
    assert content(store, "id", "owner", "text", "hits", "at") == want and not store._state()["tables"]["things"]["deltas"]
    store.append(Delta("things", "upsert", rows_of(spark, [full("c", owner="new owner")])))
    assert content(store, "id", "owner")[-1] == ("c", "new owner")  # what was deleted keeps nothing
    with pytest.raises(ValueError):
        store.append(Delta("things", "merge", bump))
    with pytest.raises(ValueError):
        store.append(Delta("things", "upsert", bump))


def test_first_upsert_is_read_as_it_is(spark, store):
    """Nothing is exchanged to fold one delta onto no base; an empty delta changes nothing, and a second one is folded."""
    planned = lambda: store.read("things")._jdf.queryExecution().executedPlan().toString()
    rows = [full("a"), full("b", owner=None, text=None), (None, "o", "no key", 0, None, None, None)]
    store.append(Delta("things", "upsert", rows_of(spark, [*rows, rows[0]]).select("refs", "tags", "at", "hits", "text", "owner", "id")))
    store.append(Delta("things", "upsert", rows_of(spark, [])), Delta("things", "delete", spark.createDataFrame([], "id string")))
    want = [("a", "o", "t", 0), ("b", None, None, 0)]
    assert store.read("things").columns == [c.split()[0] for c in DDL.replace(", array<int>", ",array<int>").split(", ")]
    assert content(store, "id", "owner", "text", "hits") == want and "Exchange" not in planned()
    store.append(Delta("things", "bump", spark.createDataFrame([("a", 2, "t1")], "id string, hits int, at string")))
    assert content(store, "id", "owner", "text", "hits") == [("a", "o", "t", 2), want[1]] and "Exchange" in planned()
    store.compact("things")
    store.append(Delta("things", "upsert", rows_of(spark, [full("a", owner="other", text="new")])))
    assert content(store, "id", "owner", "text", "hits") == [("a", "o", "new", 0), want[1]]


def test_a_first_delta_that_is_no_upsert_gives_no_rows(spark, store):
    store.append(Delta("things", "patch", spark.createDataFrame([("a", "x")], "id string, text string")))
    assert content(store, "id") == []


def test_rows_that_hold_each_key_once_are_written_as_they_come(spark, store):
    rows = spark.range(0, 40, 1, 4).selectExpr("concat('k', id) AS id", "'o' AS owner", "'t' AS text", "0 AS hits", "'' AS at", "array('x') AS tags", "map('k', array(1)) AS refs")
    store.append(Delta("things", "upsert", rows, once=True))
    [delta] = store._state()["tables"]["things"]["deltas"]
    assert len(list(Path(f"{store.root}/{delta['path']}").glob("*.parquet"))) == 4 and delta["rows"] == 40
    assert content(store, "id") == sorted((f"k{i}",) for i in range(40))


def test_against_a_plain_dictionary(spark, store):
    """Random commits, folded at any time, with compactions in between."""
    rnd, want = random.Random(1), {}
    keys = [f"k{i}" for i in range(12)]
    for n in range(9):
        kind = rnd.choice(log.KINDS) if n else "upsert"
        some = rnd.sample(keys, rnd.randint(1, 8))
        if kind == "upsert":
            rows = [full(k, owner=f"o{n}", text=f"t{n}", hits=n) for k in some]
            df = rows_of(spark, rows)
            for k in some:
                want[k] = [want[k][0] if k in want else f"o{n}", f"t{n}", n]
        elif kind == "patch":
            df = spark.createDataFrame([(k, f"p{n}") for k in some], "id string, text string")
            for k in set(some) & set(want):
                want[k][1] = f"p{n}"
        elif kind == "bump":
            df = spark.createDataFrame([(k, 2) for k in some for _ in range(2)], "id string, hits int")
            for k in set(some) & set(want):
                want[k][2] += 4
        else:
            df = spark.createDataFrame([(k,) for k in some], "id string")
            want = {k: v for k, v in want.items() if k not in some}
        store.append(Delta("things", kind, df))
        if n % 3 == 2:
            store.compact("things")
    assert content(store, "id", "owner", "text", "hits") == sorted((k, *v) for k, v in want.items())


def test_compaction_rewrites_touched_buckets_only(spark, store):
    store.append(Delta("things", "upsert", rows_of(spark, [full(f"k{i}") for i in range(40)])))
    store.compact("things")
    before = store._state()["tables"]["things"]["base"]
    assert len(before) == 4
    store.append(Delta("things", "bump", spark.createDataFrame([("k7", 1)], "id string, hits int")))
    (touched,) = store.compact("things")
    after = store._state()["tables"]["things"]["base"]
    assert {b for b in after if after[b] != before[b]} == {touched}
    assert content(store, "id", "hits") == sorted((f"k{i}", int(i == 7)) for i in range(40))
    assert store.compact("things") == []


def test_rows_without_deltas_are_not_shuffled(spark, store):
    store.append(Delta("things", "upsert", rows_of(spark, [full(f"k{i}") for i in range(40)])))
    store.compact("things")
    store.append(Delta("things", "bump", spark.createDataFrame([("k7", 1)], "id string, hits int")))
    plan = store.read("things")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "broadcast" in plan.lower()


def test_a_stale_writer_loses_nothing_of_the_first(spark, tmp_path):
    """Both write the same table at the same version: the second one fails, and what the first committed stays."""
    first, second = (Store(spark, f"{tmp_path}/s") for _ in range(2))
    table = lambda n: {"t": (spark.range(n).toDF("id"), "id", ())}
    seen = first.replace(table(3))
    stale = second._state()
    first.replace(table(5), since=seen)
    real, second._state = second._state, lambda: stale
    put, second._put_if_absent = second._put_if_absent, lambda *a: setattr(second, "_state", real) or put(*a)
    with pytest.raises(Conflict):
        second.replace(table(1))
    assert first.read("t").count() == 5
    with pytest.raises(Conflict):
        second.replace(table(1), since=seen)
    assert Store(spark, f"{tmp_path}/s").read("t").count() == 5 and first.tables() == ["t"]


def test_appends_of_racing_writers_both_count(spark, tmp_path):
    one, two = (Store(spark, f"{tmp_path}/s", buckets=2) for _ in range(2))
    one.ensure(things=(DDL, "id", ()))
    one.append(Delta("things", "upsert", rows_of(spark, [full("a")])))
    stale = two._state()
    hits = spark.createDataFrame([("a", 1)], "id string, hits int")
    one.append(Delta("things", "bump", hits))
    real, calls = two._state, []

    def state():
        calls.append(1)
        return stale if len(calls) <= 2 else real()

    two._state = state
    two.append(Delta("things", "bump", hits))
    assert one.read("things").first().hits == 2
    # a compaction that meets an append keeps it; one that meets another compaction fails
    stale = real()
    one.append(Delta("things", "bump", hits))
    calls.clear()
    two.compact("things")
    assert one.read("things").first().hits == 3 and len(one._state()["tables"]["things"]["deltas"]) == 1
    stale = real()
    one.compact("things")
    calls.clear()
    with pytest.raises(Conflict):
        two.compact("things")
    assert one.read("things").first().hits == 3


def test_drafts_and_unfinished_folders_are_not_seen(spark, tmp_path, store):
    store.append(Delta("things", "upsert", rows_of(spark, [full("a")])))
    (Path(store.root) / ".draft-left").write_text("{half")
    spark.range(9).write.parquet(f"{store.root}/things/left-over")
    assert content(store, "id") == [("a",)]
    assert not store._put_if_absent(f"POINTER-{store.version():012d}", "{}")
    assert json.loads((Path(store.root) / f"POINTER-{store.version():012d}").read_text())["version"] == store.version()


def test_renames_do_not_overwrite(store):
    """The way of file systems without hard links."""
    for name, new in (("first", True), ("first", False), ("second", True)):
        draft = store._path(f"{store.root}/draft")
        store._fs.create(draft, True).close()
        assert store._renamed(draft, store._path(f"{store.root}/{name}")) is new
        store._fs.delete(draft, False)


def test_many_commits_are_compacted(spark, store, monkeypatch):
    monkeypatch.setattr(log, "MOST_DELTAS", 3)
    for i in range(4):
        store.append(Delta("things", "upsert", rows_of(spark, [full("a", hits=i)])))
    assert len(store._state()["tables"]["things"]["deltas"]) < 3 and content(store, "id", "hits") == [("a", 3)]
    assert store.read("things").where(F.col("hits") == 3).count() == 1


def test_many_changed_keys(spark, tmp_path, monkeypatch):
    """Deltas that name too many keys to broadcast: the same rows, and the base is exchanged once."""
    s = log.Store(spark, f"{tmp_path}/s")
    base = spark.range(40).select("id", F.concat(F.lit("v"), "id").alias("v"), F.lit(0).alias("n"), F.lit("old").alias("made"))
    s.replace({"t": (base, "id", ("made",))})
    new = spark.range(30, 50).select("id", F.lit("new").alias("v"), F.lit(5).alias("n"), F.lit("young").alias("made"))
    s.append(log.Delta("t", "upsert", new), log.Delta("t", "bump", spark.range(20, 60).select("id", F.lit(2).alias("n"))))
    s.append(log.Delta("t", "patch", spark.range(0, 60, 3).select("id", F.lit("patched").alias("v"))), log.Delta("t", "delete", spark.range(0, 60, 4).select("id")))
    small = sorted(tuple(r) for r in s.read("t").collect())
    want = {i: (i, f"v{i}", 0, "old") for i in range(40)} | {i: (i, "new", 5, "old" if i < 40 else "young") for i in range(30, 50)}
    want = {i: (i, "patched" if i % 3 == 0 else v, n + 2 * (i >= 20), made) for i, (_, v, n, made) in want.items() if i % 4}
    assert small == sorted(want.values())
    monkeypatch.setattr(log, "BROADCAST_KEYS", 0)
    read = s.read("t")
    assert sorted(tuple(r) for r in read.collect()) == small
    assert read._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
    s.compact("t")
    assert sorted(tuple(r) for r in s.read("t").collect()) == small
