import numpy as np
import pyarrow as pa

from larkspur.llm.packed import BLOCK, CAP, PARTED, SMALL, key_groups, pack_spread

KEY_BYTES, BUCKETS = 5, 4


def grouped(calls, most=None):
    """What key_groups gives for the rows of several calls, each (keys, ids)."""
    table = pa.Table.from_batches([pack_spread(k, i, BUCKETS, KEY_BYTES) for k, i in calls])
    out = []
    for b in range(BUCKETS):
        mine = table.filter(pa.compute.equal(table.column("bucket"), b))
        if mine.num_rows:
            out += key_groups(mine, KEY_BYTES, most).to_pylist()
    return table, out


def test_every_pair_of_a_key_is_a_pair_or_in_one_list():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    members = {int(k): rng.integers(-(1 << 60), 1 << 60, n) for k, n in zip(keys, [1, 2, SMALL, SMALL + 1, 40, CAP, CAP + 1, 3 * BLOCK + 5] + [3] * 52, strict=True)}
    calls = []
    for part in range(3):  # the ids of a key come in several calls, some of them twice
        k = np.concatenate([np.full(len(m[part::3]) + len(m[:2]), key, np.uint64) for key, m in members.items()])
        calls.append((k, np.concatenate([np.concatenate([m[part::3], m[:2]]) for m in members.values()])))
    table, rows = grouped(calls)
    assert PARTED not in {r["a"] for r in rows}
    pairs = {(r["a"], r["b"]) for r in rows if r["lid"] is None}
    lists = {}
    for r in rows:
        if r["lid"] is not None:
            lists.setdefault(r["lid"], set()).add(r["a"])
    for m in members.values():
        ids = set(m.tolist())
        if len(ids) <= SMALL:
            assert all((a, b) in pairs for a in ids for b in ids if a < b)
        else:
            assert any(ids <= x for x in lists.values())
    assert {len(x) for x in lists.values()} <= {len(set(m.tolist())) for m in members.values()}
    hot = max(members, key=lambda k: len(members[k]))
    assert len(members[hot]) > 2 * CAP
    _, frequent = grouped(calls, most=SMALL)
    alone = {r["a"] for r in frequent if r["b"] is None}
    assert alone == {i for m in members.values() if len(set(m.tolist())) > SMALL for i in m.tolist()}


def test_a_frequent_key_does_not_fill_its_bucket():
    n = 5000
    batch = pack_spread(np.full(n, 1 << 50 | 3, np.uint64), np.arange(n), BUCKETS, KEY_BYTES)
    own = [r for r in batch.to_pylist() if r["lid"] is None]
    parts = [r for r in batch.to_pylist() if r["lid"] is not None]
    assert sum(r["n"] for r in own) == 2 and sum(r["n"] for r in parts) == n
    assert len({r["bucket"] for r in parts}) > 1
