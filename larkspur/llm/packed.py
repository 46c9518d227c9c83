"""Key-value pairs as packed rows: many (key, id) pairs of a task travel in one row a bucket.

A bucket holds whole keys.  Pairs are laid out byte plane by byte plane, so that the
shuffle's compression finds the planes that hold little.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from larkspur.llm.text_hash import mix

SCHEMA = "bucket int, n int, body binary"


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _whole(body: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8, n * width).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _rows(bucket: np.ndarray, keys: np.ndarray, ids: np.ndarray, key_bytes: int) -> pa.RecordBatch:
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")  # 16 bits are sorted by radix
    keys, ids = keys[order], ids[order]
    which, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first[1:], len(order))[: len(first)]
    body = [_planes(keys[a:b], key_bytes) + _planes(ids[a:b].view(np.uint64), 8) for a, b in zip(first, ends, strict=True)]
    return pa.record_batch([pa.array(which, pa.int32()), pa.array(ends - first, pa.int32()), pa.array(body, pa.binary())], names=["bucket", "n", "body"])


def pack(keys: np.ndarray, ids: np.ndarray, n_buckets: int, key_bytes: int = 8) -> pa.RecordBatch:
    """One row a bucket of keys; keys are mixed 64-bit hashes, of which the upper key_bytes are kept beside the bucket."""
    bucket = ((keys & np.uint64(0xFFFFFF)) % np.uint64(n_buckets)).astype(np.int32)
    return _rows(bucket, keys >> np.uint64(64 - 8 * key_bytes), ids, key_bytes)


def pack_by_id(keys: np.ndarray, ids: np.ndarray, n_buckets: int, key_bytes: int = 8) -> pa.RecordBatch:
    """One row a bucket of ids; keys are numbers of key_bytes."""
    bucket = ((mix(ids.view(np.uint64)) >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int32)
    return _rows(bucket, keys, ids, key_bytes)


def _loose(table: pa.Table, key_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    keys, ids = [], []
    for n, body in zip(table.column("n").to_pylist(), table.column("body").to_pylist(), strict=True):
        view = memoryview(body)
        keys.append(_whole(view[: n * key_bytes], n, key_bytes))
        ids.append(_whole(view[n * key_bytes :], n, 8).view(np.int64))
    return np.concatenate(keys), np.concatenate(ids)


def _repeated(table: pa.Table, key_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Like ``unpack``, without the keys that occur once."""
    k, v = _loose(table, key_bytes)
    order = np.argsort(k)
    same = k[order[1:]] == k[order[:-1]]
    order = order[np.append(False, same) | np.append(same, False)] if len(k) > 1 else order[:0]
    k, v = k[order], v[order]
    order = np.lexsort((v, k))
    return k[order], v[order]


def unpack(table: pa.Table, key_bytes: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ids) of a bucket's rows, sorted by key and then id (as signed numbers)."""
    k, v = _loose(table, key_bytes)
    order = np.lexsort((v, k))
    return k[order], v[order]


def by_id(keys: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Keys gathered by id: ids, and the little-endian keys of each."""
    if not len(ids):
        return [], []
    order = np.argsort(ids, kind="stable")
    keys, ids = keys[order].astype("<u8"), ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    ends = np.append(first[1:], len(ids))
    return ids[first].tolist(), [keys[x:y].tobytes() for x, y in zip(first, ends, strict=True)]


#: A key with more ids than this in one call of ``pack_spread`` leaves its own bucket.
CAP = 256
#: Members of a part of a large group.
BLOCK = 512
#: Stands among the ids of a key of which whole parts have gone elsewhere.
PARTED = -(1 << 63)
SPREAD = "bucket int, n int, body binary, lid long"
GROUPS = "lid long, a long, b long, hub boolean"
SMALL = 8


def list_id(keys: np.ndarray, bucket: int) -> np.ndarray:
    """The name of the list of a bucket's key."""
    return mix(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(bucket + 1)).view(np.int64)


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the runs of equal rows of sorted columns."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, n))


def pack_spread(keys: np.ndarray, ids: np.ndarray, n_buckets: int, key_bytes: int) -> pa.RecordBatch:
    """Like ``pack``, with no more than CAP ids of a key for the key's own bucket.

    The ids of a more frequent key go out here in parts of BLOCK, over all buckets; only the
    least of them and PARTED stand for them in the key's bucket.
    """
    parts: list[tuple[int, np.ndarray, int]] = []
    slot = (keys >> np.uint64(40)).astype(np.int64) & 0xFFFFF
    crowd = np.bincount(slot, minlength=1 << 20) > CAP
    if crowd.any():
        at = np.flatnonzero(crowd[slot])
        at = at[np.lexsort((ids[at], keys[at]))]
        at = at[_runs(keys[at], ids[at])[0]]
        keep = np.ones(len(keys), bool)
        marks = []
        for s, n in zip(*_runs(keys[at]), strict=True):
            if n > CAP:
                mine = at[s : s + n]
                key = keys[mine[0]]
                bucket = int((key & np.uint64(0xFFFFFF)) % np.uint64(n_buckets))
                lid = int(list_id(keys[mine[:1]] >> np.uint64(64 - 8 * key_bytes), bucket)[0])
                for j in range(0, n, BLOCK):
                    parts.append((int(mix(keys[mine[:1]] + ids[mine[j : j + 1]].view(np.uint64))[0] % np.uint64(n_buckets)), ids[mine[j : j + BLOCK]], lid))
                marks.append((key, ids[mine[0]]))
        if marks:
            hot = np.array([m[0] for m in marks], np.uint64)
            keep = ~np.isin(keys, hot)
            keys = np.concatenate([keys[keep], np.repeat(hot, 2)])
            ids = np.concatenate([ids[keep], np.array([x for m in marks for x in (PARTED, m[1])], np.int64)])
    own = pack(keys, ids, n_buckets, key_bytes)
    bucket = pa.concat_arrays([own.column("bucket"), pa.array([p[0] for p in parts], pa.int32())])
    n = pa.concat_arrays([own.column("n"), pa.array([len(p[1]) for p in parts], pa.int32())])
    body = pa.concat_arrays([own.column("body"), pa.array([p[1].astype("<i8").tobytes() for p in parts], pa.binary())])
    lid = pa.array([None] * own.num_rows + [p[2] for p in parts], pa.int64())
    return pa.record_batch([bucket, n, body, lid], names=["bucket", "n", "body", "lid"])


def _groups_table(lid: list, a: list, b: list, hub: list) -> pa.Table:
    """Parts of columns to a table of GROUPS; a lid or b of None is null throughout its part."""
    n = [len(x) for x in a]

    def column(parts, kind):
        return pa.chunked_array([pa.nulls(k, kind) if p is None else pa.array(p, kind) for p, k in zip(parts, n, strict=True)], kind)

    return pa.table({"lid": column(lid, pa.int64()), "a": column(a, pa.int64()), "b": column(b, pa.int64()), "hub": column(hub, pa.bool_())})


def key_groups(table: pa.Table, key_bytes: int, most: int | None) -> pa.Table:
    """What a bucket's keys hold together, as rows of GROUPS.

    Of a key with SMALL ids or fewer: the pairs (a, b), with ``hub`` where a is the least id.
    Of one with more: a row (lid, a, part b) for each id a; lists of the same ids have one lid.
    With ``most``, keys with more ids than that give each id once as (a) alone, and no list.
    """
    bucket = table.column("bucket")[0].as_py()
    whole = table.filter(table.column("lid").is_valid())
    lid, a, b, hub = [], [], [], []
    for name, body in zip(whole.column("lid").to_pylist(), whole.column("body").to_pylist(), strict=True):
        members = np.frombuffer(body, "<i8")
        lid.append(None if most is not None else np.full(len(members), name))
        a.append(members)
        b.append(None if most is not None else np.full(len(members), members[0]))
        hub.append(None)
    own = table.filter(table.column("lid").is_null())
    keys, ids = _repeated(own, key_bytes) if own.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    new = _runs(keys, ids)[0]
    keys, ids = keys[new], ids[new]
    starts, sizes = _runs(keys)
    parted = ids[starts] == PARTED if len(starts) else np.zeros(0, bool)
    large = parted | (sizes > (SMALL if most is None else most))
    for n in range(2, SMALL + 1):
        members = ids[starts[(sizes == n) & ~large][:, None] + np.arange(n)]
        i, j = np.triu_indices(n, 1)
        if len(members):
            x, y = members[:, i].ravel(), members[:, j].ravel()
            lid.append(None)
            a.append(x)
            b.append(y)
            hub.append(np.tile(i == 0, len(members)))
    if most is not None:
        frequent = np.unique(ids[np.repeat(large, sizes)])
        lid.append(None)
        a.append(frequent[frequent != PARTED])
        b.append(None)
        hub.append(None)
    else:
        total = np.add.reduceat(mix(ids.view(np.uint64)), starts) if len(starts) else np.zeros(0, np.uint64)
        by_set = mix(total + sizes.astype(np.uint64)).view(np.int64)
        by_key = list_id(keys[starts], bucket)
        for s, n, p, x, y in zip(starts[large], sizes[large], parted[large], by_set[large], by_key[large], strict=True):
            members = ids[s + p : s + n]
            lid.append(np.full(len(members), y if p else x))
            a.append(members)
            b.append(members[np.arange(len(members)) // BLOCK * BLOCK])
            hub.append(None)
    return _groups_table(lid, a, b, hub)
