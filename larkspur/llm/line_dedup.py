"""Fuzzy line deduplication: MinHash bands, exact Jaccard, distributed union-find.

A line is what stands between newlines; lines without a word are left alone.  A line's
set is its distinct runs of ``SHINGLE`` characters (a shorter line is one shingle), blanks
collapsed and ASCII letters lower-cased.  Lines with equal such forms are one item.
MinHash signatures of ROWS * BANDS values are cut into bands; lines that share a band
are a group, and groups go through sketches to exact Jaccard indexes and to connected
components (see ``links``).  Of each component the first line of the corpus, by doc_id
and then by place, stays; the others are cut from their documents.

What still links: of n distinct shingles, n = characters - 4 if none repeats, an edit that
drops d and brings d others leaves (n - d) / (n + d), so at 0.8 d may be n / 9.  One
changed character, of whatever script, drops 5 and links lines of 49 characters or more; a
replaced word of 6 letters drops 10 and links lines of 94 or more.  Nearer an end an edit
drops fewer: a changed last character links lines of 13 or more.

At similarity 0.8 the bands find 1 - (1 - 0.8 ** ROWS) ** BANDS of the pairs: 0.991.
An item is named by a 64-bit hash of its form, and shingles are compared by 64-bit hashes.

Defined results: a null text stays null and has no lines; documents with one doc_id
count as one for order, and each of them keeps the lines that are first there; documents
without an id come last, by a hash of their text, and count as one if their texts are
equal; a text of any length is compared in all its lines, and a line in all its
characters; an empty table gives no rows; other columns are kept as they are, whatever
their names.
"""

from __future__ import annotations

from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.keys import KEY, KEY_SCHEMA, key_columns, text_column, text_of, whole_rows
from larkspur.llm.links import Bound, may_hold, mixed_bitmap, similar_components, sketch_columns, spread_join, with_both
from larkspur.llm.packed import GROUPS, SPREAD, key_groups, pack_spread
from larkspur.llm.session import Scratch, checkpoint, shuffle_partitions
from larkspur.llm.text_hash import U, mix, powers

SHINGLE = 5
ROWS, BANDS = 7, 20
_KEY_BYTES = 5
#: 64-bit words of a line's sketch: lines have some hundred shingles, of which linked ones may lack many.
SKETCH = sketch_columns(16)
#: Shingles whose signatures are made at once, so that the work stays in the cache.
_CHUNK = 120_000
#: Bytes of text that are worked on at once; one text is never split.
_SLICE = 120_000
#: Texts that are worked on and sent at once: their band keys take some 20 KB a text, their lines some copies of the text.
_TEXTS = 2500
#: Buckets of band keys for each shuffle partition: a task holds one bucket at a time.
_BUCKETS = 4
_STEP = 0xD6E8FEB86659FD93


#: Bytes of texts: A-Z lower-cased, blanks as spaces.
_PLAIN = bytes(32 if b in b"\t\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


@lru_cache(2)
def _inverse_powers(n: int) -> np.ndarray:
    out = np.full(n, pow(_STEP, -1, 1 << 64), U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def _slices(texts: list[bytes | None]):
    """(first, texts) of runs of texts of a bounded size, null as empty."""
    part, size, first = [], 0, 0
    for i, t in enumerate(texts):
        if part and size + len(t or b"") > _SLICE:
            yield first, part
            part, size, first = [], 0, i
        part.append(t or b"")
        size += len(part[-1])
    if part:
        yield first, part


class Lines:
    """All lines of some texts: their forms as code points, from start on, size of them; per_text lines to a text."""

    def __init__(self, texts: list[bytes]):
        self.per_text = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
        c = np.frombuffer(b"\n".join(texts).translate(_PLAIN).decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        blank, end = c == 32, c == 10
        drop = blank[1:] & (blank[:-1] | end[:-1] | end[1:])
        if blank[:1].any() or blank[-1:].any() or drop.any():
            # blanks after a blank or at a line's start, then those at its end
            keep = ~(blank & np.concatenate([[True], (blank | end)[:-1]]))
            c = c[keep]
            c = c[~((c == 32) & np.append(c[1:] == 10, True))]
        self.points = c
        ends = np.append(np.flatnonzero(c == 10), len(c))
        self.start = np.concatenate([[0], ends[:-1] + 1])
        self.size = ends - self.start
        self.full = np.flatnonzero(self.size)
        self.counts = np.maximum(self.size[self.full] - (SHINGLE - 1), 1)
        self.first = np.cumsum(self.counts) - self.counts
        short = self.full[self.size[self.full] < SHINGLE]
        x = np.zeros(len(c) + SHINGLE, U)  # newlines are 0 here, which only short lines see
        x[: len(c)] = c
        x[ends] = 0
        two = x[1:] << U(21)
        two += x[:-1]
        h = x[2 : 2 + len(c)] << U(42)
        h += two[: len(c)]
        h *= U(0x9E3779B97F4A7C15)
        two = two[3 : 3 + len(c)]
        two *= U(0xD6E8FEB86659FD93)
        h += two
        for s, n in zip(self.start[short], self.size[short], strict=True):
            y = np.append(x[s : s + n], np.zeros(SHINGLE, U))
            h[s : s + 1] = (y[:1] + (y[1:2] << U(21)) + (y[2:3] << U(42))) * U(0x9E3779B97F4A7C15) + (y[3:4] + (y[4:5] << U(21))) * U(0xD6E8FEB86659FD93)
        inside = np.ones(len(c) + 1, bool)
        for j in range(SHINGLE):  # no shingle starts in a line's last characters, but the only one of a short line
            inside[np.maximum(ends - j, 0)] = False
        inside[self.start[short]] = True
        h = h[inside[: len(c)]]
        h ^= h >> U(32)
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(29)
        self.hashes = h

    def names(self) -> np.ndarray:
        """64-bit names of the lines that have a word."""
        if not len(self.full):
            return np.zeros(0, np.int64)
        n = 1 << max(17, len(self.hashes).bit_length())
        total = np.add.reduceat(self.hashes * powers(n)[: len(self.hashes)], self.first) * _inverse_powers(n)[self.first]
        return mix(total + self.counts.astype(U)).view(np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, line, bounds): the distinct shingles of the lines that have a word, line by line and sorted."""
        line = np.repeat(np.arange(len(self.full), dtype=U), self.counts)
        order = np.argsort(line << U(44) | self.hashes >> U(20))
        h, line = self.hashes[order], line[order].astype(np.int64)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        h, line = h[new], line[new]
        return h, line, np.searchsorted(line, np.arange(len(self.full) + 1))

    def form(self, i: int) -> str:
        s = self.start[self.full[i]]
        return self.points[s : s + self.size[self.full[i]]].tobytes().decode("utf-32-le")


def band_keys(lines: Lines, which: np.ndarray) -> np.ndarray:
    """A row of BANDS 64-bit keys for each of some of the lines that have a word.

    Each signature value is the least of 16 bits of the shingles' hashes times an odd number; the values take the hashes'
    four quarters in turn.  Two values of n shingles agree by chance once in 65536 / n times, a band hardly ever.
    """
    n = ROWS * BANDS
    odd = mix(np.arange(1, n + 1, dtype=U)).astype(np.uint16) | np.uint16(1)
    least = np.empty((n, len(which)), np.uint16)
    all_counts = lines.counts[which]
    ends = np.cumsum(all_counts)
    if np.array_equal(which, np.arange(len(lines.full))):
        hashes = lines.hashes
    elif len(which) and 8 * ends[-1] >= 7 * len(lines.hashes):  # a few lines too many cost less than gathering the others
        return band_keys(lines, np.arange(len(lines.full)))[which]
    else:
        hashes = lines.hashes[np.repeat(lines.first[which] - (ends - all_counts), all_counts) + np.arange(ends[-1] if len(ends) else 0)]
    quarters = hashes.astype("<u8", copy=False).view("<u2").reshape(-1, 4)
    at = 0
    while at < len(which):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + _CHUNK, "right")))
        first = ends[at:end] - all_counts[at:end] - before
        h = quarters[before : ends[end - 1]]
        out = np.empty(len(h), np.uint16)
        for q in range(4):
            quarter = np.ascontiguousarray(h[:, q])
            for i in range(q, n, 4):
                np.multiply(quarter, odd[i], out=out)
                np.minimum.reduceat(out, first, out=least[i, at:end])
        at = end
    # All bands at once: a band's values fill two 64-bit numbers.
    values = np.zeros((BANDS, len(which), 8), "<u2")
    values[:, :, :ROWS] = least.reshape(BANDS, ROWS, -1).transpose(0, 2, 1)
    halves = values.view("<u8")
    keys = mix(mix(halves[:, :, 0] + np.arange(1, BANDS + 1, dtype=U)[:, None] * U(_STEP)) + halves[:, :, 1])
    return np.ascontiguousarray(keys.T)


def _parts(batch: pa.RecordBatch):
    return (batch.slice(at, _TEXTS) for at in range(0, batch.num_rows, _TEXTS))


def _bytes_of(column) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _distinct(batch: pa.RecordBatch):
    """(Lines, names, which): the lines of a batch that were not there before in it."""
    seen: set[int] = set()
    for _, texts in _slices(_bytes_of(batch.column("text"))):
        lines = Lines(texts)
        all_names = lines.names()
        names, which = np.unique(all_names, return_index=True)
        new = np.array([x not in seen for x in names.tolist()], bool)
        seen.update(names[new].tolist())
        which = np.sort(which[new])
        yield lines, all_names[which], which


def _send_bands(n_buckets: int):
    def run(batches):
        for part in (part for batch in batches for part in _parts(batch)):
            keys, ids = [], []
            for lines, names, which in _distinct(part):
                keys.append(band_keys(lines, which).reshape(-1))
                ids.append(np.repeat(names, BANDS))
            if keys:
                yield pack_spread(np.concatenate(keys), np.concatenate(ids), n_buckets, _KEY_BYTES)

    return run


def _attributes(batches):
    bits = 64 * len(SKETCH)
    for batch in batches:
        sizes, parity = [], []
        for _, forms in _slices(_bytes_of(batch.column("form"))):
            h, line, bounds = Lines(forms).distinct()
            sizes.append(np.diff(bounds))
            odd = np.bincount(line * bits + ((h >> U(20)).astype(np.int64) & (bits - 1)), minlength=len(forms) * bits) & 1
            parity.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(-1, len(SKETCH)))
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        parity = np.concatenate(parity) if parity else np.zeros((0, len(SKETCH)), np.int64)
        yield pa.record_batch([batch.column("id"), pa.array(sizes), *[pa.array(parity[:, j]) for j in range(len(SKETCH))]], names=["id", "n", *SKETCH])


class _Sets:
    """The shingle sets of forms; those used last are kept, up to ``most`` shingles."""

    def __init__(self, most: int = 1_000_000):
        self.kept: OrderedDict[int, np.ndarray] = OrderedDict()
        self.size, self.most = 0, most

    def add(self, names: list[int], forms: list[bytes]) -> None:
        new = {k: f for k, f in zip(names, forms, strict=True) if k not in self.kept}
        for at, part in _slices(list(new.values())):
            h, _, bounds = Lines(part).distinct()
            for i, k in enumerate(list(new)[at : at + len(part)]):
                self.kept[k] = h[bounds[i] : bounds[i + 1]].copy()
            self.size += len(h)

    def shrink(self) -> None:
        while self.size > self.most:
            self.size -= len(self.kept.popitem(last=False)[1])


def _compare(bound: Bound):
    def run(batches):
        sets = _Sets()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                sets.add(a + b, _bytes_of(part.column("form_a")) + _bytes_of(part.column("form_b")))
                keep = []
                for i, (p, q) in enumerate(zip(a, b, strict=True)):
                    x, y = sets.kept[p], sets.kept[q]
                    keep.append(bound.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
                sets.shrink()
                yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _lines_of(wanted):
    """(late, k, id, again, form): the lines of each document, once each; again: there twice; forms that may be wanted, once a batch."""

    def run(batches):
        sent: set[int] = set()
        for batch, at_start in ((part, i == 0) for batch in batches for i, part in enumerate(_parts(batch))):
            if at_start:
                sent.clear()
            for at, texts in _slices(_bytes_of(batch.column("text"))):
                lines = Lines(texts)
                name = lines.names()
                row = np.repeat(np.arange(len(texts)), lines.per_text)[lines.full]
                order = np.lexsort((name, row))
                new = np.ones(len(order), bool)
                new[1:] = (name[order][1:] != name[order][:-1]) | (row[order][1:] != row[order][:-1])
                again = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
                order = order[new]
                forms = [None] * len(order)
                for i in np.flatnonzero(may_hold(wanted.value, name[order])).tolist():
                    x = int(name[order[i]])
                    if x not in sent:
                        sent.add(x)
                        forms[i] = lines.form(order[i])
                place = pa.array(row[order] + at)
                columns = [batch.column("late").take(place), batch.column("k").take(place), pa.array(name[order]), pa.array(again), pa.array(forms, pa.string())]
                yield pa.record_batch(columns, names=["late", "k", "id", "again", "form"])

    return run


def _components(rows: DataFrame, found: DataFrame, some: DataFrame, bound: Bound) -> DataFrame:
    """(id, component) of the lines that are similar to another line; rows (id, form) hold the forms of some ids."""
    forms = rows.where("form IS NOT NULL").select("id", "form").join(some, "id", "left_semi").dropDuplicates(["id"])
    forms = checkpoint(forms)
    listed = found.where("lid IS NOT NULL").select(F.col("a").alias("id")).distinct()
    attrs = checkpoint(forms.join(listed, "id", "left_semi").mapInArrow(_attributes, ", ".join(["id long", "n long", *[f"{s} long" for s in SKETCH]])))

    def verify(pairs: DataFrame) -> DataFrame:
        return with_both(pairs, forms, "form").mapInArrow(_compare(bound), "a long, b long")

    return similar_components(found, attrs, bound, verify, doubtful=False)


def _candidates(texts: DataFrame) -> DataFrame:
    n = _BUCKETS * shuffle_partitions(texts.sparkSession)
    groups = texts.mapInArrow(_send_bands(n), SPREAD).groupBy("bucket").applyInArrow(lambda t: key_groups(t, _KEY_BYTES, None), GROUPS)
    return checkpoint(groups.groupBy("lid", "a", "b").agg(F.bool_or("hub").alias("hub")))


def line_verdicts(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """(late, k, gone, same, again): what is to be cut, for the document keys that lose a line at all or may.

    gone: lines that are first in an earlier document; same: (id, component) of first lines that have likes of another
    form; again: the document repeats a line.

    Where a component is first is found from its distinct lines; the rows of a frequent line meet its verdict in several tasks.
    """
    keyed = docs.select(*key_columns(), text_column().alias("text"))
    found = _candidates(keyed.select("text"))
    some = found.select(F.explode(F.when(F.col("lid").isNull(), F.array("a", "b")).otherwise(F.array("a"))).alias("id")).distinct()
    with Scratch(docs.sparkSession) as files:
        some = files.written(some)
        rows = files.written(keyed.mapInArrow(_lines_of(mixed_bitmap(some, "id")), f"{KEY_SCHEMA}, id long, again boolean, form string"))
        linked = _components(rows, found, some, Bound(num, den))
        rows = rows.select(*KEY, "id", "again")
        k, late = F.col("k"), F.col("late")
        own = rows.groupBy("id").agg(F.min(F.when(~late, k)).alias("least"), F.min(F.when(late, k)).alias("least_late"), F.count("*").alias("n"))
        own = files.written(own.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id")))
        first = own.groupBy("component").agg(F.min("least").alias("least"), F.min("least_late").alias("least_late"), F.count("*").alias("ids"), F.sum("n").alias("n"))
        first = files.written(first.where("n > 1").withColumn("several", F.col("ids") > 1))
        verdict = spread_join(own.select("id", "component"), first.select("component", "least", "least_late", "several"), "component", sizes=first.select("component", F.col("ids").alias("n")))
        cut = spread_join(rows, files.written(verdict), "id", sizes=own.select("id", "n"))
        is_first = F.when(late, F.col("least").isNull() & (k == F.col("least_late"))).otherwise(F.coalesce(k == F.col("least"), F.lit(False)))
        gone, same = F.when(~is_first, F.col("id")), F.when(is_first & F.col("several"), F.struct("id", "component"))
        cut = cut.select(*KEY, gone.alias("gone"), same.alias("same"), F.lit(False).alias("again")).where("gone IS NOT NULL OR same IS NOT NULL")
        twice = rows.where("again").select(*KEY, F.lit(None).cast("long").alias("gone"), F.lit(None).cast(cut.schema["same"].dataType).alias("same"), "again")
        lists = [F.collect_list(c).alias(c) for c in ("gone", "same")]
        return checkpoint(cut.union(twice).groupBy(*KEY).agg(*lists, F.bool_or("again").alias("again")))


def line_components(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """(id, component) of the lines of docs that are similar to another line."""
    keyed = docs.select(*key_columns(), text_column().alias("text"))
    found = _candidates(keyed.select("text"))
    some = checkpoint(found.select(F.explode(F.when(F.col("lid").isNull(), F.array("a", "b")).otherwise(F.array("a"))).alias("id")).distinct())
    rows = checkpoint(keyed.mapInArrow(_lines_of(mixed_bitmap(some, "id")), f"{KEY_SCHEMA}, id long, again boolean, form string"))
    return _components(rows, found, some, Bound(num, den))


def _cut(names: list[str], add_counts: bool):
    """Cuts the lines that have an earlier like; an in-document copy of a line goes as well."""

    def run(batches):
        for batch in (part for batch in batches for part in _parts(batch)):
            row = batch.column("row")
            old = _bytes_of(text_of(batch))
            verdicts = list(zip(*[batch.column(c).to_pylist() for c in ("gone", "same", "again")], strict=True))
            # First lines of components that the document has one line of stay, and so does its text.
            touched = [gone is not None and (again or len(gone) > 0 or len({x["component"] for x in same}) < len(same)) for gone, same, again in verdicts]
            texts = list(old)
            counts = [None if t else (sum(1 for x in (b or b"").split(b"\n") if x.strip()) if add_counts else 0, 0) for b, t in zip(old, touched, strict=True)]
            which = np.flatnonzero(touched).tolist()
            for at, part in _slices([old[i] for i in which]):
                lines = Lines(part)
                name = lines.names().tolist()
                row_ends = np.cumsum(lines.per_text)
                cuts = np.searchsorted(lines.full, row_ends)
                lo = 0
                for i, text in enumerate(part):
                    hi, r = int(cuts[i]), which[at + i]
                    begin = int(row_ends[i] - lines.per_text[i])
                    gone, same = set(verdicts[r][0]), {x["id"]: x["component"] for x in verdicts[r][1]}
                    seen, cut = set(), set()
                    for j in range(lo, hi):
                        component = same.get(name[j], name[j])
                        if name[j] in gone or component in seen:
                            cut.add(int(lines.full[j]) - begin)
                        seen.add(component)
                    if cut:
                        texts[r] = b"\n".join([x for p, x in enumerate(text.split(b"\n")) if p not in cut])
                    counts[r] = (hi - lo, len(cut))
                    lo = hi
            new = pa.array(texts, pa.binary()).cast(pa.string())
            out = [new if c == "text" else row.field(i) for i, c in enumerate(names)]
            if add_counts:
                out += [pa.array([c[j] for c in counts], pa.int64()) for j in (0, 1)]
            yield pa.record_batch(out, names=[*names, *(["n_lines", "n_removed"] if add_counts else [])])

    return run


def line_dedup(docs: DataFrame, num: int = 80, den: int = 100, counts: bool = False) -> DataFrame:
    """docs with the text of every row deduplicated; with counts, also n_lines and n_removed."""
    rows = whole_rows(docs).join(line_verdicts(docs, num, den), KEY, "left").select("row", "gone", "same", "again")
    schema = docs.withColumn("text", text_column())
    if counts:
        schema = schema.select("*", *[F.lit(None).cast("long").alias(c) for c in ("n_lines", "n_removed")])
    return rows.mapInArrow(_cut(docs.columns, counts), schema.schema)


# --- the registered query -------------------------------------------------


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs, counts=True)


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES: dict[str, str] = {}
