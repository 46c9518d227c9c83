"""Documents that hold passages of a benchmark, by pigeonhole pieces and Myers' distance.

Texts are compared as words: A-Z and other letters lower-cased, blanks collapsed, and
characters at a word's ends that are neither letters nor digits dropped.  A passage with
an error budget of k edits is cut into k + 1 pieces; a text within k edits of it holds
one piece unchanged.  An automaton of all pieces finds the exact hits in each document;
around each, Myers' bit-parallel algorithm gives the least edit distance of the passage
to any part of the document's surroundings.

A passage too short for a single error (budget 0) is sought as it is, between the borders
of words, or anywhere if it has a character of a script that is written without blanks.

The benchmark, the query set, is dealt in blocks whose pieces have at most
``BLOCK_CHARS`` characters; each block is a broadcast of its own, and every document
meets every block.

Defined results: null or empty texts hold nothing, and null or empty passages are in
nothing; of equally near places of a passage the first counts; a text of any length is
searched whole; null doc ids are reported as null; repeated rows are judged each by
itself; an empty table, of either kind, gives no findings; other columns, of either
table, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.05
#: Characters from here on are of scripts that are written without blanks.
_UNSPACED = "\u2e80"
BLOCK_CHARS = 8_000_000
HITS = "doc_id long, item_id long, start long, end long, distance int"

_WORD = re.compile(r"[^\W_](?:\S*[^\W_])?")


def compared(text: str | None) -> str:
    """What of a text is compared."""
    return " ".join(_WORD.findall((text or "").lower()))


def budget(n_chars: int, rate: float = ERROR_RATE) -> int:
    return int(n_chars * rate)


def pieces(passage: str, k: int) -> list[tuple[int, str]]:
    """(place, piece): k + 1 pieces of nearly equal length."""
    cuts = [len(passage) * i // (k + 1) for i in range(k + 2)]
    return [(a, passage[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance of pattern to any part of text, and where the first such part ends."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _bordered(p: str, text: str, at: int) -> bool:
    """Whether a short passage stands between the borders of words at a place, or needs none."""
    end = at + len(p)
    return any(c >= _UNSPACED for c in p) or ((at == 0 or text[at - 1] == " ") and (end == len(text) or text[end] == " "))


class Finder:
    """Passages of one block."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = items
        self.budget = [budget(len(p), rate) for _, p in items]
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (_, p) in enumerate(items):
            for place, piece in pieces(p, self.budget[i]):
                at.setdefault(piece, []).append((i, place))
        self.auto = ahocorasick.Automaton()
        for piece, where in at.items():
            self.auto.add_word(piece, (len(piece), where))
        if at:
            self.auto.make_automaton()
        self.empty = not at

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, distance) of the passages that compared text holds, the best place of each."""
        if self.empty or not text:
            return
        diagonals: dict[int, set[int]] = {}
        for last, (size, where) in self.auto.iter(text):
            for i, place in where:
                diagonals.setdefault(i, set()).add(last + 1 - size - place)
        for i, starts in diagonals.items():
            item, p = self.items[i]
            k = self.budget[i]
            exact = next((x for x in sorted(starts) if x >= 0 and text.startswith(p, x) and (k or _bordered(p, text, x))), None)
            if exact is not None:
                yield item, exact, exact + len(p), 0
                continue
            best, around = None, []
            for s in sorted(starts) if k else ():  # overlapping surroundings are searched once
                lo, hi = max(0, s - k), min(len(text), s + len(p) + k)
                if around and lo <= around[-1][1]:
                    around[-1][1] = max(hi, around[-1][1])
                else:
                    around.append([lo, hi])
            for lo, hi in around:
                if hi - lo >= len(p) - k:
                    d, end = myers(p, text[lo:hi])
                    if d <= k and (best is None or d < best[2]):
                        best = (max(0, lo + end - len(p)), lo + end, d)
            if best:
                yield (item, *best)


def _search(found, rate: float):
    def run(batches):
        finder = Finder(found.value, rate)
        for batch in batches:
            rows = [(doc, *hit) for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in finder.find(compared(t))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "start", "end", "distance"])

    return run


def passages(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's passages in blocks of a bounded size: the query set, which the driver holds one block at a time."""

    def all_items():
        for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().toLocalIterator():
            p = compared(r["text"])
            if p:
                yield r["item_id"], p

    part, size = [], 0
    for x in all_items():
        if part and size + len(x[1]) > BLOCK_CHARS:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x[1])
    if part:
        yield part


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, start, end, distance): a row for each document and passage it holds; places are in the compared text."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [texts.mapInArrow(_search(context.broadcast(part), rate), HITS) for part in passages(benchmark)]
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], HITS)


def _judge(found, rate: float):
    def run(batches):
        finder = Finder(found.value, rate)
        for batch in batches:
            leaked = [next(finder.find(compared(t)), None) is not None for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([not x for x in leaked], pa.bool_()))

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs that hold no passage of benchmark; one pass over docs for each block, no shuffle."""
    for part in passages(benchmark):
        docs = docs.mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(part), rate), docs.schema)
    return docs


# --- the registered query -------------------------------------------------


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES: dict[str, str] = {}
