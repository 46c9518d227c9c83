"""Symbols of texts by recompression: runs and pairs get names, round after round.

A level names the maximal runs of one symbol, then the pairs of a left and a right symbol;
a bit of a symbol's name, another one at each level, says which it is.  A name is a hash
of what it stands for, so equal names in all texts stand for equal words, without a
dictionary; and a symbol depends on its words and its neighbours only, so copies of a
passage have the same symbols but for some at its ends.
"""

from __future__ import annotations

import numpy as np

from larkspur.llm.text_hash import U, Words, mix

#: Levels, each with a bit of a name; texts of n words need about log(n) / log(4 / 3) of them to become one symbol.
LEVELS = 60


class Symbols:
    """Symbols of all levels that stand for ``least`` words or more: names, first words, sizes and texts."""

    def __init__(self, words: Words, least: int):
        n = len(words.hash)
        name, at = words.hash, np.arange(n)
        head = np.zeros(n, bool)
        head[words.bounds[:-1][np.diff(words.bounds) > 0]] = True
        texts = int(head.sum())
        names, first, sizes = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for level in range(LEVELS):
            if len(name) == texts:
                break
            for step in (_runs, lambda a, b: _pairs(a, b, level)):
                name, keep, made = step(name, head)
                at, head = at[keep], head[keep]
                size = np.append(at[1:], n)[made] - at[made]
                long = size >= least
                names.append(name[made[long]])
                first.append(at[made[long]])
                sizes.append(size[long])
        self.name, self.at, self.size = np.concatenate(names), np.concatenate(first), np.concatenate(sizes)
        self.text = np.searchsorted(words.bounds, self.at, "right") - 1


def _runs(name: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, which symbols they start at, which of them are new) after the maximal runs of a text have names."""
    start = np.ones(len(name), bool)
    start[1:] = (name[1:] != name[:-1]) | head[1:]
    keep = np.flatnonzero(start)
    times = np.diff(np.append(keep, len(name)))
    made = np.flatnonzero(times > 1)
    name = name[keep]
    name[made] = mix(name[made] * U(3) + mix(times[made].astype(U)))
    return name, keep, made


def _pairs(name: np.ndarray, head: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``_runs``, after the pairs of a left and a right symbol have names."""
    left = (name >> U(level)).astype(np.uint8) & np.uint8(1) > 0
    pair = np.zeros(len(name), bool)
    pair[:-1] = left[:-1] & ~left[1:] & ~head[1:]
    at = np.flatnonzero(pair)
    out = name.copy()
    out[at] = mix(mix(name[at]) * U(5) + name[at + 1])
    start = np.ones(len(name), bool)
    start[at + 1] = False
    keep = np.flatnonzero(start)
    return out[keep], keep, np.flatnonzero(pair[keep])


class Windows:
    """What is known of the windows of some texts by their symbols.

    ``known[i]`` holds names that an earlier document than text i has.  A symbol with a known
    name, or one that its text has earlier, is a copy; a window inside a copy is settled: it
    goes, and it is not the first of its like.  All others are live.
    """

    def __init__(self, words: Words, window: int, known: list[bytes | None]):
        self.window, n = window, len(words.hash)
        self.symbols = s = Symbols(words, window)
        seed = mix(np.arange(1, len(known) + 1, dtype=U))
        lists = [np.frombuffer(x or b"", "<u8") for x in known]
        mine = s.name ^ seed[s.text]
        theirs = np.concatenate([x ^ seed[i] for i, x in enumerate(lists)]) if lists else np.zeros(0, U)
        self.known = np.isin(mine, theirs)
        order = np.lexsort((s.at, mine))
        self.again = np.zeros(len(mine), bool)
        self.again[order[1:]] = mine[order[1:]] == mine[order[:-1]]
        copy = self.known | self.again
        valid = np.zeros(n, bool)
        ends = np.repeat(words.bounds[1:], np.diff(words.bounds))
        valid[:] = np.arange(n) + window <= ends
        self.live = valid & ~cover(n, s.at[copy], s.size[copy] - window + 1)
        self._before = np.concatenate([[0], np.cumsum(self.live)])

    def any_live(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether one of the windows that start from low to high is live."""
        return self._before[high + 1] > self._before[np.maximum(low, 0)]

    def open_names(self) -> tuple[np.ndarray, np.ndarray]:
        """(names, texts), each once in its text, of the symbols that hold a live window."""
        s = self.symbols
        mine = np.flatnonzero(~self.known & ~self.again)
        mine = mine[self.any_live(s.at[mine], s.at[mine] + s.size[mine] - self.window)]
        return s.name[mine], s.text[mine]

    def known_words(self) -> np.ndarray:
        """Which words stand in a symbol that an earlier document has."""
        return cover(len(self.live), self.symbols.at[self.known], self.symbols.size[self.known])


def cover(n: int, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges of some sizes from at on."""
    edge = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + size, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0
