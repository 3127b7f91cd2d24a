"""Periodic runs of words in texts, and texts without their repetitions.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least twice q and at least
LEAST words long, that neither neighbouring word extends.

A text's words are ranked by prefix doubling, so that its suffixes stand in order, and the length that each shares with the
one before (its LCP) is found in one pass over the text. Edges between neighbours are then taken by decreasing LCP, as
Kruskal takes them: union-find joins the classes of suffixes that share so many words, each class keeps the ordered set of
its positions, and the smaller set is put into the larger. Two positions that become neighbours in a set at LCP L and lie at
most L apart seed a run: its period is their distance and it ends L words after the later one. It is kept if it can't begin
a word earlier; of seeds with the same beginning and end the least distance is the period. Runs of 12 words or more share 6
words or more with themselves, so only positions whose LEAST / 2 words come again take part.

Work is n log n steps for n words, whatever they are: the ordered sets are kept in blocks. A text is held whole in its task, at about 150
bytes a word. Null and empty texts have no words and no runs; null ids are kept as they are, repeated rows give repeated rows, and other columns play no part. An
empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import map_rows

LEAST, BLOCK = 12, 512


class Positions:
    """An ordered set of numbers, in blocks."""

    def __init__(self, first: int):
        self.heads, self.blocks, self.n = [first], [[first]], 1

    def __len__(self) -> int:
        return self.n

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The members before and after x, which is none itself."""
        b = bisect_right(self.heads, x) - 1
        if b < 0:
            return None, self.heads[0]
        block = self.blocks[b]
        at = bisect_right(block, x)
        after = block[at] if at < len(block) else self.heads[b + 1] if b + 1 < len(self.heads) else None
        return block[at - 1], after

    def add(self, x: int) -> None:
        b = max(0, bisect_right(self.heads, x) - 1)
        block = self.blocks[b]
        block.insert(bisect_right(block, x), x)
        self.heads[b] = block[0]
        self.n += 1
        if len(block) > 2 * BLOCK:
            self.blocks[b : b + 1] = [block[:BLOCK], block[BLOCK:]]
            self.heads.insert(b + 1, block[BLOCK])


def _again(w: np.ndarray, size: int) -> bool:
    """Whether any size words in a row may come twice (surely not, if False)."""
    mixed = (w.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : len(w) - size + 1 + k]
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each i the rank of (a[i], b[i]) among all."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def _later(a: np.ndarray, by: int) -> np.ndarray:
    """a[i + by], all one more, 0 past the end."""
    out = np.zeros(len(a), a.dtype)
    out[: len(a) - by] = a[by:] + 1
    return out


def suffixes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of w's suffixes, and for each the rank of its first 6 words."""
    n = len(w)
    three = _pairs(_pairs(w, _later(w, 1)), _later(w, 2))
    first, h = _pairs(three, _later(three, 3)), 6
    starts = np.concatenate([[0], np.cumsum(np.bincount(first))])
    rank = np.append(starts[first], -1)  # where a suffix's group begins in the order; -1 past the end
    several = np.flatnonzero((starts[1:] - starts[:-1])[first] > 1)
    while len(several):
        after = rank[np.minimum(several + h, n)]
        order = np.lexsort((after, rank[several]))
        several, after = several[order], after[order]
        group = rank[several]
        index = np.arange(len(several))
        new_group = np.append(True, group[1:] != group[:-1])
        new_part = new_group | np.append(True, after[1:] != after[:-1])
        begins = np.maximum.accumulate(np.where(new_group, index, 0))
        part = np.maximum.accumulate(np.where(new_part, index, 0))
        rank[several] = group + part - begins
        alone = new_part & np.append(new_part[1:], True)
        several, h = several[~alone], 2 * h
    order = np.empty(n, np.int64)
    order[rank[:-1]] = np.arange(n)
    return order, first


def runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of a sequence of numbers, by start, then period. least: 12 or more."""
    n = len(words)
    if n < least or not _again(words, 6):
        return []
    order, first = suffixes(words)
    at = np.flatnonzero(first[order[1:]] == first[order[:-1]]) + 1  # edges: to a suffix from the one before it in order
    w = words.tolist()
    lcp = np.zeros(len(at), np.int64)
    l, last = 0, 0
    by_place = np.argsort(order[at])
    for e, i, j in zip(by_place.tolist(), order[at[by_place]].tolist(), order[at[by_place] - 1].tolist()):
        l = max(6, l - (i - last))
        last = i
        end = n - max(i, j)
        while l < end and w[i + l] == w[j + l]:
            l += 1
        lcp[e] = l

    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    place = order.tolist()
    found: dict[tuple[int, int], int] = {}

    def find(k: int) -> int:
        while (p := parent.get(k, k)) != k:
            parent[k] = k = parent.get(p, p)
        return k

    for e in np.argsort(-lcp, kind="stable").tolist():
        k, l = int(at[e]), int(lcp[e])
        a, b = find(k - 1), find(k)
        large = sets.get(a) or Positions(place[a])
        small = sets.get(b) or Positions(place[b])
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        for x in small:
            before, after = large.around(x)
            for i, j in ((before, x), (x, after)):
                if i is None or j is None or j - i > l or j - i + l < least or i and w[i - 1] == w[j - 1]:
                    continue
                period = found.get((i, j + l))
                if period is None or j - i < period:
                    found[i, j + l] = j - i
        for x in small:
            large.add(x)
        parent[b] = a
        sets.pop(b, None)
        sets[a] = large
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """For each of n words whether it stays: all do but those of a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), collapsed: the words of each text that stay, one space between them.

    Words are what stands between ASCII white space. change(id, words), if given, makes the words to look at from a document's own.
    """

    def run(batches):
        for rows in batches:
            out = []
            for k, text in rows:
                words = (text or b"").split()  # of bytes: at ASCII white space alone
                if change:
                    words = change(k, words)
                number = {x: i for i, x in enumerate(dict.fromkeys(words))}
                got = runs(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), least)
                stay = words if not got else [words[i] for i in np.flatnonzero(kept(len(words), got)).tolist()]
                out.append((k, len(words), got, b" ".join(stay)))
            yield out

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    got = map_rows(rows, run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return got.withColumn("collapsed", F.col("collapsed").cast("string"))
