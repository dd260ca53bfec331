"""Periodic runs of words by descending-LCP Kruskal: suffix classes are united by falling common prefix; positions that become neighbours in a
class at a distance within that prefix are a run."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base
from .shingles import _SLICE, _cut_words, _shingles, _slices, mix64, word_hashes


@dataclass(frozen=True)
class Runs:
    """A run of smallest period q has at least `least` words and at least `exponent` periods."""

    exponent: int = 4
    least: int = 6

    def __post_init__(self):
        if self.exponent < 2 or self.least < 3:
            raise ValueError("a run has at least two periods and three words")

    def enough(self, length: int, period: int) -> bool:
        return length >= self.least and length >= self.exponent * period

    @property
    def prefix(self) -> int:
        """Words that the suffixes at a run's start and one period on have in common at least."""
        return min(max(self.least, self.exponent * p) - p for p in range(1, self.least + 1))


class Positions:
    """An ascending set of positions, in blocks, so that adding one moves no more than a block."""

    MOST = 1024

    def __init__(self, first: int):
        self.blocks, self.tops, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for b in self.blocks:
            yield from b

    def add(self, x: int) -> None:
        k = min(bisect_left(self.tops, x), len(self.tops) - 1)
        block = self.blocks[k]
        insort(block, x)
        self.tops[k] = block[-1]
        self.size += 1
        if len(block) > self.MOST:
            half = len(block) // 2
            self.blocks[k:k + 1] = block[:half], block[half:]
            self.tops[k:k + 1] = block[half - 1], block[-1]

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The members before and after the member x."""
        k = bisect_left(self.tops, x)
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else self.blocks[k - 1][-1] if k else None
        after = block[i + 1] if i + 1 < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        return before, after


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, common): the positions whose symbol is no single one, in suffix order, and how many symbols each shares with the one
    before (0: none). By prefix doubling over what is not yet told apart; a position that follows a repeated stretch exists."""
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    new = np.r_[True, s[1:] != s[:-1]]
    starts = np.flatnonzero(new)
    rank = np.empty(len(s), np.int32)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, len(s)]))
    many = ~(new & np.r_[new[1:], True])
    # The sorted positions that share their rank with others; each level halves what may still differ.
    at, places = order[many], np.flatnonzero(many)
    out_at, out_places = at.copy(), places
    levels = []
    k = 1
    while len(at):
        seen = np.sort(at)
        levels.append((k, seen.astype(np.int32), rank[seen]))
        first, second = rank[at], rank[at + k]
        o = np.lexsort((second, first))
        at, first, second = at[o], first[o], second[o]
        out_at[np.searchsorted(out_places, places)] = at
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        starts = np.flatnonzero(new)
        rank[at] = np.repeat(places[starts], np.diff(np.r_[starts, len(at)]))
        many = ~(new & np.r_[new[1:], True])
        at, places, k = at[many], places[many], 2 * k
    common = np.zeros(len(out_at), np.int64)
    here, last = out_at[1:].astype(np.int64), out_at[:-1].astype(np.int64)
    shared = np.zeros(len(here), np.int64)
    for k, seen, ranks in reversed(levels):
        i, j = here + shared, last + shared
        x, y = np.minimum(np.searchsorted(seen, i), len(seen) - 1), np.minimum(np.searchsorted(seen, j), len(seen) - 1)
        shared += k * ((seen[x] == i) & (seen[y] == j) & (ranks[x] == ranks[y]))
    common[1:] = shared
    return out_at, common


def unite(edges: Iterator[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(position, later position, words in common) of positions that become neighbours in a class. edges: (position, position, words in
    common) of suffixes next to each other in their order, by falling number; the smaller class is moved into the larger."""
    up: dict[int, int] = {}
    members: dict[int, Positions] = {}

    def root(i: int) -> int:
        while (p := up.get(i, i)) != i:
            up[i] = up.get(p, p)
            i = p
        return i

    for i, j, words in edges:
        i, j = root(i), root(j)
        big, small = members.get(i) or Positions(i), members.get(j) or Positions(j)
        if big.size < small.size:
            i, j, big, small = j, i, small, big
        up[j], members[i] = i, big
        members.pop(j, None)
        moved = list(small)
        own = set(moved) if len(moved) > 1 else moved
        for x in moved:
            big.add(x)
        for x in moved:
            before, after = big.around(x)
            if before is not None and before not in own:
                yield before, x, words
            if after is not None and after not in own:
                yield x, after, words


def runs_of(words: np.ndarray, text: np.ndarray, how: Runs) -> list[tuple[int, int, int]]:
    """(position, length, period) of all runs of word hashes laid end to end; a run lies within one text."""
    gram = how.prefix
    if len(words) < gram + 1:
        return []
    own = words ^ mix64(text.astype(np.uint64) + np.uint64(1))
    symbols = np.arange(len(words), dtype=np.uint64)  # the last words of a text begin no stretch: symbols of their own
    whole = np.flatnonzero(text[gram - 1:] == text[:len(text) - gram + 1])
    symbols[whole] = _shingles(own, gram)[whole] | np.uint64(1 << 63)
    at, common = suffix_order(symbols)
    if not len(at):
        return []
    shared = common + (gram - 1) * (common > 0)
    # A stretch's positions: without two near enough for its longest common prefix there is no run.
    group = np.cumsum(shared == 0) - 1
    by_place = np.lexsort((at, group))
    gaps = np.where(np.diff(group[by_place]) == 0, np.diff(at[by_place]), 1 << 40)
    starts = np.flatnonzero(np.r_[True, np.diff(group) > 0])
    nearest = np.minimum.reduceat(np.r_[gaps, 1 << 40], starts)
    longest = np.maximum.reduceat(shared, starts)
    open_groups = longest >= (how.exponent - 1) * nearest
    edge = np.flatnonzero((shared > 0) & open_groups[group])
    edge = edge[np.argsort(-shared[edge], kind="stable")]
    out = []
    for i, j, n in unite(zip(at[edge - 1].tolist(), at[edge].tolist(), shared[edge].tolist())):
        period = j - i
        if period <= n and how.enough(n + period, period) and (i == 0 or own[i - 1] != own[j - 1]):
            out.append((i, n + period, period))
    return out


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, beyond the last, word hashes, text of each word from the first on) of pieces of an Arrow column."""
    body, offsets = base.utf8_buffer(column)
    for a, b in _slices(body, offsets):
        part, off = body[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        if b - a == 1 and len(part) > _SLICE:
            h = _cut_words(part)
            yield a, b, h, np.zeros(len(h), np.int64)
        else:
            yield a, b, *word_hashes(part, off)


def find_runs(docs: DataFrame, how: Runs = Runs(), column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents' columns `keep` (all by default) with n_words, runs (array of start, length, period, by start, then period; words from 0)
    and collapsed, the words that no run contains after its first period, joined by one blank.

    A run is a stretch with smallest period q, long enough, that no neighbouring word extends. Words are runs without blanks; null and empty
    texts have none; repeated rows are documents of their own; an empty table gives no rows; input columns named like an output are replaced.
    Texts are worked on whole, about a megabyte of them (or one text) at a time; no shuffle.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "runs", "collapsed")]
    names = [f"d{k}" for k in range(len(kept))]
    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], F.col(f"`{column}`").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = base.raw_texts(batch.column("t"))
            for a, b, h, t in _pieces(batch.column("t")):
                bounds = np.searchsorted(t, np.arange(b - a + 1))
                per: dict[int, list] = {}
                for i, length, period in runs_of(h, t, how):
                    k = int(t[i])
                    per.setdefault(k, []).append((i - int(bounds[k]), length, period))
                ends, found, collapsed = [0], [], []
                for k in range(b - a):
                    words = next(texts).split()
                    here = sorted(per.get(k, ()), key=lambda r: (r[0], r[2]))
                    if here:
                        edges = np.zeros(len(words) + 1, np.int64)
                        for start, length, period in here:
                            edges[start + period] += 1
                            edges[start + length] -= 1
                        words = [w for w, inside in zip(words, np.cumsum(edges).tolist()) if not inside]
                    found += here
                    ends.append(len(found))
                    collapsed.append(b" ".join(words))
                values = np.array(found, np.int64).reshape(-1, 3)
                spans = pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in names], pa.array(np.diff(bounds), pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans), pa.array(collapsed, pa.binary()).cast(pa.string())],
                                                 [*names, "n_words", "runs", "collapsed"])

    new = "n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    fields = [*given.select(*names).schema.fields, *T.StructType.fromDDL(new).fields]
    out = given.mapInArrow(run, T.StructType(fields))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept)], "n_words", "runs", "collapsed")
