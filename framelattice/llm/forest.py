"""MinHash near-dedup by an LSH forest: several orders of signatures; rows with a long common prefix are candidates, deeper where many meet."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base, shingles
from .components import components
from .jaccard import Join, _Forest, _unpack, _wanted_sets

BITS = 11  # of a signature's level; a tree's number stands above its levels in one long


@dataclass(frozen=True)
class Forest:
    """words of a shingle; two documents link when 100 * common >= percent * union. Each of `trees` orders has `deep` levels. Rows that share
    `shallow` levels meet, those where more than `crowd` do must share one more, and so on down to `deep`. block: rows that meet in one
    task. turns: pivots that the rows of a crowd are held against before all others are."""

    words: int = 2
    percent: int = 80
    trees: int = 32
    shallow: int = 3
    deep: int = 5
    crowd: int = 32
    block: int = 256
    turns: int = 3

    def __post_init__(self):
        if not 1 <= self.shallow <= self.deep <= 5 or not 1 <= self.trees <= 128:
            raise ValueError("a signature has at most five levels and there are at most 128 trees")

    def missed(self, depth: int) -> float:
        """Chance that a pair at the threshold meets in no tree of this depth."""
        return (1 - (self.percent / 100) ** depth) ** self.trees

    def least(self, n, m):
        """Common shingles that linked sets of these sizes have at least."""
        return -(-(n + m) * self.percent // (100 + self.percent))


def _hashes(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(12)
    return rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def spots(sets: list[np.ndarray], how: Forest) -> np.ndarray:
    """(sets, trees) places of non-empty shingle sets in each tree's order: the tree, then a few bits of each level's least hash."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    out = np.zeros((len(sets), how.trees), np.int64)
    times, plus = _hashes(how.trees * how.deep)
    for k in range(how.trees):
        place = np.full(len(sets), k, np.int64)
        for j in range(k * how.deep, (k + 1) * how.deep):
            least = np.minimum.reduceat(x * times[j] + plus[j], starts)
            place = place << BITS | ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
        out[:, k] = place
    return out


def _placed(docs: DataFrame, how: Forest) -> DataFrame:
    """doc_id, n (set size), d (set digest), spots; a set's spots are given once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set = set()

        def out(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
            digests = [shingles.digest(s) for s in sets]
            new = []
            for i, (s, d) in enumerate(zip(sets, digests)):
                if len(s) and (d, len(s)) not in given:
                    given.add((d, len(s)))
                    new.append(i)
            places = spots([sets[i] for i in new], how).ravel() if new else np.zeros(0, np.int64)
            fresh = np.zeros(len(sets), bool)
            fresh[new] = True
            ends = np.cumsum(np.r_[0, fresh * how.trees]).astype(np.int32)
            return pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.int64()),
                                               pa.ListArray.from_arrays(pa.array(ends), pa.array(places))], ["doc_id", "n", "d", "spots"])

        for b in batches:
            held: list = []
            size = at = 0
            for s in shingles.sets(b.column("text"), how.words):
                held.append(s)
                size += len(s)
                if size > 100_000:
                    yield out(b.column("doc_id").slice(at, len(held)), held)
                    at, held, size = at + len(held), [], 0
            if held:
                yield out(b.column("doc_id").slice(at, len(held)), held)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d long, spots array<long>")


def _leaves(rows: DataFrame, how: Forest) -> DataFrame:
    """leaf, c (its rows), d, n, pivot, m (the leaf's least class and its size) of every row of (d, n, spot) that shares a leaf with another.

    Counting is an aggregate that starts map-side and the rows are joined to the counts, so a crowded prefix is nobody's single task.
    """
    done, rest = [], rows
    for depth in range(how.shallow, how.deep + 1):
        key = F.shiftright("spot", BITS * (how.deep - depth))
        rest = rest.withColumn("key", key)
        sums = rest.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("d", "n")).alias("p")).where("c > 1")
        met = rest.join(sums.hint("merge"), "key").select("spot", "d", "n", "c", (F.col("key") * 8 + depth).alias("leaf"), F.col("p.d").alias("pivot"), F.col("p.n").alias("m"))
        met = base.stored(met, f"depth{depth}")
        last = depth == how.deep
        done.append(met.drop("spot") if last else met.where(F.col("c") <= how.crowd).drop("spot"))
        rest = met.where(F.col("c") > how.crowd).select("d", "n", "spot")
        if not last and rest.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _fit(n: str, m: str, how: Forest) -> Column:
    """Sets of these sizes may link."""
    return (F.col(n) * 100 >= F.col(m) * how.percent) & (F.col(m) * 100 >= F.col(n) * how.percent)


def _sets(docs: DataFrame, wanted: DataFrame, how: Forest) -> DataFrame:
    """d, n, s: the whole sets of the classes (d, n) wanted."""
    found = _wanted_sets(docs, Join(words=how.words), wanted.select("d"))
    return base.stored(found.join(wanted.select("d", "n").distinct().hint("merge"), ["d", "n"], "left_semi").dropDuplicates(["d", "n"]), "sets")


def _confirmed(docs: DataFrame, pairs: DataFrame, how: Forest) -> DataFrame:
    """The pairs (d, n, pivot, m) whose whole sets link, as (a, b). Pairs meet by pivot, some blocks of them at a time."""
    sets = _sets(docs, pairs.select("d", "n").unionByName(pairs.select(F.col("pivot").alias("d"), F.col("m").alias("n"))).distinct(), how)
    blocks = pairs.groupBy("pivot", "m").agg(F.ceil(F.count("*") / how.block).cast("int").alias("blocks"))
    asking = pairs.join(blocks, ["pivot", "m"]).select("pivot", "d", "n", F.pmod(F.xxhash64("d", "n"), "blocks").cast("int").alias("cell"), F.lit(False).alias("head"))
    heads = blocks.select("pivot", F.col("pivot").alias("d"), F.col("m").alias("n"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("cell"), F.lit(True).alias("head"))
    seats = asking.unionByName(heads).join(sets.hint("merge"), ["d", "n"])

    def test(t: pa.Table) -> pa.Table:
        """A pivot's digest may by accident stand for sets of two sizes: each is tried."""
        sets, d = [_unpack(x) for x in t["s"].to_pylist()], t["d"].to_pylist()
        head = t["head"].to_pylist()
        linked = [(d[i], d[h]) for h in range(len(d)) if head[h] for i in range(len(d))
                  if not head[i] and len(np.intersect1d(sets[h], sets[i], assume_unique=True)) >= how.least(len(sets[h]), len(sets[i]))]
        return pa.table({"a": pa.array([a for a, _ in linked], pa.int64()), "b": pa.array([b for _, b in linked], pa.int64())})

    return seats.groupBy("pivot", "cell").applyInArrow(test, "a long, b long")


def links_among(sets: list[np.ndarray], asks: np.ndarray, how: Forest) -> list[tuple[int, int]]:
    """Linked (asking, other) rows: common shingles are counted through an index of the rows' shingles."""
    size = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    out = []
    for i in np.flatnonzero(asks):
        lo, hi = np.searchsorted(tokens, sets[i], "left"), np.searchsorted(tokens, sets[i], "right")
        run = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(run)[:-1]], run) + np.arange(run.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        common[i] = 0
        out += [(int(i), int(j)) for j in np.flatnonzero(common >= how.least(size[i], size))]
    return out


def spanning(pairs: list[tuple[int, int]], rows: int, connected: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that connect what is not yet connected; the rows marked are from the start."""
    trees = _Forest(rows)
    known = np.flatnonzero(connected).tolist()
    for i in known[1:]:
        trees.join(known[0], i)
    return [(i, j) for i, j in pairs if trees.join(i, j)]


def _still_open(asks: DataFrame, found: DataFrame) -> DataFrame:
    """Classes (d, n) that are not yet in the component `main` that they are held against; mains are named anew by what has been found."""
    mains = found.select(F.col("node").alias("main"), F.col("root").alias("now"))
    named = asks.join(mains.hint("merge"), "main", "left").withColumn("main", F.coalesce("now", "main")).drop("now")
    labels = found.select(F.col("node").alias("d"), F.col("root").alias("label"))
    return named.join(labels.hint("merge"), "d", "left").where(F.coalesce("label", "d") != F.col("main")).select("main", "d", "n").distinct()


def _members(asks: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """main, d, n of all classes of the components that are asked."""
    mains = asks.select("main").distinct()
    inside = mains.join(found.withColumnRenamed("root", "main").hint("merge"), "main").select("main", F.col("node").alias("d")).unionByName(mains.withColumn("d", F.col("main"))).distinct()
    return inside.join(sizes.hint("merge"), "d")


def _crowds(docs: DataFrame, asks: DataFrame, members: DataFrame, how: Forest) -> DataFrame:
    """Links of what the drawn members left open, as (a, b): the asking classes are held, in blocks, against all blocks of each other and of
    the main component's members, which are connected already."""
    rows = members.withColumn("asks", F.lit(0)).unionByName(asks.withColumn("asks", F.lit(1)))
    rows = base.stored(rows.groupBy("main", "d", "n").agg(F.max("asks").alias("asks")), "crowded")
    sizes = rows.groupBy("main").agg(F.ceil(F.count("*") / how.block).cast("int").alias("blocks"), F.ceil(F.sum("asks") / how.block).cast("int").alias("asking"))
    known = rows.join(sizes, "main").withColumn("cell", F.pmod(F.xxhash64("d"), "blocks").cast("int")).withColumn("ask", F.pmod(F.xxhash64("d", F.lit(1)), "asking").cast("int"))
    held = known.select("main", "d", "n", "cell", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("ask"), (F.col("asks") == 0).alias("inside"), F.lit(False).alias("asks"))
    asking = known.where("asks = 1").select("main", "d", "n", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("cell"), "ask", F.lit(False).alias("inside"), F.lit(True).alias("asks"))
    seats = held.unionByName(asking).join(_sets(docs, rows.select("d", "n"), how).hint("merge"), ["d", "n"])

    def meet(t: pa.Table) -> pa.Table:
        d = t["d"].to_numpy()
        asks, inside = (t[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("asks", "inside"))
        pairs = spanning(links_among([_unpack(x) for x in t["s"].to_pylist()], asks, how), len(d), inside)
        return pa.table({"a": pa.array([d[i] for i, _ in pairs], pa.int64()), "b": pa.array([d[j] for _, j in pairs], pa.int64())})

    return seats.groupBy("main", "cell", "ask").applyInArrow(meet, "a long, b long").where("a != b").distinct()


def _labelled(leaves: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the leaves with their component so far as label."""
    return leaves.join(found.select(F.col("node").alias("d"), F.col("root").alias("label")).hint("merge"), "d", "left").withColumn("label", F.coalesce("label", "d"))


def link(docs: DataFrame, how: Forest = Forest()) -> DataFrame:
    """doc_id, n_shingles (size of the shingle set), component_id (smallest doc_id that links reach, itself included), kept.

    1. Equal sets are one class, named by a 64-bit digest and the size; copies are never paired.
    2. A class has a place in each tree's order. Where few share `shallow` levels, they are a leaf; a crowd is told apart by more levels.
    3. Each class is held against the pivot (least class) of most of its leaves: what links makes first components.
    4. In leaves that still hold several components, rows of different ones are held against each other: in small leaves pair by pair, each pair
       once whatever the number of trees; in crowded ones of full depth rows outside the commonest component are held against some
       members of it, then, if still open, in blocks against all of it.
    5. Links are confirmed on whole sets only. A pair at the threshold meets in no tree with probability missed(depth): 1e-10 at three
       levels, 3e-6 at five, and most pairs have other ways to the same component.

    Null and empty texts, and texts without words, have no shingles and their own id; null ids take part, and a component of null ids
    alone has none (kept: all of it); repeated rows give repeated rows; an empty table none; other columns are ignored.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = base.stored(_placed(given, how), "placed")
    classes = rows.where("n > 0 AND size(spots) > 0").groupBy("d", "n").agg(F.first("spots").alias("spots"))
    leaves = _leaves(classes.select("d", "n", F.explode("spots").alias("spot")), how)
    shares = leaves.where(_fit("n", "m", how) & ((F.col("d") != F.col("pivot")) | (F.col("n") != F.col("m")))).groupBy("d", "n", "pivot", "m").agg(F.count("*").alias("k"))
    first = base.stored(shares.groupBy("d", "n").agg(F.max(F.struct("k", "pivot", "m")).alias("p")).select("d", "n", "p.pivot", "p.m"), "first")
    links = base.stored(_confirmed(given, first, how), "links")
    found = base.stored(components(links), "found")
    small = _labelled(leaves.where(F.col("c") <= how.crowd).select("leaf", "d", "n"), found)
    mixed = small.groupBy("leaf").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("leaf")
    small = base.stored(small.join(mixed.hint("merge"), "leaf", "left_semi"), "small")
    other = small.select("leaf", F.col("d").alias("pivot"), F.col("n").alias("m"), F.col("label").alias("other"))
    # At most `crowd` rows a leaf meet here.
    pairs = small.join(other.hint("merge"), "leaf").where((F.col("label") < F.col("other")) & _fit("n", "m", how)).select("d", "n", "pivot", "m").distinct()
    crowded = base.stored(_labelled(leaves.where(F.col("c") > how.crowd).select("leaf", "d", "n"), found), "crowded")
    main = crowded.groupBy("leaf", "label").agg(F.count("*").alias("k")).groupBy("leaf").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    main = main.withColumnRenamed("leaf", "of").hint("merge")
    asks = base.stored(crowded.join(main, (F.col("leaf") == F.col("of")) & (F.col("label") != F.col("main"))).select("main", "d", "n").distinct(), "asks")
    sizes = base.stored(rows.where("n > 0").select("d", "n").distinct(), "sizes")
    if how.turns:
        draws = [F.min_by(F.struct("d", "n"), F.struct(F.xxhash64("d", F.lit(k)), "d")) for k in range(how.turns)]
        drawn = _members(asks, found, sizes).groupBy("main").agg(F.array_distinct(F.array(*draws)).alias("p"))
        drawn = asks.join(drawn.hint("merge"), "main").select("d", "n", F.explode("p").alias("p")).select("d", "n", F.col("p.d").alias("pivot"), F.col("p.n").alias("m"))
        pairs = pairs.unionByName(drawn.where(_fit("n", "m", how))).distinct()
    pairs = base.stored(pairs.join(first.hint("merge"), ["d", "n", "pivot", "m"], "left_anti"), "pairs")
    links = base.stored(links.unionByName(_confirmed(given, pairs, how)), "links")
    if not asks.isEmpty():
        found = base.stored(components(links), "found")
        asks = base.stored(_still_open(asks, found), "asks")
        if not asks.isEmpty():
            links = base.stored(links.unionByName(_crowds(given, asks, _members(asks, found, sizes), how)), "links")
    named = rows.where("n > 0").groupBy("d", "n").agg(F.min("doc_id").alias("own")).join(components(links).withColumnRenamed("node", "d"), "d", "left")
    named = named.withColumn("root", F.coalesce("root", "d"))
    least = named.groupBy("root").agg(F.min("own").alias("component_id"))
    named = named.join(least, "root").select("d", "n", "component_id")
    out = rows.select("doc_id", "n", "d").join(named, ["d", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
