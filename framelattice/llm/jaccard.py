"""N-gram Jaccard join by a token-group matrix: groups of similar documents, their token unions, bounds, opened groups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import base, shingles
from .components import components


@dataclass(frozen=True)
class Join:
    """words of a shingle; two documents link when 100 * common >= percent * union. A token in more than `hot` heads goes last in the
    order of prefixes; at most `hot_most` do, which is a matter of speed alone. block: rows of a group that meet in one task.
    bits: size of the bitmap of wanted documents."""

    words: int = 4
    percent: int = 85
    hot: int = 32
    hot_most: int = 1 << 18
    block: int = 1024
    bits: int = 1 << 24

    def prefix(self, n):
        """Of two linked sets, the first so many tokens of each, in any common order, share one."""
        return n - (n * self.percent + 99) // 100 + 1

    def least(self, n, m):
        """Common tokens that linked sets of these sizes have at least."""
        both = (n + m) * self.percent
        return -(-both // (100 + self.percent))


def _hot_tokens(docs: DataFrame, how: Join) -> np.ndarray:
    """Low halves of the tokens found in the most heads (twice the prefix, by hash): counted over all documents."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part: list = []
            size = 0
            for s in shingles.sets(b.column("text"), how.words):
                part.append(s[:2 * how.prefix(len(s))].astype(np.uint32).view(np.int32))
                size += len(part[-1])
                if size > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part))], ["token"])
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part) if part else np.zeros(0, np.int32))], ["token"])
            del b, part
            base.release()

    counts = docs.select("text").mapInArrow(heads, "token int").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > how.hot)
    top = counts.orderBy(F.desc("n"), "token").limit(how.hot_most)
    return np.sort(np.array([r["token"] for r in top.select("token").collect()], np.int32).view(np.uint32))


def _prefixes(docs: DataFrame, how: Join, hot: np.ndarray) -> DataFrame:
    """doc_id, n (set size), d (set digest), prefix: first tokens of the set with hot ones last."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value

        def is_hot(s: np.ndarray) -> np.ndarray:
            low = s.astype(np.uint32)
            return late[np.minimum(np.searchsorted(late, low), len(late) - 1)] == low if len(late) else np.zeros(len(s), bool)

        for b in batches:
            n, d, parts = [], [], []
            for s in shingles.sets(b.column("text"), how.words):
                want = how.prefix(len(s)) if len(s) else 0
                first = s[:3 * want]
                cold = first[~is_hot(first)]
                if len(cold) < want:
                    flags = is_hot(s)
                    cold = np.concatenate([s[~flags], s[flags]])
                n.append(len(s))
                d.append(shingles.digest(s))
                parts.append(cold[:want].view(np.int64))
            offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d, pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "n", "d", "prefix"])
            del b, parts, flat
            base.release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d long, prefix array<long>")


def _wanted_sets(docs: DataFrame, how: Join, wanted: DataFrame) -> DataFrame:
    """d, n, s (six bytes of each token): whole sets of the documents whose digest falls on a bit of the wanted ones' bitmap. The
    bitmap has a fixed size; a document let through by chance finds no partner in the join that follows."""
    slot = f"cast(pmod(d, {how.bits}) AS int)"
    words = wanted.selectExpr(f"{slot} div 32 AS w", f"shiftleft(1L, {slot} % 32) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    bitmap = np.zeros(how.bits // 32, np.uint32)
    for r in words:
        bitmap[r["w"]] = r["b"]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, given = shared.value, set()
        for b in batches:
            rows: list = []
            for s in shingles.sets(b.column("text"), how.words):
                if not len(s):
                    continue
                d = shingles.digest(s)
                at = d % how.bits
                if bits[at >> 5] >> np.uint32(at & 31) & 1 and (d, len(s)) not in given:
                    given.add((d, len(s)))
                    rows.append((d, len(s), np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()))
                    if len(rows) >= 2000:
                        yield batch(rows)
                        rows = []
            yield batch(rows)
            del b, rows
            base.release()

    def batch(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], ["d", "n", "s"])

    return docs.select("text").mapInArrow(run, "d long, n long, s binary")


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


class _Forest:
    def __init__(self, n: int):
        self.up, self.parts = list(range(n)), n

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        self.parts -= i != j
        return i != j


def open_group(sets: list[np.ndarray], asks: np.ndarray, member: np.ndarray, how: Join, one_root: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect what is linked among the rows of a group: rows that ask are held against all others.

    A row that is no member is first held against the union of the members' tokens; if the bound fails, the group stays closed to it.
    one_root: rows known to be connected already.
    """
    size = np.array([len(s) for s in sets])
    forest, edges = _Forest(len(sets)), []
    if one_root is not None:
        known = np.flatnonzero(one_root)
        for i in known[1:]:
            forest.join(int(known[0]), int(i))
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    inside = member[owner]
    union = np.unique(tokens[inside])
    smallest = int(size[member].min()) if member.any() else 0
    for i in np.flatnonzero(asks):
        if forest.parts == 1:
            break
        s = sets[i]
        if not member[i] and len(union):
            spot = np.minimum(np.searchsorted(union, s), len(union) - 1)
            if (union[spot] == s).sum() < how.least(int(size[i]), smallest):
                continue
        lo, hi = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
        run = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(run)[:-1]], run) + np.arange(run.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        linked = common >= how.least(size[i], size)
        linked[i] = False
        for j in np.flatnonzero(linked):
            if forest.join(int(i), int(j)):
                edges.append((int(i), int(j)))
    return edges


def link(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """doc_id, n_shingles (size of the shingle set), component_id (smallest doc_id that links reach, itself included).

    1. Equal sets are one class, named by a 64-bit digest and the size; copies are never paired.
    2. Tokens are ordered by hash, the commonest last; a class posts its prefix. Tokens posted once are dropped.
    3. Groups: a class joins the pivot (least digest of a token's postings) with which it shares most of its postings, if they are a
       third of what a link needs, else it is a group of its own. The token-group matrix has each group's posted tokens with the range of its
       members' sizes.
    4. A class queries the groups (below its own) with a fitting size of which the matrix has enough of its posted tokens. With its
       whole set the bound on the group's union is taken; only then are the members opened, exactly.
    5. Groups beyond a block are first held against their pivot; what links with it is connected, the rest alone is held against all
       blocks. Components of the links give the result.

    Null and empty texts, and texts without words, have no shingles and their own id; null ids take part, and a component of null ids
    alone has none; repeated rows give repeated rows; an empty table none; other columns are ignored.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = base.stored(_prefixes(given, how, _hot_tokens(given, how)), "prefixes")
    classes = rows.where("n > 0").groupBy("d", "n").agg(F.first("prefix").alias("prefix"))
    by_token = Window.partitionBy("token")
    first = F.min(F.struct("d", "n")).over(by_token)
    posted = classes.select("d", "n", F.explode("prefix").alias("token")).withColumn("pivot", first).withColumn("c", F.count("*").over(by_token))
    posted = base.stored(posted.where("c > 1").select("d", "n", "token", F.col("pivot.d").alias("pivot"), F.col("pivot.n").alias("m")), "posted")
    shares = posted.groupBy("d", "n", "pivot", "m").agg(F.count("*").alias("c"))
    near = _fit("n", "m", "m", how) & (F.col("c") * 3 >= _needed("n", "m", "m", how))
    groups = shares.groupBy("d", "n").agg(F.max_by(F.when(near, F.col("pivot")), F.when(near, F.struct("c", "pivot"))).alias("g"))
    groups = base.stored(groups.withColumn("g", F.coalesce("g", "d")), "groups")
    matrix_rows = posted.drop("pivot", "m").join(groups, ["d", "n"])
    matrix = matrix_rows.groupBy("token", F.col("g").alias("h")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    asking = matrix_rows.join(matrix, "token").where((F.col("h") < F.col("g")) & _fit("n", "least", "most", how))
    asking = asking.groupBy("d", "n", F.col("h").alias("g")).agg(F.count("*").alias("c"), F.min("least").alias("least"), F.max("most").alias("most"))
    asking = asking.where(F.col("c") >= _needed("n", "least", "most", how)).select("d", "n", "g", F.lit(False).alias("member"))
    seats = groups.withColumn("member", F.lit(True)).unionByName(asking)
    crowd = seats.groupBy("g").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / how.block).cast("int"))
    seats = base.stored(seats.join(crowd.drop("rows"), "g"), "seats")
    sets = base.stored(_wanted_sets(given, how, seats.select("d").distinct()).dropDuplicates(["d", "n"]).join(
        seats.select("d", "n").distinct(), ["d", "n"], "left_semi"), "sets")
    full = seats.join(sets, ["d", "n"])
    edges = _open(full.where("blocks = 1").withColumn("cell", F.lit(0)), how)
    if not seats.where("blocks > 1").isEmpty():
        edges = edges.unionByName(_open_large(full.where("blocks > 1"), sets, how))
    found = components(edges.select("a", "b"))
    named = rows.where("n > 0").groupBy("d", "n").agg(F.min("doc_id").alias("own")).join(found.withColumnRenamed("node", "d"), "d", "left")
    named = named.withColumn("root", F.coalesce("root", "d"))
    # Classes of different size never share a digest but by accident; their size keeps them apart unless links join them.
    least = named.groupBy("root").agg(F.min("own").alias("component_id"))
    named = named.join(least, "root").select("d", "n", "component_id")
    out = rows.select("doc_id", "n", "d").join(named, ["d", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """The documents without those whose component has a smaller id, and without repeats of a row's id and text.

    Rows of null id always stay, as do all documents without words (each once). An empty table stays empty.
    """
    found = link(docs, how).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("least"), F.max("component_id").alias("most"))
    names = [f"d{k}" for k in range(len(docs.columns))]
    given = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(docs.columns, names)], F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    # An id with several texts goes only if all of them have smaller partners.
    kept = given.join(found.withColumnRenamed("doc_id", "id"), "id", "left").where("id IS NULL OR most >= id")
    again = F.row_number().over(Window.partitionBy("id", "h").orderBy(F.lit(1)))
    kept = kept.where("id IS NULL").select(*names).unionByName(kept.where("id IS NOT NULL").withColumn("k", again).where("k = 1").select(*names))
    return kept.select(*[F.col(x).alias(c) for c, x in zip(docs.columns, names)])


def _fit(n: str, least: str, most: str, how: Join) -> Column:
    """Some size from least to most may link with size n."""
    return (F.col(least) * how.percent <= F.col(n) * 100) & (F.col(n) * how.percent <= F.col(most) * 100)


def _needed(n: str, least: str, most: str, how: Join) -> Column:
    """Posted tokens that a set of size n shares at least with a linked set of a size from least to most.

    Of two linked sets, call A the one whose prefix ends first in the order. A's prefix tokens that the other has lie in the other's
    prefix, so all but the shared ones of them are missing there: common <= shared + size of A - prefix of A.
    """
    low = f"greatest({least}, ({n} * {how.percent} + 99) div 100)"
    high = f"least({most}, {n} * 100 div {how.percent})"
    common = lambda m: f"(({n} + {m}) * {how.percent} + {99 + how.percent}) div {100 + how.percent}"
    beyond = lambda m: f"(({m} * {how.percent} + 99) div 100 - 1)"  # noqa: E731  size less prefix
    # Where A is the other set, what is needed falls by at most one from the size `high` on down: integer rounding.
    return F.expr(f"greatest(1, least({common(low)} - {beyond(n)}, {common(high)} - {beyond(high)} - 1))")


def _open(seats: DataFrame, how: Join) -> DataFrame:
    def meet(t: pa.Table) -> pa.Table:
        d = t["d"].to_numpy()
        sets = [_unpack(x) for x in t["s"].to_pylist()]
        pairs = open_group(sets, np.ones(len(d), bool), t["member"].to_numpy(zero_copy_only=False).astype(bool), how)
        return pa.table({"a": pa.array([d[i] for i, _ in pairs], pa.int64()), "b": pa.array([d[j] for _, j in pairs], pa.int64())})

    return seats.groupBy("g", "cell").applyInArrow(meet, "a long, b long")


def _open_large(seats: DataFrame, sets: DataFrame, how: Join) -> DataFrame:
    """Groups of several blocks. First every row against the pivot, which is copied to each block; then the rows that do not link with
    it, in blocks, against all blocks: rows linked with the pivot are connected already and need not be held against each other."""
    spread = seats.withColumn("cell", F.pmod(F.xxhash64("d"), "blocks").cast("int"))
    pivots = seats.select("g", "blocks").distinct().join(sets.select(F.col("d").alias("g"), "n", "s"), "g")
    pivots = pivots.select(F.col("g").alias("d"), "n", "g", F.lit(True).alias("member"), "blocks", "s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("cell"))

    def star(t: pa.Table) -> pa.Table:
        d, g = t["d"].to_numpy(), t["g"].to_numpy()
        first = np.flatnonzero(d == g)
        linked = np.zeros(len(d), bool)
        if len(first):
            p = _unpack(t["s"][int(first[0])].as_py())
            for i, x in enumerate(t["s"].to_pylist()):
                s = _unpack(x)
                linked[i] = len(np.intersect1d(p, s, assume_unique=True)) >= how.least(len(p), len(s))
        return pa.table({"g": t["g"], "d": t["d"], "n": t["n"], "linked": pa.array(linked)})

    stars = base.stored(spread.select("g", "cell", "d", "n", "s").unionByName(pivots.select("g", "cell", "d", "n", "s")).groupBy("g", "cell").applyInArrow(
        star, "g long, d long, n long, linked boolean").distinct(), "stars")
    edges = stars.where("linked").select(F.col("g").alias("a"), F.col("d").alias("b"))
    rest = stars.where("NOT linked").groupBy("g").agg(F.count("*").alias("asking")).withColumn("ask_blocks", F.ceil(F.col("asking") / how.block).cast("int"))
    known = seats.join(stars, ["g", "d", "n"]).join(rest.drop("asking"), "g")
    cell = F.pmod(F.xxhash64("d"), "blocks").cast("int")
    ask = F.pmod(F.xxhash64("d", F.lit(1)), "ask_blocks").cast("int")
    held = known.select("g", "d", "n", "s", "member", "linked", cell.alias("cell"), F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("ask"), F.lit(False).alias("asks"))
    asking = known.where("NOT linked").select("g", "d", "n", "s", "member", "linked", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("cell"), ask.alias("ask"), F.lit(True).alias("asks"))

    def meet(t: pa.Table) -> pa.Table:
        d, asks = t["d"].to_numpy(), t["asks"].to_numpy(zero_copy_only=False).astype(bool)
        linked = t["linked"].to_numpy(zero_copy_only=False).astype(bool)
        # The union bound is for whole groups; a block has a part of the members, so rows are held against it directly.
        pairs = open_group([_unpack(x) for x in t["s"].to_pylist()], asks, np.ones(len(d), bool), how, linked & ~asks)
        return pa.table({"a": pa.array([d[i] for i, _ in pairs], pa.int64()), "b": pa.array([d[j] for _, j in pairs], pa.int64())})

    return edges.unionByName(held.unionByName(asking).groupBy("g", "cell", "ask").applyInArrow(meet, "a long, b long"))
