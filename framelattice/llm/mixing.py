"""Mixing sources to target weights: fixed-length word blocks, multinomial shard counts, index permutations, joins by index."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import base


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in code-point order (null last). The mix has `share` of all words; no source gives more
    than `repeats` times its words. block: words of a block (the last of a source may be shorter)."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    repeats: float = 2.0
    block: int = 256
    shards: int = 64
    chunks: int = 256
    seed: int = 11


def targets(sizes: list[int], how: Mix) -> list[float]:
    """Words asked of each source: shares by weight; what exceeds a source's cap is shared again among the others."""
    caps = [how.repeats * s for s in sizes]
    weights = [how.weights[i % len(how.weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), how.share * sum(sizes)
    while free:
        per = left / (sum(weights[i] for i in sorted(free)) or 1.0)
        over = [i for i in sorted(free) if per * weights[i] > caps[i]]
        if not over:
            for i in free:
                out[i] = per * weights[i]
            break
        for i in over:
            out[i] = caps[i]
            left -= caps[i]
            free.discard(i)
    return out


def shard_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard: multinomial draws without replacement from what each source still has to give,
    so the shards vary as draws do while the sources' totals are exact."""
    rng = np.random.default_rng(seed)
    left, out = np.array(slots, np.int64), np.zeros((shards, len(slots)), np.int64)
    for k in range(shards):
        size = int(left.sum()) // (shards - k)
        draw = np.zeros(len(left), np.int64)
        need = size
        # Multinomial rounds, each bounded by what is left; what a source cannot give is drawn again.
        while need > 0:
            p = (left - draw) / (left - draw).sum()
            got = np.minimum(rng.multinomial(need, p), left - draw)
            draw += got
            need = size - int(draw.sum())
        out[k], left = draw, left - draw
    return out


def permuted(index, size, key):
    """A pseudorandom permutation of 0..size-1 chosen by key, on Arrow arrays or pandas series: a Feistel network over the next power
    of four; values beyond the size walk on along their cycle until they fall within."""
    x, n, seed = (np.array(c, np.int64).view(np.uint64) for c in (index, size, key))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            h = (right + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) ^ seed[todo]
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, (left ^ (h ^ (h >> np.uint64(31)))) & mask[todo]
        x[todo] = left << half[todo] | right
        todo = x >= n
    out = x.view(np.int64)
    return pa.array(out) if isinstance(index, pa.Array) else type(index)(out)


def _permute(index: pa.Array, size: pa.Array, key: pa.Array) -> pa.Array:
    return permuted(index, size, key)


def lay_out(docs: DataFrame, how: Mix) -> tuple[DataFrame, DataFrame]:
    """(documents with columns d0, d1, ... for the given ones, source_no, size, source_size, target and start, their first
    word in their source's stream; slots of the mix: shard, place, source_no, epoch, block).

    A source's stream has its documents by chunk of the id's hash, then id, length and content hash. Offsets are sums within
    chunks added to sums of whole chunks, so no source is a single task. Only the sources' totals come to the driver.
    """
    spark = docs.sparkSession
    sized = docs.select(*[F.col(f"`{c}`").alias(f"d{k}") for k, c in enumerate(docs.columns)], F.col("source").cast("string").alias("source"),
                        F.col("doc_id").alias("id"), base.word_count("text").alias("size"), F.xxhash64("text").alias("hash"),
                        F.pmod(F.xxhash64("doc_id"), F.lit(how.chunks)).cast("int").alias("chunk"))
    sums = base.stored(sized.groupBy("source", "chunk").agg(F.sum("size").alias("words")), "chunks")
    per = sorted(sums.groupBy("source").agg(F.sum("words").alias("words")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["words"]) for r in per]
    goal = targets(sizes, how)
    blocks = [-(-s // how.block) for s in sizes]
    # The last block of a source is short, so slots are counted in blocks of the source's mean size.
    slots = [min(round(g * b / s), int(how.repeats * b)) if s else 0 for g, s, b in zip(goal, sizes, blocks)]
    # More slots make more shards, not larger ones, up to a number whose counts are no burden to the driver.
    shards = max(1, min(how.shards, sum(slots) // 256)) if sum(slots) < how.shards * 4096 else min(8192, sum(slots) // 4096)
    counts = shard_counts(slots, shards, how.seed)
    before = np.vstack([np.zeros((1, len(slots)), np.int64), np.cumsum(counts, 0)])
    # Arrow tables reach Spark without a Python worker; rows would start one more daemon on the executors, which stays.
    known = spark.createDataFrame(pa.table({"source_no": pa.array(range(len(per)), pa.int32()), "source": pa.array([r["source"] for r in per], pa.string()),
                                            "source_size": pa.array(sizes, pa.int64()), "target": pa.array(goal, pa.float64())}))
    first = F.sum("words").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("source", "chunk", F.coalesce(first, F.lit(0)).alias("first")).alias("s").join(
        known.alias("k"), F.col("s.source").eqNullSafe(F.col("k.source"))).select("s.*", "source_no", "source_size", "target")
    # Sources x chunks rows: as many times `chunks` as there are sources on the driver.
    within = F.sum("size").over(Window.partitionBy("source", "chunk").orderBy("id", "size", "hash").rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.withColumn("within", F.coalesce(within, F.lit(0))).alias("d").join(
        F.broadcast(starts).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.chunk") == F.col("s.chunk")))
    placed = placed.select(*[f"d{k}" for k in range(len(docs.columns))], "size", "source_no", "source_size", "target",
                           (F.col("first") + F.col("within")).alias("start"))
    k, i = np.nonzero(counts)
    slot = spark.createDataFrame(pa.table({"shard": pa.array(k, pa.int32()), "source_no": pa.array(i, pa.int32()), "begin": pa.array(before[k, i]),
                                           "n": pa.array(counts[k, i]), "blocks": pa.array(np.array(blocks, np.int64)[i])})).repartition(
        spark.sparkContext.defaultParallelism).select("shard", "source_no", "blocks", F.explode(F.expr("sequence(begin, begin + n - 1)")).alias("k"))
    slot = slot.withColumn("epoch", F.floor(F.col("k") / F.col("blocks"))).withColumn("nth", F.col("k") % F.col("blocks"))
    # Not deterministic by name: else the join's filter on blocks runs it again, in as many Python workers more.
    block = F.arrow_udf(_permute, "long").asNondeterministic()
    slot = slot.withColumn("block", block("nth", "blocks", F.xxhash64("source_no", "epoch", F.lit(how.seed))))
    return placed, slot.select("shard", F.xxhash64("source_no", "k", F.lit(how.seed)).alias("place"), "source_no", "epoch", "block")


def _pieces(placed: DataFrame, how: Mix) -> DataFrame:
    """A row per document and block that it lies in: n words from the word `begin` of the document on."""
    last = F.floor((F.col("start") + F.col("size") - 1) / how.block)
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / how.block), last)))
    begin = F.greatest(F.col("start"), F.col("block") * how.block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * how.block)
    return cut.withColumn("begin", begin - F.col("start")).withColumn("n", end - begin)


def mix(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """Every document with its size, its source's size and target, and `taken`, the words that the mix takes of it.

    A word is a run without blanks; null texts have none. A null source is a source. Repeated rows and ids are documents of
    their own. An empty table gives no rows. Other columns stay; those named like an output are replaced.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    if docs.isEmpty():
        return docs.select(*kept).selectExpr("*", "0L AS size", "0L AS source_size", "0D AS target", "0L AS taken")
    placed, slots = lay_out(docs.select(*kept), how)
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    spans = _pieces(placed.select("source_no", "start", "size"), how)
    # Block tables grow with the data: never broadcast. Among documents with words, a first word belongs to one document.
    taken = spans.join(times.hint("merge"), ["source_no", "block"]).groupBy("source_no", F.col("start").alias("key")).agg(F.sum(F.col("times") * F.col("n")).alias("taken"))
    out = placed.withColumn("key", F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.abs(F.hash("d0").cast("long")))).join(taken, ["source_no", "key"], "left")
    return out.select(*[F.col(f"d{k}").alias(c) for k, c in enumerate(kept)], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix_texts(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """The mix itself: rows like the documents', one per document and slot that takes words of it, in shard order. text has the
    words taken with what stands between and after them, n_chars its length. Nulls, ties and empty tables as in mix()."""
    if docs.isEmpty():
        return docs
    placed, slots = lay_out(docs, how)
    text = F.col(f"d{docs.columns.index('text')}")
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    first, last = F.floor(F.col("start") / how.block), F.floor((F.col("start") + F.col("size") - 1) / how.block)

    def pieces(ws: Column) -> Column:
        """The document's words in each block it lies in."""

        def piece(b: Column) -> Column:
            begin = F.greatest(F.col("start"), b * how.block)
            n = F.least(F.col("start") + F.col("size"), (b + 1) * how.block) - begin
            return F.struct(b.alias("block"), F.array_join(F.slice(ws, (begin - F.col("start") + 1).cast("int"), n.cast("int")), "").alias("piece"))

        return F.transform(F.sequence(first, last), piece)

    # A one-element transform binds the words, so that a text is cut once however many blocks it has.
    cut = placed.where("size > 0").withColumn("p", F.explode(F.get(F.transform(F.array(words), pieces), F.lit(0)))).select("*", "p.block", "p.piece")
    mixed = slots.hint("merge").join(cut, ["source_no", "block"]).repartition("shard").sortWithinPartitions("shard", "place", "start")
    new = {"text": F.col("piece"), "n_chars": F.char_length("piece").cast("long")}
    return mixed.select(*[new.get(c, F.col(f"d{k}")).alias(c) for k, c in enumerate(docs.columns)])
