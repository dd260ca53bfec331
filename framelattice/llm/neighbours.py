"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing and exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import base


@dataclass(frozen=True)
class Hashing:
    """tables of `functions` projections each, cut at `width` of the largest norm; `probes` buckets per table and query."""

    tables: int = 10
    functions: int = 4
    width: float = 1.0
    probes: int = 40
    seed: int = 7
    chunk_rows: int = 65536   # rows that a chunk of buckets holds on average
    block_rows: int = 65536  # most rows of a chunk, and most queries, that meet in one task


def perturbations(below: np.ndarray, count: int) -> list[list[tuple[int, int]]]:
    """Up to `count` sets of (function, step), likeliest first. below: the query's distance to each lower cell wall, the
    upper one being 1 - below. A set's score is the sum of its squared distances; sets grow from a heap by shifting or
    extending their last member."""
    n = len(below)
    walls = sorted([(below[i] ** 2, i, -1) for i in range(n)] + [((1 - below[i]) ** 2, i, 1) for i in range(n)])
    found: list = [[]]
    heap = [(walls[0][0], (0,))]
    while heap and len(found) < count:
        score, chosen = heapq.heappop(heap)
        steps = [walls[k][1:] for k in chosen]
        if len({i for i, _ in steps}) == len(steps):
            found.append(steps)
        last = chosen[-1]
        if last + 1 < len(walls):
            heapq.heappush(heap, (score - walls[last][0] + walls[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + walls[last + 1][0], (*chosen, last + 1)))
    return found


def _bucket(cells: np.ndarray) -> np.ndarray:
    """64-bit id of each row of cell numbers."""
    h = np.full(cells.shape[:-1], 1469598103934665603, np.uint64)
    for i in range(cells.shape[-1]):
        h = (h ^ cells[..., i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _valid(vectors: DataFrame, vector: str, dims: int | None = None) -> Column:
    inf = F.lit(float("inf"))
    v = F.col(vector).cast("array<double>")
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok & (F.size(v) == dims) if dims is not None else ok, F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, how: Hashing = Hashing(), vector: str = "embedding") -> DataFrame:
    """The k rows of largest inner product with each query row: query_id, rank (from 1), vec_id, score.

    Inner products become distances by adding a coordinate: rows are scaled by the largest norm and lifted onto the unit
    sphere, queries normalised. Every row is hashed into every table; each query visits its likeliest buckets; candidates of
    all tables are scored on the original vectors, in double. A query whose buckets hold fewer than k rows is held against all, so k come
    back if there are k.

    Null and zero vectors, vectors with null or non-finite components, null ids, and vectors whose length is not the commonest
    (ties: the largest) take no part. Rows that share an id count as one row, with its best score; equal scores go by
    the smaller id. An empty table gives no rows; other columns are ignored. Chunks of buckets are split into blocks of rows
    and of queries, so a crowded bucket is no single task.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    good = vectors.where(F.col("vec_id").isNotNull() & _valid(vectors, vector))
    lengths = good.groupBy(F.size(vector).alias("n")).agg(
        F.count("*").alias("rows"), F.max(F.sqrt(F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))
    common = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims, total, top = common["n"], common["rows"], float(common["norm"])
    chunks = -(-total // how.chunk_rows)
    narrow = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    dtype = np.dtype("<f4" if narrow else "<f8")
    rng = np.random.default_rng(how.seed)
    axes = rng.standard_normal((how.tables, dims + 1, how.functions))
    shift = rng.random((how.tables, 1, how.functions))
    rows = vectors.where(F.col("vec_id").isNotNull() & _valid(vectors, vector, dims)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        flat = b.column("v").flatten() if hasattr(b.column("v"), "flatten") else b.column("v").values
        return flat.to_numpy(zero_copy_only=False).reshape(-1, dims)

    def blobs(x: np.ndarray) -> list[bytes]:
        return [r.tobytes() for r in np.ascontiguousarray(x, dtype)]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b)
            unit = x.astype(float) / top
            lifted = np.hstack([unit, np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))[:, None]])
            data, ids = pa.array(blobs(x), pa.binary()), b.column("vec_id")
            for t in range(how.tables):
                key = _bucket(np.floor(lifted @ axes[t] / how.width + shift[t]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array((key % chunks).astype(np.int32)), pa.array(key), ids, data],
                                                 ["t", "chunk", "bucket", "vec_id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b)
            unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
            lifted = np.hstack([unit, np.zeros((len(x), 1))])
            data, ids = blobs(x), b.column("vec_id").to_pylist()
            out: list = []
            for t in range(how.tables):
                at = lifted @ axes[t] / how.width + shift[t]
                cell = np.floor(at).astype(np.int64)
                for i in range(len(x)):
                    sets = perturbations(at[i] - cell[i], how.probes)
                    near = np.repeat(cell[i][None], len(sets), 0)
                    for r, steps in enumerate(sets):
                        for f, d in steps:
                            near[r, f] += d
                    keys = _bucket(near)
                    where = keys % chunks
                    out += [(t, int(c), ids[i], data[i], keys[where == c].tolist()) for c in np.unique(where)]
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, y) for c, y in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())))],
                ["t", "chunk", "query_id", "qv", "buckets"])

    indexed = rows.select("vec_id", "v").mapInArrow(index, "t int, chunk int, bucket long, vec_id long, v binary")
    probes = base.stored(rows.where("q").select("vec_id", "v").mapInArrow(probe, "t int, chunk int, query_id long, qv binary, buckets array<long>"), "probes")
    def meet(lt: pa.Table, rt: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if lt.num_rows and rt.num_rows:
            order = np.argsort(bucket := lt["bucket"].to_numpy(), kind="stable")
            names, starts = np.unique(bucket[order], return_index=True)
            ends = np.r_[starts[1:], len(order)]
            x = np.frombuffer(b"".join(lt["v"].to_pylist()), dtype).reshape(-1, dims)[order].astype(float)
            ids = lt["vec_id"].to_numpy()[order]
            qx = np.frombuffer(b"".join(rt["qv"].to_pylist()), dtype).reshape(-1, dims).astype(float)
            qids = rt["query_id"].to_numpy()
            flat = rt["buckets"].combine_chunks()
            lengths = np.diff(np.asarray(flat.offsets))
            visit = flat.flatten().to_numpy()
            who = np.repeat(np.arange(len(qids)), lengths)
            spot = np.searchsorted(names, visit)
            hit = (spot < len(names)) & (names[np.minimum(spot, len(names) - 1)] == visit)
            who, spot = who[hit], spot[hit]
            by_query = np.argsort(who, kind="stable")
            who, spot = who[by_query], spot[by_query]
            marks = np.searchsorted(who, np.arange(len(qids) + 1))
            for i in range(len(qids)):
                mine = spot[marks[i]:marks[i + 1]]
                if not len(mine):
                    continue
                take = np.concatenate([np.arange(starts[j], ends[j]) for j in mine])
                take = take[ids[take] != qids[i]]
                if not len(take):
                    continue
                s = x[take] @ qx[i]
                if len(take) > k:
                    # Rough products pick, exact ones rank; ties with the last one stay until ids decide.
                    keep = s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9 * max(1.0, float(np.abs(s).max()))
                    take = take[keep]
                exact = (x[take] * qx[i]).sum(1)
                best = np.lexsort((ids[take], -exact))
                _, firsts = np.unique(ids[take][best], return_index=True)
                best = best[np.sort(firsts)[:k]]
                out_q.append(np.full(len(best), qids[i]))
                out_v.append(ids[take][best])
                out_s.append(exact[best])
        join = lambda p, d: np.concatenate(p) if p else np.zeros(0, d)
        return pa.table({"query_id": pa.array(join(out_q, np.int64), pa.int64()), "vec_id": pa.array(join(out_v, np.int64), pa.int64()),
                         "score": pa.array(join(out_s, float), pa.float64())})

    def search(indexed: DataFrame, probes: DataFrame) -> DataFrame:
        """Best rows of each query within each block of a chunk."""
        key, grid = ["t", "chunk"], ["t", "chunk", "rb", "qb"]
        blocks = indexed.groupBy(key).agg(F.ceil(F.count("*") / how.block_rows).cast("int").alias("row_blocks")).join(
            probes.groupBy(key).agg(F.ceil(F.count("*") / how.block_rows).cast("int").alias("query_blocks")), key)
        left = indexed.join(blocks, key).withColumn("rb", (F.pmod(F.xxhash64("vec_id"), "row_blocks")).cast("int")).withColumn(
            "qb", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).drop("row_blocks", "query_blocks")
        right = probes.join(blocks, key).withColumn("qb", (F.pmod(F.xxhash64("query_id"), "query_blocks")).cast("int")).withColumn(
            "rb", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1))).drop("row_blocks", "query_blocks")
        found = left.groupBy(grid).cogroup(right.groupBy(grid)).applyInArrow(meet, "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = b.num_rows
                chunk = pa.array((b.column("vec_id").to_numpy() % chunks).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), chunk, pa.array(np.zeros(n, np.int64)), b.column("vec_id"), pa.array(blobs(matrix(b)), pa.binary())],
                                                 ["t", "chunk", "bucket", "vec_id", "v"])

    best = base.stored(search(indexed, probes), "found")
    # Queries whose buckets hold fewer than k rows are held against all rows.
    short = probes.select("query_id", "qv").distinct().join(best.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k)
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    short = base.stored(short.select(F.lit(-1).alias("t"), every, "query_id", "qv", F.array(F.lit(0).cast("bigint")).alias("buckets")), "short")
    if not short.isEmpty():
        all_rows = rows.select("vec_id", "v").mapInArrow(whole, "t int, chunk int, bucket long, vec_id long, v binary")
        best = best.unionByName(search(all_rows, short)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
