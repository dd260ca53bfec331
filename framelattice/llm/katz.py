"""Katz backoff language model over words: Good-Turing discounted bigram counts, exactly normalised backoff weights.

P(w | v) = d(r) r / c(v) for a bigram seen r times in training, else alpha(v) P(w). alpha(v) is what the discounts leave divided by the unigram
mass of the words not seen after v, so every history sums to one. P(w) is Good-Turing too: seen words share 1 - n1/N by their own counts,
which a join brings to each bucket for the distinct words in it; no task holds the whole vocabulary. All words that training lacks are one
class, which has the rest, so the sum over the vocabulary and that class is one.

Texts become bigrams (history, word) with the documents they stand in, packed by slice of documents and bucket of history and written once as
a bucketed table. Counting and scoring read that table bucket by bucket without a shuffle. A history too common for a bucket is spread by its
next word. What a bucket sends back has one value a distinct bigram of a slice, so it grows as the text does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelattice.common import checkpoint_root

from . import base
from .shingles import _SLICE, _cut_words, _slices, mix64, word_hashes

BEGIN, END = np.uint64(1), np.uint64(2)  # keys of the marks before the first word and after the last
FINE = float(1 << 27)  # parts of a unit of log10 in which a bigram's probability is sent back: exact to 4e-9
_SLICE_BYTES, _SLICE_DOCS = 10 << 20, 30_000


@dataclass(frozen=True)
class Katz:
    """bucket_bytes: text whose events share a bucket, on average. discounted: counts up to this are discounted."""

    bucket_bytes: int = 10 << 20
    discounted: int = 5


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first text, beyond the last, word hashes, text of each word from the first on, bytes) of pieces of an Arrow column."""
    body, offsets = base.utf8_buffer(column)
    for a, b in _slices(body, offsets):
        part = body[offsets[a]:offsets[b]]
        if b - a == 1 and len(part) > _SLICE:
            h = _cut_words(part)
            t = np.zeros(len(h), np.int64)
        else:
            h, t = word_hashes(part, offsets[a:b + 1] - offsets[a])
        yield a, b, h, t, len(part)


def _common(docs: DataFrame, buckets: int) -> dict[int, int]:
    """Words that may fill a bucket by themselves, with the number of buckets to spread them over. A word below a quarter of a bucket's
    share of every slice cannot; the rest are summed over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, h, _, _ in _tokens(b.column("text")):
                w, n = np.unique(h, return_counts=True)
                keep = n * 4 * buckets > len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[w[keep], np.uint64(0)].view(np.int64)), pa.array(np.r_[n[keep], len(h)])], ["w", "n"])

    sums = docs.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    total = sums.where("w = 0").agg(F.sum("n")).first()[0] or 0
    # At most 4 * buckets words have a quarter of a bucket's share.
    got = sums.where((F.col("w") != 0) & (F.col("n") * 2 * buckets > total)).collect()
    return {r["w"] & (1 << 64) - 1: -(-r["n"] * buckets // total) + 1 for r in got}


def _events(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket (-1: a slice's documents), hot, slice, payload (see _pack): the distinct bigrams of a slice's documents that belong to a bucket."""
    spread = _common(docs, buckets)
    hot_keys = np.array(sorted(spread), np.uint64)
    hot_width = np.array([spread[k] for k in sorted(spread)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        marks: list = []
        words: list = []
        owners: list = []
        size = 0

        def out():
            nonlocal number, size
            n = len(ids)
            train = np.array(marks, bool)
            w = np.concatenate(words) if words else np.zeros(0, np.uint64)
            d = np.concatenate(owners) if owners else np.zeros(0, np.int64)
            # Every document's words, then the end; the history of its first is the beginning.
            order = np.argsort(np.r_[d, np.arange(n)], kind="stable")
            word, doc = np.r_[w, np.full(n, END)][order], np.r_[d, np.arange(n)][order]
            history = np.r_[BEGIN, word[:-1]]
            history[np.r_[True, doc[1:] != doc[:-1]]] = BEGIN
            hot = np.zeros(len(word), bool)
            home = history % np.uint64(buckets)
            if len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, history), len(hot_keys) - 1)
                hot = hot_keys[at] == history
                home = np.where(hot, (home + mix64(word ^ np.uint64(77)) % hot_width[at]) % np.uint64(buckets), home)
            begins = history == BEGIN  # one for each document: spread like a common word over all buckets
            hot |= begins
            home = np.where(begins, mix64(word ^ np.uint64(78)) % np.uint64(buckets), home)
            key = home << np.uint64(33) | hot.astype(np.uint64) << np.uint64(32) | history >> np.uint64(32)
            order = np.lexsort((word, key))
            history, word, tag, key = history[order], word[order], (doc + (train[doc] << 15)).astype(np.uint16)[order], key[order] >> np.uint64(32)
            edges = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)] if len(key) else np.zeros(1, int)
            where, kind, loads = [-1], [False], [np.array([-1 if i is None else i for i in ids], np.int64).tobytes() + np.bincount(d, minlength=n).astype(np.int64).tobytes() + np.array([i is None for i in ids], bool).tobytes()]
            for a, b in zip(edges[:-1], edges[1:]):
                where.append(int(key[a] >> np.uint64(1)))
                kind.append(bool(key[a] & np.uint64(1)))
                loads.append(_pack(history[a:b], word[a:b], tag[a:b]))
            batch = pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(kind), pa.array([task + number] * len(where), pa.int64()), pa.array(loads, pa.binary())],
                                               ["bucket", "hot", "slice", "payload"])
            number, size = number + 1, 0
            for x in (ids, marks, words, owners):
                x.clear()
            base.release()
            return batch

        for b in batches:
            doc_ids, flags = b.column("doc_id").to_pylist(), b.column("train").to_pylist()
            for a, z, h, t, n in _tokens(b.column("text")):
                if ids and (size + n > _SLICE_BYTES or len(ids) + z - a > _SLICE_DOCS):
                    yield out()
                owners.append(t + len(ids))
                words.append(h)
                ids += doc_ids[a:z]
                marks += flags[a:z]
                size += n
        if ids:
            yield out()

    return docs.mapInArrow(run, "bucket int, hot boolean, slice long, payload binary")


def _pack(history: np.ndarray, word: np.ndarray, tag: np.ndarray) -> bytes:
    """Sorted events as: numbers of histories, bigrams, events and long bigrams; histories; words (five bytes); then the tail: bigrams of
    each history, events of each bigram (a byte; 255: see the long ones), and each event's document in the slice, its top bit set in training."""
    new = np.r_[True, (history[1:] != history[:-1]) | (word[1:] != word[:-1])]
    first = np.flatnonzero(new)
    times = np.diff(np.r_[first, len(word)])
    h = history[first]
    begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    five = np.ascontiguousarray(word[first].view(np.uint8).reshape(-1, 8)[:, :5])
    long = times[times >= 255].astype(np.uint32)
    return b"".join(x.tobytes() for x in (np.array([len(begin), len(first), len(word), len(long)], np.int64), h[begin], five, np.diff(np.r_[begin, len(h)]).astype(np.uint32),
                                          np.minimum(times, 255).astype(np.uint8), long, tag))


def _tail(load: bytes, at: int, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bigrams of each history, events of each bigram, tags) of a payload whose tail begins at a byte."""
    n, m, events, more = head.tolist()
    runs = np.frombuffer(load, np.uint32, n, at)
    times = np.frombuffer(load, np.uint8, m, at + 4 * n).astype(np.int64)
    times[times == 255] = np.frombuffer(load, np.uint32, more, at + 4 * n + m)
    return runs, times, np.frombuffer(load, np.uint16, events, at + 4 * n + m + 4 * more)


def _read(t: pa.Table) -> tuple:
    """History, word and training count of each slice's bigrams in a bucket, the payloads, and where each payload's bigrams begin."""
    loads = t["payload"].to_pylist()
    heads = [np.frombuffer(x, np.int64, 4) for x in loads]
    ends = np.cumsum([0, *(int(h[1]) for h in heads)])
    history, word, count = np.empty(ends[-1], np.uint64), np.zeros((ends[-1], 8), np.uint8), np.empty(ends[-1], np.int64)
    for x, head, a, b in zip(loads, heads, ends[:-1], ends[1:]):
        n, m = int(head[0]), int(head[1])
        runs, times, tags = _tail(x, 32 + 8 * n + 5 * m, head)
        history[a:b] = np.repeat(np.frombuffer(x, np.uint64, n, 32), runs)
        word[a:b, :5] = np.frombuffer(x, np.uint8, 5 * m, 32 + 8 * n).reshape(m, 5)
        count[a:b] = np.add.reduceat(tags >> 15, np.r_[0, np.cumsum(times)[:-1]], dtype=np.int64)
    return history, word.view(np.uint64).ravel(), count, loads, ends


def _pairs(history: np.ndarray, word: np.ndarray, count: np.ndarray) -> tuple:
    """Distinct bigrams of all slices: (index of one of each, which each is, training count)."""
    key = word * np.uint64(0x9E3779B97F4A7C15)
    key += history
    key = mix64(key)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    del key
    first = order[new]
    of = np.empty(len(order), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    del order
    return first, of, np.bincount(of, count, len(first)).astype(np.int64)


@dataclass
class Unigrams:
    """Ascending keys and counts of training words, and the totals over all of them."""

    keys: np.ndarray
    counts: np.ndarray
    total: int
    once: int

    def probability(self, word: np.ndarray) -> np.ndarray:
        """P(word), of five-byte keys: a word that is not among the keys stands for the class of all unseen words."""
        missing = min(0.5, max(1, self.once) / (self.total + 1)) if self.total else 1.0
        out = np.full(len(word), missing)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, word), len(self.keys) - 1)
            own = self.keys[at] == word
            out[own] = (1 - missing) / self.total * self.counts[at[own]]
        return out


def discounts(times: dict[int, int], most: int) -> np.ndarray:
    """Katz's Good-Turing factors of counts 0..most from counts of counts; where those are too few, an absolute discount of a half."""
    n = [times.get(r, 0) for r in range(most + 2)]
    out = np.ones(most + 1)
    tail = (most + 1) * n[most + 1] / n[1] if n[1] else 1.0
    for r in range(1, most + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else -1.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _weights(mass: np.ndarray, covered: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale of seen bigrams, alpha) of histories from their discounted mass, the unigram mass of their seen words and their counts. A
    history whose discounts leave nothing gives up one count's worth."""
    seen = np.where(count > 0, mass / np.maximum(count, 1), 0.0)
    scale = np.where((count > 0) & (seen > 1 - 1e-9), count / (count + 1.0), 1.0)
    return scale, np.where(count > 0, (1 - seen * scale) / np.maximum(1e-12, 1 - covered), 1.0)


def score(docs: DataFrame, train: Column, how: Katz = Katz()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(rows, tables). Rows: doc_id, n_tokens, n_known, base_log, score, train_tokens, vocabulary of every document; the model is learned from the
    rows where `train` holds (null: not). base_log sums log10(c + 0.5). Tables: unigrams (word, count) as stored.

    Words are runs without blanks, A-Z lower-cased; each text ends with one end token. Null and empty texts are an end alone; repeated
    rows count and score each; without training rows every word is unseen; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    sizes = given.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.col("train").cast("long")).alias("ends")).first()
    buckets, ends = max(8, -(-(sizes["bytes"] or 0) // how.bucket_bytes)), sizes["ends"] or 0
    name = f"katz_{uuid.uuid4().hex}"
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}"
    _events(given, buckets).write.option("path", path).bucketBy(int(buckets), "bucket").saveAsTable(name)
    events = spark.table(name)
    packed = events.where("bucket >= 0")

    def count(t: pa.Table) -> pa.Table:
        history, word, seen, _, _ = _read(t)
        first, _, times = _pairs(history, word, seen)
        r, n = np.unique(np.minimum(times, how.discounted + 2), return_counts=True)
        seen = times > 0
        names, of = np.unique(history[first[seen]], return_inverse=True)
        totals = np.bincount(of, times[seen], len(names)).astype(np.int64)
        own = np.unique(word[first])
        kinds = np.repeat(np.array([0, 1, 2], np.int32), [len(names), len(r), len(own)])
        return pa.table({"kind": pa.array(kinds), "key": pa.array(np.r_[names.view(np.int64), r.astype(np.int64), own.view(np.int64)]),
                         "n": pa.array(np.r_[totals, n, np.full(len(own), t["bucket"][0].as_py())])})

    # Kinds: 0 training counts of words as histories, 1 counts of bigram counts, 2 words (five bytes) that a bucket asks for.
    counted = base.stored(packed.groupBy("bucket").applyInArrow(count, "kind int, key long, n long"), "counts")
    times = {r["key"]: r["n"] for r in counted.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    factor = discounts(times, how.discounted)
    words = base.stored(counted.where((F.col("kind") == 0) & (F.col("key") != int(BEGIN))).groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("count")), "unigrams")
    totals = words.agg(F.sum("count").alias("n"), F.count("*").alias("v"), F.sum((F.col("count") == 1).cast("long")).alias("once")).first()
    all_tokens, vocabulary = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    once = totals["once"] or 0
    own = words.groupBy(F.expr("word & 1099511627775L").alias("key")).agg(F.sum("count").alias("count")).where(F.col("key") != int(END))
    asked = counted.where("kind = 2").select("key", F.col("n").cast("int").alias("bucket"))
    # A merge join at every size: the vocabulary is never broadcast.
    own = asked.join(own.hint("merge"), "key").select("bucket", "key", "count").repartition(int(buckets), "bucket")
    own.write.option("path", f"{path}_own").bucketBy(int(buckets), "bucket").saveAsTable(f"{name}_own")
    own = spark.table(f"{name}_own")

    def unigrams(t: pa.Table) -> Unigrams:
        """Of a bucket's words that training has; all others are unseen."""
        keys, counts = t["key"].to_numpy().astype(np.uint64), t["count"].to_numpy().astype(float)
        if ends:
            keys, counts = np.r_[keys, END], np.r_[counts, float(ends)]
        order = np.argsort(keys)
        return Unigrams(keys[order], counts[order], all_tokens, once)

    def mass(t: pa.Table, u: pa.Table) -> pa.Table:
        """Of the spread histories: training count, discounted mass and unigram mass of their words in this bucket."""
        history, word, seen, _, _ = _read(t)
        first, _, r = _pairs(history, word, seen)
        first, r = first[r > 0], r[r > 0]
        names, of = np.unique(history[first], return_inverse=True)
        d = np.where(r <= how.discounted, factor[np.minimum(r, how.discounted)], 1.0)
        sums = [np.bincount(of, x, len(names)).astype(float) for x in (r, d * r, unigrams(u).probability(word[first]))]
        return pa.table({"v": pa.array(names.view(np.int64)), "c": pa.array(sums[0]), "m": pa.array(sums[1]), "u": pa.array(sums[2])})

    # As many as there are common words: a few for each bucket.
    spread = packed.where("hot").groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(mass, "v long, c double, m double, u double").groupBy("v").agg(
        F.sum("c").alias("c"), F.sum("m").alias("m"), F.sum("u").alias("u")).collect()
    spread = sorted((r["v"] & (1 << 64) - 1, r["c"], r["m"], r["u"]) for r in spread)
    hot_v, hot_sums = np.array([r[0] for r in spread], np.uint64), np.array([r[1:] for r in spread], float).reshape(-1, 3)

    def judge(t: pa.Table, own: pa.Table) -> pa.Table:
        history, word, count, loads, ends = _read(t)
        first, of, r = _pairs(history, word, count)
        p = unigrams(own).probability(word[first])
        names, vi = np.unique(history[first], return_inverse=True)
        seen = r > 0
        d = np.where(r <= how.discounted, factor[np.minimum(r, how.discounted)], 1.0)
        c, m, u = (np.bincount(vi, np.where(seen, x, 0.0), len(names)) for x in (r, d * r, p))
        if len(hot_v):
            at = np.minimum(np.searchsorted(hot_v, names), len(hot_v) - 1)
            is_hot = hot_v[at] == names
            c[is_hot], m[is_hot], u[is_hot] = hot_sums[at[is_hot]].T
        scale, alpha = _weights(m, u, c)
        del word
        likely = np.where(seen, scale[vi] * d * r / np.maximum(c[vi], 1), np.maximum(alpha[vi], 1e-12) * p)
        # A word's own count and base term come from its event as a history; the beginning has none.
        own_count = np.where(names == BEGIN, -1.0, c)[vi]
        worth = np.minimum(np.rint(np.log10(likely) * -FINE), (1 << 32) - 1).astype(np.uint32)
        del history, likely, p, d, r, count
        base.release()
        out = []
        for x, a, b in zip(loads, ends[:-1], ends[1:]):
            head = np.frombuffer(x, np.int64, 4)
            n, m = int(head[0]), int(head[1])
            runs = np.frombuffer(x, np.uint32, n, 32 + 8 * n + 5 * m)
            begin = a + np.r_[0, np.cumsum(runs[:-1])].astype(np.int64)
            out.append(x[:32] + own_count[of[begin]].tobytes() + worth[of[a:b]].tobytes() + x[32 + 8 * n + 5 * m:])
        return pa.table({"slice": t["slice"], "payload": pa.array(out, pa.binary())})

    parts = packed.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(judge, "slice long, payload binary").withColumn("ids", F.lit(None).cast("binary"))
    headers = events.where("bucket = -1").select("slice", F.lit(None).cast("binary").alias("payload"), F.col("payload").alias("ids"))

    def gather(t: pa.Table) -> pa.Table:
        head = next(x for x in t["ids"].to_pylist() if x is not None)
        n = len(head) // 17
        ids, words, null = np.frombuffer(head, np.int64, n), np.frombuffer(head, np.int64, n, 8 * n), np.frombuffer(head, bool, n, 16 * n)
        sums = [np.zeros(n), np.zeros(n), np.zeros(n, np.int64)]
        for x in t["payload"].to_pylist():
            if x:
                head = np.frombuffer(x, np.int64, 4)
                k, m = int(head[0]), int(head[1])
                runs, times, tags = _tail(x, 32 + 8 * k + 4 * m, head)
                doc = tags & np.uint16(0x7FFF)
                count = np.repeat(np.repeat(np.frombuffer(x, np.float64, k, 32), runs), times)
                sums[0] += np.bincount(doc, np.repeat(np.frombuffer(x, np.uint32, m, 32 + 8 * k) / -FINE, times), n)
                sums[1] += np.bincount(doc, np.where(count >= 0, np.log10(np.maximum(count, 0) + 0.5), 0.0), n)
                sums[2] += np.bincount(doc, count > 0, n).astype(np.int64)
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=null), "score": pa.array(sums[0]), "base_log": pa.array(sums[1]), "n_known": pa.array(sums[2]), "words": pa.array(words)})

    rows = parts.unionByName(headers).groupBy("slice").applyInArrow(gather, "doc_id long, score double, base_log double, n_known long, words long")
    end = float(np.log10(ends + 0.5))
    rows = rows.select("doc_id", (F.col("words") + 1).alias("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"), (F.col("base_log") + end).alias("base_log"),
                       "score", F.lit(int(all_tokens)).cast("long").alias("train_tokens"), F.lit(int(vocabulary)).cast("long").alias("vocabulary"))
    rows = base.stored(rows, "scores")
    for t, folder in ((name, path), (f"{name}_own", f"{path}_own")):
        spark.sql(f"DROP TABLE {t}")
        base.discard(spark, folder)
    return rows, {"unigrams": words}
