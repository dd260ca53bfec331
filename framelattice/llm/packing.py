"""Vector bin packing of token pieces under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .shingles import _slices, cut_at_blanks, span_hashes

END_ID = 2
# Chunks whose tokens depend on nothing but ASCII and precomposed Latin-1 letters: NFC leaves them as they are.
_PLAIN = regex.compile(r"[\x21-\x7EÀ-ÿ]+")
# The split pattern of the tokenizer file (fixed value).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


# Kinds of bytes: blank, letter, digit, other sign; HARD bytes need Unicode rules or the tokenizer's own.
_KIND = np.full(256, 3, np.uint8)
_HARD = 4
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[[*range(9), *range(14, 32), 39, *range(127, 256)]] = _HARD  # 39: the apostrophe may begin a contraction


def pieces(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hard) of byte ranges whose ids in a row are the texts' ids. The tokenizer splits at white space and forgets it, and
    splits plain ASCII into runs of letters, single digits and runs of other signs; a hard range is a whole blank-free chunk."""
    kind = _KIND[body]
    kind[:-1][(body[:-1] == ord("<")) & (body[1:] == ord("|"))] = _HARD
    ink = kind > 0
    fresh = np.zeros(len(body) + 1, bool)
    fresh[offsets] = True
    opens = ink & (np.r_[True, ~ink[:-1]] | fresh[:-1])
    chunk = np.cumsum(opens) - 1
    hard = np.zeros(int(opens.sum()), bool)
    hard[chunk[kind == _HARD]] = True
    inside = ink & ~hard[np.maximum(chunk, 0)] if len(hard) else ink
    begins = opens | inside & (np.r_[True, kind[1:] != kind[:-1]] | (kind == 2))
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(ink & np.r_[begins[1:] | ~ink[1:], True]) + 1
    return starts, ends, hard[chunk[starts]] if len(starts) else np.zeros(0, bool)


class PieceIds:
    """Token ids of texts by their pieces. A piece is known by its hash, in sorted arrays; new pieces go to the tokenizer joined by line
    feeds, which no piece holds and which are a word of their own; what is known is forgotten when there is too much of it."""

    def __init__(self, tokenizer, most: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = tokenizer, most
        # Pieces are lower-case and whole already: they need neither the normaliser nor the splitting pattern, half of the work.
        self.plain = Tokenizer.from_str(tokenizer.to_str())
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        stop = self.plain.encode("\n", add_special_tokens=False).ids
        if len(stop) != 1:
            raise ValueError("a line feed is one token of the vocabulary")
        self.stop = stop[0]
        self.forget()

    def forget(self) -> None:
        self.keys, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def split(chunk: bytes) -> list[str] | None:
        """Pieces whose ids in a row are a hard chunk's; none where the tokenizer's own rules are needed."""
        text = chunk.decode("utf-8", "replace")
        if "<|" in text or not _PLAIN.fullmatch(text):
            return None
        low = text.lower()
        return [low] if low.isalpha() else _PIECES.findall(low)

    def learn(self, keys: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, hard: np.ndarray) -> None:
        """Ids of the byte ranges of new keys."""
        low = raw.lower().decode("latin-1")  # ranges that are not hard are ASCII
        words = [low[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        parts, odd = np.ones(len(words), np.int64), np.zeros(len(words), bool)
        for k in np.flatnonzero(hard).tolist():
            found = self.split(raw[starts[k]:ends[k]])
            if found is None:
                odd[k] = True
            else:
                words[k], parts[k] = "\n".join(found), len(found)
        if odd.any():
            ids = [self.tokenizer.encode(raw[starts[k]:ends[k]].decode("utf-8", "replace"), add_special_tokens=False).ids for k in np.flatnonzero(odd)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.keep(keys[odd], np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)
            words, parts, keys = list(itertools.compress(words, ~odd)), parts[~odd], keys[~odd]
        if words:
            joined = ["\n".join(words[k:k + 256]) + "\n" for k in range(0, len(words), 256)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)])
            stops = ids == self.stop
            ends = np.r_[0, np.flatnonzero(stops)[np.cumsum(parts) - 1] + 1]  # with the stops of a key's parts
            self.keep(keys, ids[~stops], np.diff(ends) - parts)

    def keep(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Adds keys with their ids, end to end."""
        begin = len(self.flat) + np.cumsum(sizes) - sizes
        order = np.argsort(np.r_[self.keys, keys], kind="stable")
        self.keys = np.r_[self.keys, keys][order]
        self.begin, self.size = np.r_[self.begin, begin][order], np.r_[self.size, sizes.astype(np.int32)][order]
        self.flat = np.r_[self.flat, flat]

    def ids(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of each text in them) of texts laid end to end."""
        starts, ends, hard = pieces(body, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        keys = span_hashes(body, starts, ends) ^ hard.astype(np.uint64)
        raw = body.tobytes()
        marks = np.flatnonzero((body[:-1] == ord("<")) & (body[1:] == ord("|")))
        for i in np.unique(np.searchsorted(starts, marks, "right") - 1):
            keys[i] ^= np.uint64(zlib.crc32(raw[starts[i]:ends[i]]) << 1)  # its case counts: it may name a special token
        kinds, first, of = np.unique(keys, return_index=True, return_inverse=True)
        new = np.ones(len(kinds), bool)
        if len(self.keys):
            new = self.keys[np.minimum(np.searchsorted(self.keys, kinds), len(self.keys) - 1)] != kinds
        if len(self.keys) + new.sum() > self.most:
            self.forget()
            new[:] = True
        if new.any():
            at = first[new]
            self.learn(kinds[new], raw, starts[at], ends[at], hard[at])
        at = np.searchsorted(self.keys, kinds)[of]
        begin, size = self.begin[at], self.size[at].astype(np.int64)
        done = np.r_[0, np.cumsum(size)]
        out = self.flat[np.repeat(begin - done[:-1], size) + np.arange(done[-1])]
        return out, done[np.searchsorted(starts, offsets)]

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(number, ids) of each text of an Arrow column; nulls are empty."""
        body, offsets = base.utf8_buffer(column)
        for a, b in _slices(body, offsets):
            part = body[offsets[a]:offsets[b]]
            if b - a == 1:
                yield a, np.concatenate([np.zeros(0, np.uint32), *[self.ids(part[i:j], np.array([0, j - i]))[0] for i, j in cut_at_blanks(part)]])
                continue
            ids, bounds = self.ids(part, offsets[a:b + 1] - offsets[a])
            for k in range(b - a):
                yield a + k, ids[bounds[k]:bounds[k + 1]]


@functools.lru_cache(2)
def piece_ids(path: str) -> PieceIds:
    """One per worker process and tokenizer file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task's cores are Spark's to share out
    from tokenizers import Tokenizer

    return PieceIds(Tokenizer.from_file(path))


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments (pieces) and loss-bearing tokens of a sequence."""

    tokens: int = 4096
    segments: int = 512
    loss: int = 4096


class Packer:
    """Packs pieces as they come, from a pool of bounded size. `emit(key, start, length, sequence, offset)` takes each."""

    def __init__(self, limits: Limits, pool: int, emit):
        self.limits, self.emit, self.next = limits, emit, 0
        self.size = np.zeros((pool, 3))  # tokens, segments, loss of each waiting piece; all 0: a free place
        self.scale = 1.0 / np.array([limits.tokens, limits.segments, limits.loss], float)
        self.items: list = [None] * pool  # (key, start, prompt tokens of the document)
        self.free = list(range(pool - 1, -1, -1))

    def cut(self, start: int, length: int, prompt: int, tokens: int, loss: int) -> int:
        """Tokens from start on that stay within both limits."""
        return min(length, tokens, loss + max(0, prompt - start))

    def add(self, key, length: int, prompt: int = 0) -> int:
        """A document: whole sequences first, the rest into the pool. Returns where the rest begins."""
        start, lim = 0, self.limits
        while length - start > 0:
            n = self.cut(start, length - start, prompt, lim.tokens, lim.loss)
            if n == length - start and n < lim.tokens:
                break
            self.emit(key, start, n, self.next, 0)
            self.next += 1
            start += n
        if start < length:
            if not self.free:
                self.fill()
            self.put(self.free.pop(), key, start, length - start, prompt)
        return start

    def put(self, k: int, key, start: int, length: int, prompt: int) -> None:
        self.items[k] = (key, start, prompt)
        self.size[k] = length, 1, max(0, start + length - max(start, prompt))

    def fill(self, ending: bool = False) -> list:
        """One sequence: the fitting piece with the highest dot product with what is left goes next; if none fits, or one
        segment is left, the piece of the highest product that reaches the end is cut there. A sequence that stays more than a
        64th short is cut into powers of two; when ending, the one that empties the pool is returned instead."""
        lim, used = self.limits, []
        left = np.array([lim.tokens, lim.segments, lim.loss], float)
        at = 0
        while left.min() > 0:
            alive = self.size[:, 0] > 0
            if not alive.any():
                break
            worth = (self.size * self.scale) @ (left * self.scale)
            fits = alive & (self.size <= left).all(1)
            reach = alive & ((self.size[:, 0] >= left[0]) | (self.size[:, 2] >= left[2]))
            choose = reach if not fits.any() or left[1] == 1 and reach.any() else fits
            k = int(np.where(choose, worth, -1.0).argmax())
            key, start, prompt = self.items[k]
            whole = int(self.size[k, 0])
            n = self.cut(start, whole, prompt, int(left[0]), int(left[2]))
            if n == 0:
                break
            used.append((key, start, n, at))
            left -= n, 1, max(0, start + n - max(start, prompt))
            at += n
            if n == whole:
                self.size[k], self.items[k] = 0, None
                self.free.append(k)
            else:
                self.put(k, key, start + n, whole - n, prompt)
        if ending and at < lim.tokens and not (self.size[:, 0] > 0).any():
            return used  # nothing waits: the last one
        if (lim.tokens - at) * 64 > lim.tokens:
            self.emit_cut(used)  # the segments ran out first, or the loss
            return []
        for piece in used:
            self.emit(*piece[:3], self.next, piece[3])
        self.next += 1
        return []

    def emit_cut(self, used: list) -> None:
        """Pieces of one short sequence, cut into lengths that are powers of two, which need no padding."""
        total = sum(n for _, _, n, _ in used)
        ends = np.cumsum([1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1])
        for key, start, n, at in used:
            while n:
                s = int(np.searchsorted(ends, at, "right"))
                begin = int(ends[s - 1]) if s else 0
                m = min(n, int(ends[s]) - at)
                self.emit(key, start, m, self.next + s, at - begin)
                start, n, at = start + m, n - m, at + m
        self.next += len(ends)

    def end(self) -> None:
        """Empty the pool; the last sequence is cut."""
        last: list = []
        while not last and (self.size[:, 0] > 0).any():
            last = self.fill(ending=True)
        self.emit_cut(last)


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), pool: int = 512, prompt: str | None = None) -> DataFrame:
    """Pieces of every document's token ids (the text's ids, then END_ID), placed in sequences.

    Each task packs the documents it reads: no shuffle, memory bounded by the pool and one document; the same input
    files give the same sequences when a task is run again. prompt: a column with the number of first tokens
    that bear no loss (null: 0). Null and empty texts are END_ID alone; repeated rows and ids are documents of their own;
    other columns are ignored; an empty table gives no rows. ids are little-endian unsigned 32-bit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = piece_ids(tokenizer)
        first = TaskContext.get().partitionId() << 36
        rows: list = []

        def emit(key, start, length, sequence, offset):
            doc, data, begin, total = key
            rows.append((doc, start, length, data[(start - begin) * 4:(start - begin + length) * 4], total, first + sequence, offset))

        def out():
            cols = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        packer = Packer(limits, pool, emit)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            asked = b.column("prompt").to_pylist()
            doc_ids = b.column("doc_id").to_pylist()
            for k, tokens in ids.texts(b.column("text")):
                data = tokens.astype("<u4").tobytes() + end
                key = [doc_ids[k], data, 0, len(data) // 4]
                key[2] = packer.add(key, key[3], max(0, asked[k] or 0))
                key[1] = data[key[2] * 4:]  # what waits in the pool keeps no more than its own ids
                if len(rows) >= 1000:
                    yield out()
            base.release()
        packer.end()
        yield out()
        ids.forget()
        base.release()

    given = F.col(prompt).cast("long") if prompt else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       given.alias("prompt")).mapInArrow(run, SCHEMA)
