"""Chat formatting: whole conversations rendered, encoded once with offsets, loss masks from turn spans."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's marks (special tokens of the encoder): a turn, the end of its role, its end.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings that a text must not bring in: any "<|", and common begin, end and instruction marks. Escaping puts a
# backslash after the first character, one more if there are some already; taking one away restores the text.
_RAW = regex.compile(r"([<\[])(\\*)(?=\||/?s>|/?INST\])")
_ESCAPED = regex.compile(r"([<\[])\\(\\*)(?=\||/?s>|/?INST\])")
_TURNS = regex.compile(r"<\|turn\|>((?:(?!<\|text\|>).)*)<\|text\|>((?:(?!<\|end\|>).)*)<\|end\|>", regex.S)


def escape(text: str) -> str:
    return _RAW.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The formatted conversation and the sorted spans (start, end, bears loss) of its turns' texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role == "assistant"))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns read back from a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURNS.finditer(formatted)]


def align(spans: list[tuple[int, int, bool]], offsets: np.ndarray) -> np.ndarray:
    """Tokens under the loss mask: those that share a character with a turn that bears loss, by binary search of each
    token's first character among the sorted turn starts. Marks are tokens of their own, so no token leaves its turn."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool)
    begin, end, loss = (np.array(x) for x in zip(*spans))
    k = np.searchsorted(begin, offsets[:, 0], "right") - 1
    inside = (k >= 0) & (offsets[:, 0] < end[np.maximum(k, 0)]) & (offsets[:, 1] > offsets[:, 0])
    return inside & loss[np.maximum(k, 0)].astype(bool)


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """All characters of the masked tokens, each once, in order. Runs end at marks, so each run is unescaped by itself."""
    if not mask.any():
        return ""
    start, end = offsets[mask, 0], offsets[mask, 1]
    new = np.flatnonzero(np.r_[True, start[1:] > np.maximum.accumulate(end)[:-1]])
    last = np.maximum.reduceat(end, new)
    return "".join(unescape(formatted[a:b]) for a, b in zip(start[new], last))


@functools.lru_cache(2)
def encoder(path: str):
    """The tokenizer with the marks as special tokens and offsets that keep leading spaces."""
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (TURN, BODY, END)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


SCHEMA = "conv_id long, n_turns long, formatted string, ids array<int>, loss_mask array<boolean>, loss_text string"


def format_chats(turns: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation: formatted text, token ids, the token loss mask and the text under it.

    Rows go by turn (null first), then role and text; repeated rows are turns of their own. Null roles and texts are
    empty; turns without conversation form one of null id; an empty table gives no rows; other columns are ignored.
    A conversation is one sequence, so its turns meet in one task; conversations spread over all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            rows = []
            for conv, turns in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist()):
                formatted, spans = render([(t["role"] or "", t["text"] or "") for t in turns])
                e = enc.encode(formatted, add_special_tokens=False)
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                mask = align(spans, offsets)
                rows.append((conv, len(turns), formatted, e.ids, mask.tolist(), masked_text(formatted, offsets, mask)))
                if len(rows) >= 500:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    def batch(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 6
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.string()]
        names = ["conv_id", "n_turns", "formatted", "ids", "loss_mask", "loss_text"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)

    per = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return per.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its mask say, by parsing them again."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest = [], []
            for text in b.column("formatted").to_pylist():
                turns = parse(text)
                n.append(len(turns))
                digest.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            loss = b.column("loss_text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array([len(x) for x in loss], pa.int64()),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in loss], pa.string()),
                 pa.array([len(x) for x in b.column("formatted").to_pylist()], pa.int64())],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_text").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
