"""Quality: a generalised additive model with pairwise interactions, lookup tables learned by cyclic boosting of shallow trees."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

FEATURES = ("words", "word_length", "capitals", "digits", "commas_stops", "marks", "symbols", "bars", "distinct", "commonest", "repeated_lines", "words_a_line",
            "not_ascii", "short_words", "adjacent_repeats", "compression")
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"


def features(raw: bytes) -> list[float]:
    """What a whole text looks like, whatever its subject, language or source."""
    import zlib

    words = raw.split()
    n, size = len(words), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = lambda chars: size - len(raw.translate(None, chars)) if raw else 0
    many = Counter(words)
    letters = size - raw.count(b" ") - raw.count(b"\n")
    return [
        np.log1p(n), letters / max(1, n), count(_UPPER) / size, count(_DIGIT) / size, count(b".,;:") / size, count(b"!?") / size, count(b"#$%&*@^~+=<>{}[]\\_") / size,
        raw.count(b"|") / max(1, n), len(many) / max(1, n), max(many.values(), default=0) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))), count(bytes(range(128, 256))) / size, sum(len(w) < 3 for w in words) / max(1, n),
        sum(map(bytes.__eq__, words, words[1:])) / max(1, n), len(zlib.compress(raw, 1)) / size,
    ]


@dataclass
class Model:
    """edges: bin edges of each feature; tables: the log odds of each bin; pairs: (feature, feature, table over coarse bins)."""

    edges: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    bias: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for k, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _split(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """(gain, position) of the best cut of a histogram; position 0: none."""
    if len(g) < 2:
        return 0.0, 0
    lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(lg, lh, ridge) + _gain(g.sum() - lg, h.sum() - lh, ridge) - _gain(g.sum(), h.sum(), ridge)
    gain[(lh < least) | (h.sum() - lh < least)] = 0.0
    k = int(gain.argmax())
    return float(gain[k]), k + 1 if gain[k] > 1e-9 else 0


def tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """A tree of up to three leaves over a feature's bins: its value in each bin."""
    out, (_, k) = np.zeros(len(g)), _split(g, h, ridge, least)
    if not k:
        return out
    parts = [(0, k), (k, len(g))]
    more = [_split(g[a:b], h[a:b], ridge, least) for a, b in parts]
    side = 0 if more[0][0] >= more[1][0] else 1
    if more[side][1]:
        a, b = parts.pop(side)
        parts += [(a, a + more[side][1]), (a + more[side][1], b)]
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def square(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """The best tree that cuts both features of a grid once: (gain, value in each cell)."""
    best, out = 0.0, np.zeros(g.shape)
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    whole = _gain(cg[-1, -1], ch[-1, -1], ridge)
    for a in range(g.shape[0] - 1):
        for b in range(g.shape[1] - 1):
            qg = np.array([cg[a, b], cg[a, -1] - cg[a, b], cg[-1, b] - cg[a, b], cg[-1, -1] - cg[a, -1] - cg[-1, b] + cg[a, b]])
            qh = np.array([ch[a, b], ch[a, -1] - ch[a, b], ch[-1, b] - ch[a, b], ch[-1, -1] - ch[a, -1] - ch[-1, b] + ch[a, b]])
            gain = float((_gain(qg, qh, ridge) * (qh >= least)).sum() - whole)
            if gain > best:
                best, v = gain, np.where(qh >= least, -qg / (qh + ridge), 0.0)
                out = np.empty(g.shape)
                out[:a + 1, :b + 1], out[:a + 1, b + 1:], out[a + 1:, :b + 1], out[a + 1:, b + 1:] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, rate: float = 0.1, bins: int = 48, grid: int = 6, pairs: int = 8,
        ridge: float = 1.0, least: float = 2.0) -> Model:
    """Cyclic boosting: each round adds one shallow tree to every feature's table in turn; then, with those fixed, to the tables of
    the pairs whose first tree gains most."""
    if not len(x) or y.min() == y.max():
        return Model(bias=30.0 if len(x) and y.min() == 1 else -30.0 if len(x) else 0.0)
    share = y.mean()
    m = Model([cuts(c, bins) for c in x.T], [cuts(c, grid) for c in x.T], bias=float(np.log(share / (1 - share))))
    at = [np.searchsorted(e, c, "right") for e, c in zip(m.edges, x.T)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    f = np.full(len(x), m.bias)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k, b in enumerate(at):
            g, h = slopes()
            n = len(m.tables[k])
            step = rate * tree(np.bincount(b, g, n), np.bincount(b, h, n), ridge, least)
            m.tables[k] += step
            f += step[b]
    rough = [np.searchsorted(e, c, "right") for e, c in zip(m.coarse, x.T)]
    size = [len(e) + 1 for e in m.coarse]

    def grids(i: int, j: int):
        g, h = slopes()
        cell = rough[i] * size[j] + rough[j]
        return [np.bincount(cell, v, size[i] * size[j]).reshape(size[i], size[j]) for v in (g, h)]

    gains = sorted(((square(*grids(i, j), ridge, least)[0], i, j) for i in range(len(size)) for j in range(i)), reverse=True)[:pairs]
    m.pairs = [(i, j, np.zeros((size[i], size[j]))) for gain, i, j in gains if gain > 0]
    for _ in range(pair_rounds):
        for i, j, table in m.pairs:
            step = rate * square(*grids(i, j), ridge, least)[1]
            table += step
            f += step[rough[i], rough[j]]
    return m


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, most: int = 20_000, **how) -> Model:
    """Fitted on at most `most` labelled documents outside the held-out fold: their features alone come to the driver. Without
    labels every score is 0.5."""
    rows = base.labelled_sample(docs, labels, "quality", modulus, remainder, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([features(t) for t in base.raw_texts(b.column("text"))], pa.list_(pa.float64()))], ["y", "x"])

    got = rows.select("y", "text").mapInArrow(run, "y int, x array<double>").collect()
    got.sort(key=lambda r: (r["y"], r["x"]))  # whatever the order of tasks
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r["y"] for r in got], float), **how)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with `score`, the estimated probability of good quality, from the text alone.

    Null and empty texts are scored as texts without words; repeated rows score alike; an empty table gives no rows; an input
    column named score is replaced. Texts are read whole; no shuffle.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            x = np.array([features(t) for t in base.raw_texts(b)], float).reshape(-1, len(FEATURES))
            yield pa.array(1 / (1 + np.exp(-np.clip(model.log_odds(x), -30, 30))))
            del b
            base.release()

    # Only texts go to Python and only scores come back.
    return docs.select(*kept, F.arrow_udf(run, "double").asNondeterministic()(F.col("text").cast("string")).alias("score"))
