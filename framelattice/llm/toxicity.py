"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases, normalised by length."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

# Letters of other scripts that look like Latin ones, and digits or signs that stand for letters.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
              "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SIGNS = {"@": "a", "$": "s"}
# Harmless phrases around words that may be in a lexicon.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "clown fish", "pond scum", "soap scum")

_SIGN_INSIDE = regex.compile(r"(?<=\p{L})[@$](?=\p{L})")


def _folding() -> dict[int, str]:
    """Character table of lower-cased text: look-alikes and digits to Latin letters, accents off, all but letters to blanks."""
    out = {}
    for c in [*range(0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFF00, 0xFF60)]:
        ch = chr(c)
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch).lower() if not unicodedata.combining(x))
        plain = "".join(LOOKALIKES.get(x, DIGITS.get(x, x)) for x in plain)
        out[c] = "" if unicodedata.category(ch) == "Cf" else plain if plain and all(x.isalpha() for x in plain) else " "
    return out | {c: "" for c in range(0x300, 0x370)}


_FOLD = _folding()


def fold(text: str) -> str:
    """Lower-cased, folded words with a blank before, between and after them."""
    low = text.lower()
    if "@" in low or "$" in low:
        low = _SIGN_INSIDE.sub(lambda m: SIGNS[m[0]], low)
    return f" {' '.join(low.translate(_FOLD).split())} "


@dataclass
class Model:
    """weights: entries " word " or " prefix" of folded text; exceptions: folded phrases; coef: intercept and slopes."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coef: tuple[float, ...] = (-4.0, 0.0, 0.0, 0.0)


def automaton(model: Model):
    import ahocorasick

    a = ahocorasick.Automaton()
    for entry, w in model.weights.items():
        a.add_word(entry, (len(entry), w))
    for phrase in model.exceptions:
        entry = f" {phrase} "
        a.add_word(entry, (len(entry), -1.0) if entry not in a else a.get(entry))
    if len(a):
        a.make_automaton()
    return a


def measures(folded: str, machine) -> tuple[float, float, float]:
    """(highest weight, sum by square root of length, sum by length) of the words hit. A word counts once, by its highest entry; words
    inside an exception phrase do not count."""
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(machine):
        for end, (n, w) in machine.iter(folded):
            start = end - n + 1
            if w < 0:
                spared.append((start, end))
            elif w > hits.get(start, 0.0):
                hits[start] = w
    for a, b in spared:
        for s in [s for s in hits if a <= s < b]:
            del hits[s]
    words, total = folded.count(" ") - 1, sum(hits.values())
    return max(hits.values(), default=0.0), total / math.sqrt(words + 5), total / (words + 10)


def lexicon(counts: DataFrame, toxic: int, clean: int, most: int, least: int = 5) -> dict[str, float]:
    """Entries whose documents are toxic more often than chance: words, and word beginnings of 4 to 8 letters.

    counts: word, n1, n0 (toxic and clean documents with it). The log likelihood ratio against the overall share must exceed the
    log of ten times the entries tried; the weight is the smoothed log odds. At most `most` entries, strongest first.
    """
    starts = counts.where("length(word) >= 4").select("n1", "n0", F.explode(F.expr(
        "transform(sequence(4, least(8, length(word))), k -> concat(' ', substring(word, 1, k)))")).alias("entry"))
    full = counts.select("n1", "n0", F.concat(F.lit(" "), "word", F.lit(" ")).alias("entry"))
    entries = starts.unionByName(full).groupBy("entry").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") + F.col("n0") >= least)
    share = (toxic + 1) / (toxic + clean + 2)
    n = F.col("n1") + F.col("n0")
    ratio = F.col("n1") * F.log(F.col("n1") / n / share) + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / n / (1 - share))).otherwise(0.0)
    odds = F.log((F.col("n1") + 0.5) / (toxic + 1)) - F.log((F.col("n0") + 0.5) / (clean + 1))
    scored = entries.withColumn("ratio", ratio).withColumn("weight", odds)
    tried = scored.count()
    good = scored.where((F.col("n1") >= least) & (F.col("weight") > 1.0) & (F.col("ratio") > math.log(10.0 * max(1, tried))))
    return {r["entry"]: float(r["weight"]) for r in good.orderBy(F.desc("ratio"), "entry").limit(most).collect()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Intercept and slopes by Newton steps with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(b))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, most: int = 20_000, entries: int = 20_000) -> Model:
    """Lexicon, weights and calibration from at most `most` labelled documents outside the held-out fold. Without labels, or with
    one class alone, the model has no entries and scores every text alike."""
    rows = base.labelled_sample(docs, labels, "toxic", modulus, remainder, most)
    sample = base.stored(rows.select("text", "y"), "toxic")
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Model()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = (Counter(), Counter())
            for text, y in zip(base.texts_of(b.column("text")), b.column("y").to_pylist()):
                seen[y].update(set(fold(text).split()))
            both = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([seen[1][w] for w in both], pa.int64()), pa.array([seen[0][w] for w in both], pa.int64())],
                                             ["word", "n1", "n0"])

    counts = sample.mapInArrow(words, "word string, n1 long, n0 long").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    model = Model(lexicon(counts, toxic, clean, entries), EXCEPTIONS)
    seen = np.array([[r["y"], *r["x"]] for r in _measured(sample, model, ["y"]).select("y", "x").collect()], float)
    model.coef = logistic(seen[:, 1:], seen[:, 0])
    return model


def _measured(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    kept = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = kept.drop("text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(model)
        for b in batches:
            x = [list(measures(fold(t), machine)) for t in base.texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    return kept.mapInArrow(run, T.StructType([*schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with `score`, the estimated probability that the text is toxic, from its text alone.

    Null and empty texts get the score of a text without hits; repeated rows score alike; an empty table gives no rows; an
    input column named score is replaced. Texts are read whole; no shuffle.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton(model)
        coef = np.array(model.coef)
        for b in batches:
            x = np.array([measures(fold(t), machine) for t in base.texts_of(b)]).reshape(-1, 3)
            yield pa.array(1 / (1 + np.exp(-np.clip(coef[0] + x @ coef[1:], -30, 30))))
            del b
            base.release()

    # Only texts go to Python and only scores come back.
    return docs.select(*kept, F.arrow_udf(run, "double").asNondeterministic()(F.col("text").cast("string")).alias("score"))
