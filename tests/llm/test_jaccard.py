import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from framelattice.llm import jaccard, shingles

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, words=4, percent=85):
    """[(doc_id, size, component)] by comparing every pair that shares a shingle, on word tuples."""
    sets = []
    for r in docs:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    index = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for t in s for j in index[t])
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for t in s:
            index[t].append(i)
    least = {}
    for i, r in enumerate(docs):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return sorted(((r["doc_id"], len(s), least.get(find(i)) if s else r["doc_id"]) for i, (r, s) in enumerate(zip(docs, sets))), key=str)


def linked(df, **how):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(df, jaccard.Join(**how)).collect()), key=str)


def rows(df):
    return [r.asDict() for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80)])
def test_documents(docs, words, percent):
    assert linked(docs, words=words, percent=percent) == brute(rows(docs), words, percent)


def test_odd(odd, empty):
    assert linked(odd) == brute(rows(odd))
    assert linked(empty) == []


def test_families(spark):
    """Near copies with few to many edits, around shared passages, through every path: tiny blocks and few hot tokens."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(4000)]
    passages = [" ".join(rng.choice(vocabulary, 40)) for _ in range(3)]
    texts = []
    for family in range(6):
        base = rng.choice(vocabulary, 120)
        for _ in range(60):
            t = base.copy()
            for k in rng.integers(0, len(t), rng.integers(0, 6)):
                t[k] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    for k in range(200):
        texts.append(" ".join(rng.choice(vocabulary, 30)) + " " + passages[k % 3])
    texts += texts[:50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute(rows(df))
    assert linked(df, hot=8, block=16) == want
    assert linked(df, hot=8, block=1000) == want
    assert linked(df, hot=100_000, block=37, bits=1 << 10) == want


def test_long_texts_are_cut_at_blanks(monkeypatch):
    text = " ".join(str(k * k) for k in range(5000)) + " " + "y" * 9000 + " end of it"
    whole = [s.tolist() for s in shingles.sets(pa.array([text, "a b", None, text]), 4)]
    monkeypatch.setattr(shingles, "_SLICE", 1 << 11)
    shingles._powers.cache_clear()
    assert [s.tolist() for s in shingles.sets(pa.array([text, "a b", None, text]), 4)] == whole
    assert whole[0] == whole[3] and len(whole[0]) == 5004 - 3 and len(whole[1]) == 1 and whole[2] == []
