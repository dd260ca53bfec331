import random

import numpy as np
import pytest

from framelattice.llm import forest, queries

from .conftest import SF
from .test_jaccard import brute, rows


def found(df, how=forest.Forest()):
    out = forest.link(df, how).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)


def test_documents(spark, docs):
    out = queries.QUERIES["op12_lsh_forest"](spark, SF)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()), key=str)
    assert got == brute(rows(docs), 2, 80) and any(a != c for a, _, c in got)


def test_odd(odd, empty):
    assert found(odd) == brute(rows(odd), 2, 80)
    assert found(empty) == []


@pytest.mark.parametrize("how", [forest.Forest(), forest.Forest(crowd=4, block=16, deep=4, turns=0), forest.Forest(crowd=4, block=16, turns=2)])
def test_families(spark, how):
    """Chains and stars of edits, copies, and many unlike texts around one template: crowded leaves of several components."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(6):
        now = [rng.choice(words) for _ in range(60)]
        for _ in range(12):
            texts.append(" ".join(now))
            now = list(now)
            now[rng.randrange(60)] = rng.choice(words)  # each is like the one before, less and less like the first
    form = [rng.choice(words) for _ in range(70)]
    for k in range(60):
        texts.append(" ".join(form + [rng.choice(words) for _ in range(rng.choice((4, 12, 30)))]))
    texts += texts[:10] + ["w1 w2"] * 5 + ["w1"] * 5 + ["W1  w2"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = spark.createDataFrame([(k, texts[i]) for k, i in enumerate(order)], "doc_id long, text string")
    assert found(df, how) == brute(rows(df), 2, 80)


def test_places():
    """The share of common prefixes follows the likeness; equal sets have equal places."""
    rng = np.random.default_rng(1)
    how = forest.Forest(trees=64)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for common in (200, 600, 900):
        own = (1000 - common) // 2
        a, b = np.sort(np.r_[pool[:common], pool[1000:1000 + own]]), np.sort(np.r_[pool[:common], pool[2000:2000 + own]])
        likeness = common / (len(a) + len(b) - common)
        x = forest.spots([a, b, a], how)
        assert (x[0] == x[2]).all() and (x[0] >> 55 == np.arange(64)).all()
        first = (x[0] >> 44 == x[1] >> 44).mean()
        assert abs(first - likeness) < 0.2
    assert forest.Forest().missed(3) < 1e-9 and forest.Forest().missed(5) < 4e-6


def test_links_among():
    rng = np.random.default_rng(2)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.sort(rng.choice(base, rng.integers(60, 100), replace=False)) for _ in range(30)]
    how = forest.Forest()
    asks = np.arange(30) % 3 == 0
    want = {(i, j) for i in np.flatnonzero(asks) for j in range(30) if i != j
            and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert set(forest.links_among(sets, asks, how)) == want and want


def test_spanning():
    inside = np.array([True, False, True, False, False])
    assert forest.spanning([(0, 2), (1, 0), (1, 2), (3, 4), (4, 3), (3, 1)], 5, inside) == [(1, 0), (3, 4), (3, 1)]
