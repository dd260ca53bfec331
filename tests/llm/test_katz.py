import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from framelattice.llm import katz, queries

from .conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
B, E = "<begin>", "<end>"


def brute(docs, train):
    """{row: (n_tokens, n_known, N, base, score)} by dictionaries of words; exact unigrams."""
    texts = [WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [E] for _, t in docs]
    one, two = Counter(), Counter()
    for k, w in enumerate(texts):
        if train[k]:
            one.update(w)
            two.update(zip([B, *w], w))
    n, v, once = sum(one.values()), len(one), sum(c == 1 for w, c in one.items() if w != E)
    d = katz.discounts(Counter(two.values()), 5)
    history = defaultdict(list)
    for (a, w), c in two.items():
        history[a].append((w, c))
    missing = min(0.5, max(1, once) / (n + 1)) if n else 1.0
    uni = lambda w: (1 - missing) * one[w] / n if one[w] else missing  # all unseen words are one class
    cut = lambda c: d[c] * c if c <= 5 else c

    def p(a, w):
        if a not in history:
            return uni(w)
        c = sum(x for _, x in history[a])
        seen = sum(cut(x) for _, x in history[a]) / c
        scale = c / (c + 1) if seen > 1 - 1e-9 else 1.0
        if two[a, w]:
            return scale * cut(two[a, w]) / c
        return (1 - seen * scale) / max(1e-12, 1 - sum(uni(x) for x, _ in history[a])) * uni(w)

    return [(len(w), sum(one[x] > 0 for x in w), n, sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), sum(math.log10(p(a, x)) for a, x in zip([B, *w], w))) for w in texts], p, one


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in docs]
    want, p, one = brute(docs, train)
    got = {r["doc_id"]: r for r in queries.op8(spark, SF).collect()}
    assert len(got) == len(docs)
    for (i, _), t, w in zip(docs, train, want):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not t, *w[:3])
        assert r["base_score"] == pytest.approx(w[3], rel=1e-9)
        assert r["score"] == pytest.approx(w[4], rel=1e-6)
    held = [(got[i]["score"], got[i]["base_score"]) for (i, _), t in zip(docs, train) if not t]
    assert sum(a for a, _ in held) > sum(b for _, b in held)
    for a in ("the", "de", B, *list(one)[:20]):
        assert sum(p(a, w) for w in [*one, "no word of training"]) == pytest.approx(1, abs=1e-9)


def test_odd(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    from pyspark.sql import functions as F

    train = [i is not None and i % 2 == 0 for i, _ in rows]
    want = sorted(((i, w[0], w[1], round(w[3], 6), round(w[4], 4)) for (i, _), w in zip(rows, brute(rows, train)[0])), key=str)
    out, _ = katz.score(odd, F.col("doc_id") % 2 == 0, katz.Katz(bucket_bytes=1 << 12))
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_log"] - r["n_tokens"] * math.log10(r["train_tokens"] + 0.5 * (r["vocabulary"] + 1)), 6), round(r["score"], 4)) for r in out.collect()]
    assert sorted(got, key=str) == want
    assert katz.score(empty, F.lit(True))[0].count() == 0
    out, _ = katz.score(odd, F.lit(None).cast("boolean"))
    assert all(r["n_known"] == 0 and np.isfinite(r["score"]) for r in out.collect())


def test_every_word_has_its_own_count(spark):
    """More distinct words than any fixed table of them, and unseen words among the held-out texts."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    often, seldom = [f"a{i}" for i in range(100_000)], [f"b{i}" for i in range(200_000)]
    words = np.array(often * 2 + often[:1000] * 5 + seldom)
    words = words[rng.permutation(len(words))]
    texts = [" ".join(w) for w in np.array_split(words, 400)]
    texts += [" ".join([*rng.choice(words, 40), *(f"new{k}x{i}" for i in range(40))]) for k in range(20)]
    want = brute(list(enumerate(texts)), [k < 400 for k in range(420)])[0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out, _ = katz.score(df, F.col("doc_id") < 400, katz.Katz(bucket_bytes=1 << 19))
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 420
    for k, w in enumerate(want):
        assert (got[k]["n_tokens"], got[k]["n_known"]) == w[:2]
        assert got[k]["score"] == pytest.approx(w[4], rel=1e-9), k


def test_unigrams_normalise():
    """Over all training words and the class of the others the sum is one."""
    rng = np.random.default_rng(0)
    words = np.unique(rng.integers(3, 1 << 40, 500, dtype=np.uint64))
    counts = rng.integers(1, 50, len(words)).astype(float)
    u = katz.Unigrams(words, counts, int(counts.sum()), 7)
    assert u.probability(np.r_[words, np.uint64(2)]).sum() == pytest.approx(1)
    none = np.zeros(0)
    assert katz.Unigrams(none.astype(np.uint64), none, 0, 0).probability(words).tolist() == [1.0] * len(words)


def test_packed_events():
    rng = np.random.default_rng(4)
    history, word = np.sort(rng.integers(3, 9, 3000, dtype=np.uint64)), rng.integers(1, 4, 3000, dtype=np.uint64)
    order = np.lexsort((word, history))
    history, word, tag = history[order], word[order], rng.integers(0, 1 << 16, 3000).astype(np.uint16)
    one = katz._pack(history, word, tag)
    import pyarrow as pa

    h, w, n, _, ends = katz._read(pa.table({"payload": pa.array([one, katz._pack(history[:1], word[:1], tag[:1])], pa.binary())}))
    want = Counter(zip(history.tolist(), word.tolist(), strict=True))
    trained = Counter((a, b) for a, b, t in zip(history.tolist(), word.tolist(), tag.tolist()) if t >> 15)
    assert ends.tolist() == [0, len(want), len(want) + 1]
    assert {(a, b): c for a, b, c in zip(h[:-1].tolist(), w[:-1].tolist(), n[:-1].tolist())} == {k: trained[k] for k in want}
    same = katz._pack(np.full(400, 5, np.uint64), np.full(400, 6, np.uint64), np.full(400, 1 << 15, np.uint16))
    assert katz._read(pa.table({"payload": pa.array([same], pa.binary())}))[2].tolist() == [400]
