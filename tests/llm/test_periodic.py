import hashlib
import random
import re
import zlib

import numpy as np

from framelattice.llm import periodic, queries

from .conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, exponent=4, least=6):
    """Every stretch by its definition: for each period, the maximal stretches; a stretch counts for its smallest period alone."""
    n, best = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, exponent * q):
                best.setdefault((i, length), q)  # smaller periods come first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in best.items())


def held(got, docs):
    """The query's rows against the definition."""
    want = []
    for doc_id, text in docs:
        w = WORDS.findall(text or "")
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
                     sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert sorted(map(str, got)) == sorted(map(str, want))
    return sum(r[1] for r in want)


def test_whole_table(spark):
    rows = queries.QUERIES["op13_periodic_runs"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert rows.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert held([tuple(r) for r in rows.collect()], docs) > 10


def test_odd_rows(spark, odd, empty, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()]
    held(got, [(r["doc_id"], r["text"]) for r in odd.collect()])
    out = periodic.find_runs(odd.selectExpr("*", "'c' AS runs", "'c' AS _found", "'c' AS collapsed"))
    assert out.count() == odd.count() and set(out.columns) == {*odd.columns, "_found", "n_words", "runs", "collapsed"}
    assert periodic.find_runs(empty).count() == 0


def found(texts, how=periodic.Runs()):
    """runs_of() over texts laid end to end, as runs of each text."""
    ids = {}
    h = np.array([hash(ids.setdefault(w, w)) & (1 << 64) - 1 for t in texts for w in t], np.uint64)
    t = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.r_[0, np.cumsum([len(t) for t in texts])]
    out = [[] for _ in texts]
    for i, length, period in periodic.runs_of(h, t, how):
        out[t[i]].append((i - int(first[t[i]]), length, period))
    return [sorted(x) for x in out]


def test_random_words():
    """Few letters give runs within, next to and across each other."""
    rng = random.Random(5)
    for k in range(60):
        texts = []
        for _ in range(12):
            t = [rng.choice("abc"[:1 + k % 3]) for _ in range(rng.randrange(60))]
            unit = [rng.choice("ab") for _ in range(rng.randrange(1, 9))]
            at = rng.randrange(len(t) + 1)
            texts.append(t[:at] + unit * rng.randrange(12) + unit[:rng.randrange(len(unit))] + t[at:])
        assert found(texts) == [sorted(plain_runs(t)) for t in texts]
        for how in (periodic.Runs(2, 3), periodic.Runs(3, 9)):
            assert found(texts, how) == [sorted(plain_runs(t, how.exponent, how.least)) for t in texts]


def test_long_periodic_text():
    """One word 150,000 times, and a long period: work grows with the words, not with the class."""
    assert found([["w"] * 150_000]) == [[(0, 150_000, 1)]]
    unit = [str(k) for k in range(20_000)]
    assert found([["x"] + unit * 5 + ["y"]]) == [[(1, 100_000, 20_000)]]


def test_positions():
    rng = random.Random(1)
    p, plain = periodic.Positions(5000), [5000]
    for x in rng.sample([i for i in range(10_000) if i != 5000], 6000):
        p.add(x)
        plain.append(x)
    plain.sort()
    assert list(p) == plain and p.size == len(plain)
    for i in rng.sample(range(1, len(plain) - 1), 200):
        assert p.around(plain[i]) == (plain[i - 1], plain[i + 1])
    assert p.around(plain[0])[0] is None and p.around(plain[-1])[1] is None
