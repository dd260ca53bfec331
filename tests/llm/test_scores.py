import bisect
import math
import zlib

import numpy as np
from framelattice.llm import base, quality, queries, toxicity
from pyspark.sql import functions as F

BIG = "/root/testdata/sf0.01"


def accuracy(spark, df, label, modulus, remainder):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = df.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    return np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels])


def test_held_out(spark):
    assert accuracy(spark, queries.op6(spark, BIG), "toxic", 5, 0) >= 0.95
    assert accuracy(spark, queries.op7(spark, BIG), "quality", 4, 2) >= 0.93


def test_fold():
    assert toxicity.fold("1D10T, Ѕсum​! Mórön ｃｌｏｗｎ $5 lo$er") == " idiot scum moron clown s loser "
    assert toxicity.fold("") == "  " and toxicity.fold(" \n") == "  "


def test_measures_spare_exceptions():
    m = toxicity.Model({" clown ": 3.0, " clow": 1.0, " scum ": 2.0}, ("clown fish",))
    machine = toxicity.automaton(m)
    assert toxicity.measures(toxicity.fold("a clown fish swims"), machine)[0] == 0
    high, by_root, by_length = toxicity.measures(toxicity.fold("the CLOWN, a clown fish and 5cum"), machine)
    assert high == 3.0 and abs(by_length - 5 / 17) < 1e-9 and abs(by_root - 5 / np.sqrt(12)) < 1e-9


def test_boosting_learns_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y)
    assert (((m.log_odds(x) > 0) == y).mean()) > 0.95 and {m.pairs[0][0], m.pairs[0][1]} == {0, 1}
    assert (quality.fit(x, np.ones(3000)).log_odds(x) > 0).all() and quality.fit(x[:0], y[:0]).bias == 0.0


def test_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(4, 1, 0), (5, 1, 1), (6, 0, 1), (None, 1, 1), (7, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for module in (toxicity, quality):
            got = module.score(odd, module.train(odd, labels)).collect()
            assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
            assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
            assert module.score(empty, module.train(empty, labels)).count() == 0


def test_held_out_of_null(spark):
    assert spark.range(1).select(base.held_out(F.lit(None), 5, 1).alias("x")).first()["x"] is not None


SMALL = "/root/testdata/sf0.001"


def plain_toxicity(text, model):
    """The score by trying every entry at every place, without an automaton."""
    folded = toxicity.fold(text or "")
    places = lambda entry: {i for i in range(len(folded)) if folded.startswith(entry, i)}
    best = {}
    for entry, w in model.weights.items():
        for i in places(entry):
            best[i] = max(w, best.get(i, 0.0))
    for phrase in model.exceptions:
        if f" {phrase} " not in model.weights:
            for i in places(f" {phrase} "):
                best = {k: w for k, w in best.items() if not i <= k < i + len(phrase) + 2}
    n, total = len(folded.split()), sum(best.values())
    x = model.coef[0] + model.coef[1] * max(best.values(), default=0.0) + model.coef[2] * total / math.sqrt(n + 5) + model.coef[3] * total / (n + 10)
    return 1 / (1 + math.exp(-min(30, max(-30, x))))


def plain_quality(text, model):
    """The score by counting characters one by one and adding each table's bin."""
    t = text or ""
    raw = t.encode()
    words, n, size = raw.split(), len(raw.split()), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    among = lambda chars: sum(c in chars.encode() for c in raw)
    x = [
        math.log1p(n), (size - among(" \n")) / max(1, n), sum(65 <= c < 91 for c in raw) / size, sum(48 <= c < 58 for c in raw) / size, among(".,;:") / size, among("!?") / size,
        among("#$%&*@^~+=<>{}[]\\_") / size, among("|") / max(1, n), len(set(words)) / max(1, n), max((words.count(w) for w in set(words)), default=0) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))), sum(c > 127 for c in raw) / size, sum(len(w) < 3 for w in words) / max(1, n),
        sum(a == b for a, b in zip(words, words[1:])) / max(1, n), len(zlib.compress(raw, 1)) / size,
    ]
    odds = model.bias + sum(float(t[bisect.bisect_right(list(e), v)]) for t, e, v in zip(model.tables, model.edges, x))
    odds += sum(float(t[bisect.bisect_right(list(model.coarse[i]), x[i]), bisect.bisect_right(list(model.coarse[j]), x[j])]) for i, j, t in model.pairs)
    return 1 / (1 + math.exp(-min(30, max(-30, odds))))


def test_scores_equal_plain_ones(spark, odd):
    """Every row of the whole table, and of odd rows."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SMALL}/labels.parquet")
    for module, plain in ((toxicity, plain_toxicity), (quality, plain_quality)):
        model = module.train(docs, labels)
        scores = []
        for df in (docs, odd):
            for r in module.score(df, model).select("text", "score").collect():
                scores.append(r["score"])
                assert abs(r["score"] - plain(r["text"], model)) < 1e-9, (module.__name__, r["text"])
        assert len(set(scores)) > 5


def test_labelled_rows_are_bounded(spark):
    """One id on very many rows is one row of the sample, with its least text."""
    docs = spark.range(5000).selectExpr("id % 3 AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(k, k % 2) for k in range(3)] + [(0, 1)], "doc_id long, toxic int")
    got = sorted((r["doc_id"], r["text"], r["y"]) for r in base.labelled_sample(docs, labels, "toxic", 1000, 999, 20).collect())
    assert got == [(0, "text 0", 1), (1, "text 1", 1), (2, "text 1001", 0)]
