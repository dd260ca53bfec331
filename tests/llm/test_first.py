import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from framelattice.llm import chat, fingerprints, licences, mixing, neighbours, packing, queries

from .conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def check_mix(out, docs):
    """Sizes, targets and how near the taken words come to them."""
    sizes, source = defaultdict(int), {}
    for r in docs:
        sizes[r["source"]] += len(WORDS.findall(r["text"] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], mixing.Mix())))
    assert abs(sum(goal.values()) - min(1.5 * sum(sizes.values()), 2 * sum(sizes.values()))) < 1e-6
    taken = defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - goal[s]) <= 2 * mixing.Mix().block, (s, taken[s], goal[s])


def test_mix(spark, docs, odd, empty):
    got = rows(mixing.mix(docs))
    assert len(got) == docs.count()
    assert {r["doc_id"]: r["size"] for r in got} == {r["doc_id"]: len(WORDS.findall(r["text"])) for r in rows(docs)}
    check_mix(got, rows(docs))
    assert sorted(map(str, got)) == sorted(map(str, rows(mixing.mix(docs))))
    got = rows(mixing.mix(odd))
    assert len(got) == odd.count()
    check_mix(got, rows(odd))
    assert rows(mixing.mix(empty)) == []


def test_mix_texts(docs, odd, empty):
    how = mixing.Mix(block=64)
    took = {r["doc_id"]: r["taken"] for r in rows(mixing.mix(docs, how))}
    words = defaultdict(int)
    texts = {r["doc_id"]: r["text"] for r in rows(docs)}
    for r in rows(mixing.mix_texts(docs, how)):
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(WORDS.findall(r["text"]))
    assert {k: v for k, v in took.items() if v} == dict(words)
    assert mixing.mix_texts(odd, how).columns == odd.columns and mixing.mix_texts(odd, how).count() > 0
    assert mixing.mix_texts(empty, how).count() == 0


def test_permutation():
    import pandas as pd

    for n in (1, 2, 3, 17, 1000):
        p = mixing.permuted(pd.Series(range(n)), pd.Series([n] * n), pd.Series([5] * n))
        assert sorted(p) == list(range(n))


def check_pieces(got, docs, limits=packing.Limits()):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    seqs = defaultdict(list)
    ids = sorted(tuple(t.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in docs)
    parts = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"], r["doc_tokens"]].append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0] + [n for _, n in s])[:-1])
        assert sum(n for _, n in s) <= limits.tokens and len(s) <= limits.segments
    lengths = [sum(n for _, n in s) for s in seqs.values()]
    assert sum(limits.tokens - n for n in lengths if n & (n - 1)) <= 0.01 * sum(lengths)
    return sorted(tuple(x for _, p in sorted(v) for x in p) for v in parts.values()), ids


def test_pack(docs, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got, ids = check_pieces(rows(packing.pack(docs, path)), rows(docs))
    assert got == ids
    r = rows(packing.pack(odd, path))
    assert sum(x["length"] for x in r) == sum(len(i) for i in check_pieces(r, rows(odd))[1])
    assert packing.pack(empty, path).count() == 0


def test_pack_limits():
    rng = np.random.default_rng(1)
    out = defaultdict(list)
    lim = packing.Limits(128, 5, 64)
    p = packing.Packer(lim, 32, lambda key, start, n, seq, at: out[seq].append((key, start, n, at)))
    given = [(i, int(n), int(rng.integers(0, n + 1))) for i, n in enumerate(rng.integers(1, 400, 300))]
    for g in given:
        p.add(*g)
    p.end()
    seen = defaultdict(int)
    for s in out.values():
        assert len(s) <= 5 and sum(x[2] for x in s) <= 128
        assert sum(max(0, a + n - max(a, given[k][2])) for k, a, n, _ in s) <= 64
        for k, _, n, _ in s:
            seen[k] += n
    assert seen == {k: n for k, n, _ in given}


def test_pack_keeps_runs_of_short_texts(spark):
    """More empty and one-word texts in one partition than the pool holds."""
    texts = [None] * 700 + [""] * 700 + ["one"] * 1300 + [None] * 600
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = rows(packing.pack(df, public_tokenizers.path("word_bpe_49k.json")))
    assert sorted(r["doc_id"] for r in got if r["start"] == 0) == list(range(len(texts)))
    taken, seqs = defaultdict(int), defaultdict(list)
    for r in got:
        taken[r["doc_id"]] += r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    assert all(taken[r["doc_id"]] == r["doc_tokens"] for r in got)
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0] + [n for _, n in s])[:-1])
        assert sum(n for _, n in s) <= packing.Limits().tokens and len(s) <= packing.Limits().segments


def test_pack_full_pool_loses_nothing():
    """Pools below, at and above the segment limit."""
    for pool in (3, 5, 9):
        out = defaultdict(list)
        p = packing.Packer(packing.Limits(128, 5, 64), pool, lambda key, start, n, seq, at: out[seq].append((key, n)))
        for k in range(100):
            p.add(k, 1 + k % 3)
        p.end()
        taken = defaultdict(int)
        for k, n in (x for s in out.values() for x in s):
            taken[k] += n
        assert sorted(taken.items()) == [(k, 1 + k % 3) for k in range(100)]
        assert all(len(s) <= 5 for s in out.values())


def test_pieces_encode_as_texts(docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["It's ÀÉ×÷ª 3,000 don'T!!!'s", "é K ǅ İ ß ẞ", "a<|endoftext|>b c<|startoftext|>", "a<|ENDOFTEXT|>b <|endoftext|> <| <|", " x y\x1cz\x85", "中文 😀👍🏽 ½²", "x_y-z... ''s '",
             "ﬁ ﬁ", "", None, " ", "A1b22\n\tC_d\x00e \x7f", "abc", "def", "x" * 5000 + "! " + "y" * 300]
    texts += [r["text"] for r in docs.limit(50).collect()]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for most in (5, 400_000):
        c = packing.PieceIds(t, most)
        for _ in range(2):
            assert [ids.tolist() for _, ids in c.texts(pa.array(texts))] == want
        for x, ids in zip(texts, want):
            assert [i.tolist() for _, i in c.texts(pa.array([x], pa.string()))] == [ids]


def test_pieces_are_learned_once_and_many_at_a_time():
    """Pieces of 200,000 kinds: the tokenizer sees each once, joined to longer texts."""
    c = packing.PieceIds(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    plain, calls = c.plain, []

    class Counting:
        def encode_batch_fast(self, texts, **kw):
            calls.append(len(texts))
            return plain.encode_batch_fast(texts, **kw)

    c.plain = Counting()
    letters = "abcdefghijklmnopqrst"
    kinds = [letters[i % 20] + letters[i // 20 % 20] + letters[i // 400 % 20] + letters[i // 8000 % 25 % 20] + "u" * (i // 160_000) for i in range(200_000)]
    texts = pa.array([" ".join(kinds[k:k + 100]) for k in range(0, len(kinds), 100)])
    first = [ids.tolist() for _, ids in c.texts(texts)]
    assert 0 < sum(calls) <= len(kinds) / 100
    calls.clear()
    assert [ids.tolist() for _, ids in c.texts(texts)] == first and not sum(calls)


def test_pack_short_sequences_have_little_padding():
    """Segments run out long before tokens do: such a sequence is cut, not padded."""
    out, sums = defaultdict(int), defaultdict(int)

    def emit(key, start, n, seq, at):
        out[seq] += n
        sums[key] += n

    p = packing.Packer(packing.Limits(), 512, emit)
    for k in range(5000):
        p.add(k, 3)
    p.end()
    assert all(n == 3 for n in sums.values()) and len(sums) == 5000
    assert sum(4096 - n for n in out.values() if n & (n - 1)) <= 0.01 * sum(out.values())


def brute_chat(turns):
    conv = defaultdict(list)
    for r in turns:
        conv[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    out = {}
    for c, ts in conv.items():
        ts.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        loss = "".join(t for _, r, t in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat(spark):
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows(queries.op4(spark, SF))}
    said = "</s>[INST] ok [/INST]"
    given = rows(spark.read.parquet(f"{SF}/conversations.parquet")) + [{"conv_id": -1, "turn": k, "role": r, "text": said} for k, r in ((0, "user"), (1, "assistant"))]
    assert got == brute_chat(given)
    turns = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, "assistant", " <|end|><|turn|>assistant<|text|>\\<\\|x <\\\\|"), (1, 2, "assistant", "😀 é́\n\n"), (1, 2, "assistant", "😀 é́\n\n"),
             (2, None, None, "<"), (2, 5, "assistant", "<"), (2, 6, "a\n<|text|>", "|end|>"), (None, 1, "assistant", "x" * 200_000), (3, 1, "assistant", "  lead and trail  ")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS ids", "2 AS formatted")
    t = public_tokenizers.path("byte_bpe_50k.json")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows(chat.read_back(chat.format_chats(df, t)))}
    assert got == brute_chat(rows(df))
    assert chat.format_chats(df.where("1 = 0"), t).count() == 0


def brute_licence(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    spots = {lab: [i for i in range(len(w)) if w[i:i + len(p.split())] == p.split()] for p, lab in licences.BASE.items()}
    every = [i for s in spots.values() for i in s]
    return len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(k for k, s in spots.items() if s))


def test_licences(spark, docs, odd, empty):
    line = "This work is licensed under the GNU General Public License, version 3."
    extra = spark.createDataFrame([(100, line), (101, "cc-by! CC BY-NC 4.0 licensed under cc by nc 4.0"), (102, "Released under the MIT License. " * 50), (103, "licensed under the apache license")], "doc_id long, text string")
    for df in (docs, odd, extra):
        for r in rows(licences.scan(df)):
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licence(r["text"]), r["doc_id"]
            assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    labels = {r["doc_id"]: r["labels"] for r in rows(licences.scan(extra))}
    assert labels == {100: "gpl,gpl-3.0", 101: "cc-by,cc-by-nc", 102: "mit", 103: ""} | ({103: labels[103]} if labels[103] in ("", "apache-2.0") else {})
    assert licences.scan(empty).count() == 0


def brute_labels(text, least=0.6):
    """(labels, score) by trying every template at every start."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    phrase = lambda p, i: w[i:i + len(p.split())] == p.split()
    base = {lab for p, lab in licences.BASE.items() if any(phrase(p, i) for i in range(len(w)))}
    labels, found, top = set(base), 0.0, 0.0
    for name, rare in licences.rare_words(licences.TEMPLATES, 4).items():
        size, keys = len(licences.TEMPLATES[name][0].split()), licences.TEMPLATES[name][1]
        for start in range(-size, len(w)):
            share = sum(0 <= start + pos < len(w) and w[start + pos] == x for pos, x in rare) / len(rare)
            top = max(top, share)
            if share >= least and all(any(phrase(k, i) for i in range(max(0, start), start + size + 1)) for k in keys):
                labels.add(name)
                found = max(found, share)
    return ",".join(sorted(labels)), 1.0 if base else max(found, top / 2)


def test_licence_labels(spark, docs, odd):
    rng = np.random.default_rng(8)
    words = sorted({w for t, _ in licences.TEMPLATES.values() for w in t.split()})
    texts = []
    for k in range(60):  # scraps and whole templates, one word changed here and there, in any order
        parts = []
        for _ in range(rng.integers(1, 8)):
            t = licences.TEMPLATES[list(licences.TEMPLATES)[rng.integers(len(licences.TEMPLATES))]][0].split()
            t[rng.integers(len(t))] = words[rng.integers(len(words))]
            parts += t[rng.integers(3) * (k % 2):]
        texts.append(" ".join(parts))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    several = 0
    for df in (made, docs, odd):
        for r in rows(licences.scan(df.select("doc_id", "text"))):
            assert (r["labels"], round(r["score"], 9)) == (lambda a: (a[0], round(a[1], 9)))(brute_labels(r["text"])), r
            several += r["labels"].count(",") > 1
    assert several > 5


def test_licence_of_a_long_repeating_text(spark):
    """Every line is a notice: work grows with the text, not with its square."""
    import time

    line = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. "
    took = []
    for n in (500, 500, 4000):
        df = spark.createDataFrame([(1, line * n)], "doc_id long, text string")
        at = time.time()
        r = rows(licences.scan(df))[0]
        took.append(time.time() - at)
        assert r["labels"] == "mit-text" and r["n_words"] == 20 * n
    assert took[2] < 30 * max(took[1], 1)


def test_licence_without_its_rarest_word(spark):
    """Any of a template's rare words may be the changed one."""
    cases = []
    for name, r in licences.rare_words(licences.TEMPLATES, 4).items():
        text, keys = licences.TEMPLATES[name]
        words, inside = text.split(), {w for k in keys for w in k.split()}
        cases += [(name, " ".join(["zzz", *words[:pos], "program", *words[pos + 1:]])) for pos, w in r if w not in inside and len(r) == 4]
    cases += [("mpl-2.0", "this source program form is subject to the terms of the mozilla public license v 2 0"), ("", "terms form")]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(licences.scan(df))}
    for k, (name, text) in enumerate(cases):
        assert name in got[k]["labels"].split(","), (name, text)
        if name and not got[k]["n_base"]:
            assert got[k]["score"] == 0.75
    assert len(cases) > 12 and got[len(cases) - 1]["labels"] == ""


def test_nearest(spark):
    got = defaultdict(list)
    for r in rows(queries.op9(spark, SF)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    e = rows(spark.read.parquet(f"{SF}/embeddings.parquet"))
    ids, x = np.array([r["vec_id"] for r in e]), np.array([r["embedding"] for r in e], float)
    hit = n = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        best = [i for _, i in sorted((-v, i) for v, i in zip(s, ids) if i != q)[:20]]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1)) and len(mine) == 20
        assert all(abs(v - s[ids == i][0]) < 1e-12 for _, i, v in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hit, n = hit + len({i for _, i, _ in mine} & set(best)), n + 20
    assert hit / n >= 0.9


def test_nearest_odd(spark):
    v = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]), (8, [-3.0, 1.0]), (9, [float("inf"), 0.0]), (None, [1.0, 1.0]), (10, []), (20, [0.5, 0.1]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").selectExpr("*", "1 AS t", "2 AS score")
    from pyspark.sql import functions as F

    r = [(x["query_id"], x["rank"], x["vec_id"]) for x in rows(neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20))]
    assert sorted(r) == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (0, 4, 8), (20, 1, 1), (20, 2, 2), (20, 3, 0), (20, 4, 8)]
    assert neighbours.nearest(df.where("1 = 0"), F.col("vec_id") % 20 == 0, 20).count() == 0
    # Narrow buckets find next to nothing: the queries that lack rows are held against all.
    narrow = neighbours.Hashing(tables=1, functions=6, width=0.05, probes=1, chunk_rows=2)
    assert sorted((x["query_id"], x["rank"], x["vec_id"]) for x in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20, narrow).collect()) == sorted(r)


def brute_fingerprints(docs):
    ds = sorted(((r["doc_id"], r["text"] or "") for r in docs), key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))
    out = []
    for k, (i, t) in enumerate(ds):
        nxt = ds[(k + 1) % len(ds)][1]
        m = len(t) // 3
        out.append((i, len(t), hashlib.sha256((t[:len(t) - m] + nxt[:m]).encode()).hexdigest()))
    return sorted(out, key=str)


def plain_sketches(spark, texts):
    """(level, hashes) of texts by the definition, shingle by shingle; and each shingle's hash."""
    from pyspark.sql import functions as F

    out = []
    for t in texts:
        w = WORDS.findall(t or "")
        out.append([w[i:i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else [[" ".join(w)]] if w else [])
    kinds = sorted({tuple(x) for s in out for x in s})
    df = spark.createDataFrame([(k, list(x)) for k, x in enumerate(kinds)], "k long, w array<string>")
    h = F.when(F.size("w") == 3, F.xxhash64(*[F.get("w", F.lit(j)) for j in range(3)])).otherwise(F.xxhash64(F.get("w", F.lit(0))))
    of = {kinds[r["k"]]: r["h"] for r in df.select("k", h.alias("h")).collect()}
    bound = -(1 << 63) + (1 << 61)
    full = [{of[tuple(x)] for x in s} for s in out]
    return [(3 if len(s) > 64 else 0, sorted(h for h in f if len(s) <= 64 or h < bound)) for s, f in zip(out, full)], full


def test_sketches_merge_and_contain(spark):
    """Against the definition; unions at a common level; containment of short texts in long ones and likeness near the truth."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(5000)]
    long = [" ".join(rng.choice(vocabulary, n)) for n in rng.integers(600, 3000, 25)]
    texts = []
    for t in long:
        w = t.split()
        texts += [(t, " ".join(w[50:55])), (" ".join(w[:400]), t), (t, " ".join([*w[:300], *rng.choice(vocabulary, 300)])), (" ".join(w[:40]), " ".join(w[20:60])), ("", t), (None, " ")]
    df = spark.createDataFrame(texts, "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    df = df.select("a", "b", fingerprints.merged(F.col("a"), F.col("b")).alias("m"), fingerprints.likeness(F.col("a"), F.col("b")).alias("like"),
                   fingerprints.containment(F.col("a"), F.col("b")).alias("inside"), fingerprints.containment(F.col("b"), F.col("a")).alias("holds"))
    got = df.collect()
    (pa_, fa), (pb, fb) = plain_sketches(spark, [a for a, _ in texts]), plain_sketches(spark, [b for _, b in texts])
    bound, off, judged = -(1 << 63) + (1 << 61), [], 0
    for r, x, y, s, t in zip(got, pa_, pb, fa, fb):
        assert (r["a"]["level"], r["a"]["hashes"]) == x and (r["b"]["level"], r["b"]["hashes"]) == y
        level = max(x[0], y[0])
        assert r["m"]["level"] == level and r["m"]["hashes"] == sorted(h for h in s | t if not level or h < bound)
        for value, p, q in ((r["inside"], s, t), (r["holds"], t, s)):
            if value is not None:
                judged += 1
                assert p or value == 1.0
                if len(p) > 300 or not level and p:
                    off.append(abs(value - len(p & q) / len(p)))
                    assert level or off.pop() == 0
                if p and p <= q:
                    assert value == 1.0
        if s | t and len(s | t) > 300:
            assert abs(r["like"] - len(s & t) / len(s | t)) < 0.2
        elif not level and s | t:
            assert r["like"] == len(s & t) / len(s | t)
    assert np.mean(off) < 0.04 and judged > 200


def test_fingerprints(spark, docs, odd, empty):
    for df in (docs, odd, odd.where("doc_id = 5")):
        f = fingerprints.fingerprint_edits(df, slice_rows=3)
        got = rows(f.selectExpr("doc_id", "n_chars", "sha2(edited, 256) AS s", "hashes.hashes AS hashes"))
        assert sorted(((r["doc_id"], r["n_chars"], r["s"]) for r in got), key=str) == brute_fingerprints(rows(df))
        for r in got:
            assert r["hashes"] == sorted(set(r["hashes"]))
    assert fingerprints.fingerprint_edits(empty).count() == 0
    r = rows(queries.op10(spark, SF))
    assert np.mean([x["near_edited"] for x in r]) > np.mean([x["near_next"] for x in r]) + 0.2
    assert all(0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1 for x in r)
