"""License scans (native columns only): base phrases everywhere, and templates found through one positional index of their rare words."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening or notice wording of common licences, with the key phrases that must stand in a match.
TEMPLATES = {
    "mit": ("released under the mit license", ["mit license"]),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                 "documentation files the software to deal in the software without restriction", ["permission is hereby granted"]),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license"]),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", ["general public license", "version 2"]),
    "lgpl": ("licensed under the gnu lesser general public license", ["lesser general public license"]),
    "agpl": ("licensed under the gnu affero general public license", ["affero general public license"]),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", ["redistribution and use"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
            ["permission to use copy modify"]),
    "cc-by-nc": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-sa": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights", ["waived all copyright"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    "bsd-disclaimer": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
                       "the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ["copyright holders and contributors"]),
    "bsd-names": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
                  "software without specific prior written permission", ["endorse or promote products"]),
    "mit-warranty": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
                     "fitness for a particular purpose and noninfringement", ["warranties of merchantability"]),
    "apache-notice": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
                      "warranties or conditions of any kind either express or implied", ["applicable law or agreed"]),
    "gpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
                   "free software foundation", ["general public license", "free software foundation"]),
    "gpl-warranty": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability "
                     "or fitness for a particular purpose", ["hope that it will be useful"]),
    "eclipse": ("this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    "boost": ("distributed under the boost software license version 1 0", ["boost software license"]),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the "
             "use of this software", ["authors be held liable"]),
    "artistic": ("the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some "
                 "semblance of artistic control", ["artistic control"]),
    "cc-by-long": ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    "cc-by-sa-long": ("this work is licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike"]),
    "cc-by-nd-long": ("this work is licensed under a creative commons attribution noderivatives 4 0 international license", ["attribution noderivatives"]),
    "wtfpl": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name "
              "is changed", ["verbatim or modified copies"]),
    "proprietary": ("this software is the confidential and proprietary information of", ["confidential and proprietary"]),
}

# Java pattern of what is not a word. The words are those of the lower-cased text: A-Z counts as letters here.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def idf(templates: dict) -> dict[str, float]:
    """Inverse template frequency of each template word."""
    seen = Counter(w for text, _ in templates.values() for w in set(text.split()))
    return {w: math.log((1 + len(templates)) / n) for w, n in seen.items()}


def rare_words(templates: dict, count: int) -> dict[str, list[tuple[int, str]]]:
    """Each template's `count` words of highest idf, as (position, word), highest first."""
    weight = idf(templates)
    return {name: sorted(enumerate(text.split()), key=lambda p: (-weight[p[1]], p[0]))[:count] for name, (text, _) in templates.items()}


def _bound(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(docs: DataFrame, templates: dict | None = None, base: dict | None = None, rare: int = 4, least: float = 0.6) -> DataFrame:
    """Licence findings of every document, row by row: no shuffle, and work in proportion to the words that hit (times their logarithm).

    Words that occur in a phrase, among a template's `rare` rarest words or in a key phrase are kept with their positions. One posting list
    has, for each rare word, the templates that hold it and its place there; every hit so proposes starts, and the proposals of all
    templates are counted together. A start that `least` of its template's rare words agree on is verified: every key phrase must begin
    within the stretch. Going through starts and key phrases from the end of the text, the next place of each phrase is known.

    Output: the input columns, n_words, n_base, first_word, last_word, base_labels, labels (base ones and found templates), score (highest
    share of a found template, 1 with a base phrase, else half the highest share of any template). Null and empty texts have no words and
    score 0; an empty table gives no rows; input columns named like an output are replaced.
    """
    templates, base = TEMPLATES if templates is None else templates, BASE if base is None else base
    anchors = rare_words(templates, rare)
    names_of = list(templates)
    keys = sorted({k for _, ks in templates.values() for k in ks})
    vocabulary = sorted({w for p in base for w in p.split()} | {w for r in anchors.values() for _, w in r} | {w for k in keys for w in k.split()})
    sizes = [len(anchors[t]) for t in names_of]
    needs = [next((m for m in range(1, n + 1) if m / n >= least), n + 1) for n in sizes]
    postings = [[(t, pos) for t, name in enumerate(names_of) for pos, x in anchors[name] if x == w] for w in vocabulary]

    def ints(values) -> Column:
        return F.array(*[F.lit(int(v)) for v in values]).cast("array<int>")

    def table(rows) -> Column:
        return F.array(*[ints(r) for r in rows]) if rows else F.array().cast("array<array<int>>")

    template_at, offset_at = table([[t for t, _ in p] for p in postings]), table([[o for _, o in p] for p in postings])
    length_of, need_of, size_of = ints([len(text.split()) for text, _ in templates.values()]), ints(needs), ints(sizes)
    keys_of = table([[keys.index(k) for k in ks] for _, ks in templates.values()])

    def lower(c: Column) -> Column:
        return F.translate(c, UPPER, LOWER)

    def hits_of(words: Column) -> Column:
        known = F.transform(words, lambda w, i: F.when(F.lower(w).isin(vocabulary), F.struct(i.cast("int").alias("i"), lower(w).alias("w"))))
        # A word like the Kelvin sign is no template word although lower() makes it one.
        return F.filter(known, lambda x: x.isNotNull() & x["w"].isin(vocabulary))

    words = F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), BETWEEN), "")
    read_once = _bound(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n"), hits_of(ws).alias("hits")))

    def at(hits: Column, phrase: list[str], place: Column) -> Column:
        """The phrase's words stand consecutively from the hit at this index on."""
        ok = F.get(hits, place)["w"] == phrase[0]
        for j, w in enumerate(phrase[1:], 1):
            ok = ok & (F.get(hits, place + j)["w"] == w) & (F.get(hits, place + j)["i"] == F.get(hits, place)["i"] + j)
        return F.coalesce(ok, F.lit(False))

    def places(hits: Column, phrase: str) -> Column:
        """Positions where a phrase stands."""
        p = phrase.split()
        return F.filter(F.transform(hits, lambda x, k: F.when((x["w"] == p[0]) & at(hits, p, k), x["i"])), lambda i: i.isNotNull())

    def proposed(hits: Column) -> Column:
        """Sorted (start, template), one for each rare word that proposes it."""

        def starts(x: Column) -> Column:
            row = F.array_position(F.array(*map(F.lit, vocabulary)), x["w"]).cast("int") - 1
            offsets = F.get(offset_at, row)
            return F.transform(F.get(template_at, row), lambda t, k: F.struct((x["i"] - F.get(offsets, k)).alias("i"), t.alias("t")))

        return F.array_sort(F.flatten(F.transform(hits, starts)))

    def counted(votes: Column) -> Column:
        """(start, template, votes) once each: equal proposals lie side by side, and a template has at most `rare`."""
        same = lambda k, m, v: F.coalesce(F.get(votes, k + m) == v, F.lit(False)).cast("int")
        first = F.transform(votes, lambda v, k: F.when((k == 0) | (F.get(votes, F.greatest(k - 1, F.lit(0))) != v), F.struct(
            v["i"].alias("i"), v["t"].alias("t"), sum((same(k, m, v) for m in range(1, max(sizes, default=1))), F.lit(1)).alias("m"))))
        return F.filter(first, lambda x: x.isNotNull())

    def judged(hits: Column, starts: Column) -> Column:
        """(found, any): highest share of each template's verified starts, and of any start."""
        enough = F.filter(starts, lambda x: x["m"] >= F.get(need_of, x["t"]))
        # Falling positions; at one position a phrase (m = 0) comes before the starts.
        spot = lambda n: lambda i: F.struct((-i).alias("i"), F.lit(0).alias("m"), F.lit(n).alias("t"))
        phrases = [F.transform(places(hits, k), spot(n)) for n, k in enumerate(keys)]
        events = F.array_sort(F.concat(*phrases, F.transform(enough, lambda x: F.struct((-x["i"]).alias("i"), x["m"].alias("m"), x["t"].alias("t")))))
        none = F.struct(ints([1 << 30] * len(keys)).alias("next"), ints([0] * len(names_of)).alias("best"))

        def step(acc: Column, e: Column) -> Column:
            inside = F.forall(F.get(keys_of, e["t"]), lambda k: F.get(acc["next"], k) <= F.get(length_of, e["t"]) - e["i"])
            follow = F.when(e["m"] == 0, F.transform(acc["next"], lambda x, k: F.when(k == e["t"], -e["i"]).otherwise(x))).otherwise(acc["next"])
            best = F.when((e["m"] > 0) & inside, F.transform(acc["best"], lambda x, k: F.when(k == e["t"], F.greatest(x, e["m"])).otherwise(x))).otherwise(acc["best"])
            return F.struct(follow.alias("next"), best.alias("best"))

        found = F.transform(F.aggregate(events, none, step)["best"], lambda m, t: m / F.get(size_of, t))
        most = F.coalesce(F.array_max(F.transform(starts, lambda x: x["m"] / F.get(size_of, x["t"]))), F.lit(0.0))
        return F.struct(found.alias("found"), most.alias("any"))

    def report(hits: Column) -> Column:
        spots = F.struct(*[places(hits, p).alias(f"p{k}") for k, p in enumerate(base)])
        shares = _bound(_bound(proposed(hits), counted), lambda starts: judged(hits, starts))
        return F.struct(spots.alias("spots"), shares.alias("shares"))

    read = docs.withColumn("_s", read_once)
    read = read.withColumn("_r", F.when(F.size("_s.hits") > 0, _bound(F.col("_s.hits"), report)))
    spots = [F.coalesce(F.col(f"_r.spots.p{k}"), F.array().cast("array<int>")) for k in range(len(base))]
    every = F.concat(*spots)
    base_names = F.array(*[F.when(F.size(s) > 0, F.lit(b)) for s, b in zip(spots, base.values())])
    found = F.coalesce(F.col("_r.shares.found"), F.array().cast("array<double>"))
    extra = F.filter(F.transform(found, lambda x, t: F.when(x > 0, F.get(F.array(*map(F.lit, names_of)), t))), lambda x: x.isNotNull())
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.array_compact(a))), ",")
    score = F.greatest(F.lit(0.0), F.coalesce(F.array_max(found), F.lit(0.0)), F.coalesce(F.col("_r.shares.any"), F.lit(0.0)) / 2)
    new = {"n_words": F.col("_s.n"), "n_base": F.size(every).cast("long"), "first_word": F.array_min(every).cast("long"),
           "last_word": F.array_max(every).cast("long"), "base_labels": joined(base_names), "labels": joined(F.concat(base_names, extra)),
           "score": F.when(F.size(every) > 0, 1.0).otherwise(score)}
    keep = [c for c in docs.columns if c not in new]
    return read.select(*keep, *[c.alias(k) for k, c in new.items()])
