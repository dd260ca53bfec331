"""Registered queries of the operators: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, chat, fingerprints, forest, jaccard, katz, licences, mixing, neighbours, packing, periodic, quality, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.c + y.c - i)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM links UNION SELECT r.a, links.b FROM r JOIN links ON links.a = r.b)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY 1) m ON m.a = d.doc_id"""

SAID = "</s>[INST] ok [/INST]"
OP4_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{SAID}'), (-1, 1, 'assistant', '{SAID}'))),
e AS (SELECT *, 23 + length(regexp_replace(r, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\2\\\3', 'g'))
  + length(regexp_replace(x, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\2\\\3', 'g')) AS f FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256, CAST(sum(f) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


@query("op1_jaccard_join", OP1_SQL)
def op1(spark, sf_dir):
    return jaccard.link(base.table(spark, sf_dir, "documents"), jaccard.Join(words=4, percent=85))


@query("op2_mix_sources")
def op2(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_pack")
def op3(spark, sf_dir):
    pieces = packing.pack(base.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op4_chat_format", OP4_SQL)
def op4(spark, sf_dir):
    extra = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string")
    turns = base.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(turns, vocabulary("byte_bpe_50k.json")))


@query("op5_license_scan")
def op5(spark, sf_dir):
    found = licences.scan(base.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def judged(scored: DataFrame, modulus: int, remainder: int, least: float) -> DataFrame:
    return scored.select("doc_id", base.held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


@query("op6_toxicity")
def op6(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(toxicity.score(docs, toxicity.train(docs, base.table(spark, sf_dir, "labels"))), 5, 0, 0.5)


@query("op7_quality")
def op7(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(quality.score(docs, quality.train(docs, base.table(spark, sf_dir, "labels"))), 4, 2, 0.7)


@query("op8_katz")
def op8(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, _ = katz.score(docs, ~base.held_out("doc_id", 5, 1))
    smoothed = F.col("base_log") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.5 * (F.col("vocabulary") + 1))
    return rows.select("doc_id", base.held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", smoothed.alias("base_score"), "score")


@query("op9_nearest_neighbours")
def op9(spark, sf_dir):
    return neighbours.nearest(base.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op10_fingerprints")
def op10(spark, sf_dir):
    f = fingerprints.fingerprint_edits(base.table(spark, sf_dir, "documents"))
    return f.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.as_text(F.col("hashes")).alias("fingerprint"),
                    fingerprints.as_text(F.col("edited_hashes")).alias("edited_fingerprint"),
                    fingerprints.likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
                    fingerprints.likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))


@query("op11_whitening")
def op11(spark, sf_dir):
    vectors = base.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors, "embedding", most=16)
    rows = whitening.whiten(vectors, "embedding", model)
    n, error, shares = (model.n, model.identity_error, [float(v) / model.trace for v in model.values]) if model else (0, 0.0, [])
    share = F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("place"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"),
                       F.lit(error).alias("identity_error"))


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents, by crc32 of the id (null: of an empty text), end in a repeated stretch of their own words."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(ws: Column) -> Column:
        n = F.size(ws)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, place(i))), " ")).otherwise("")

    words = F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), base.BLANKS), "")
    bound = F.get(F.transform(F.array(words), repeated), F.lit(0))
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, bound).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    found = periodic.find_runs(repeating(base.table(spark, sf_dir, "documents")), periodic.Runs(exponent=4, least=6), keep=["doc_id"])
    top = F.get(F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"])).when(
        a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int")), F.lit(0))
    text = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("top", top)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
                        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP12_SQL = OP1_SQL.replace(">= 4", ">= 2").replace("len(w) - 2", "len(w)").replace("i + 3", "i + 1").replace(">= 85", ">= 80").replace(
    "AS component_id", "AS component_id, d.doc_id <= coalesce(m.b, d.doc_id) AS kept")


@query("op12_lsh_forest", OP12_SQL)
def op12(spark, sf_dir):
    return forest.link(base.table(spark, sf_dir, "documents"), forest.Forest(words=2, percent=80))
