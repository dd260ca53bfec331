import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from framelattice.llm import jaccard, mixing, packing, quality, toxicity

from .conftest import SF
from .test_first import check_mix, check_pieces
from .test_jaccard import brute

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        after_df = spark.read.parquet(f"{tmp_path}/{k}")
        after = [r.asDict() for r in after_df.collect()]
        ids = {r["doc_id"] for r in after}
        assert after
        if k < 4:
            assert after_df.columns == columns
        if name in ("toxicity", "quality"):
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            module, limit = (toxicity, 0.5) if name == "toxicity" else (quality, 0.7)
            scores = {r["doc_id"]: r["score"] for r in module.score(docs, module.train(docs, labels)).collect()}
            assert ids == {i for i, s in scores.items() if (s < limit) == (name == "toxicity")}
        if name == "near_duplicates":
            assert ids == {c for _, _, c in brute(before, 5, 80)} and len(after) == len(ids)
        if name == "mixing":
            took = Counter()
            for r in after:
                took[r["doc_id"]] += len(WORDS.findall(r["text"]))
            mixed = [r.asDict() for r in mixing.mix(docs, corpus_pipeline.MIX).collect()]
            assert dict(took) == {r["doc_id"]: r["taken"] for r in mixed if r["taken"]}
        if name == "packing":
            pieces, tokens = check_pieces(after, before)
            assert sum(r["length"] for r in after) == sum(map(len, tokens))
        docs = after_df
    got = corpus_pipeline.run(spark, SF)
    assert sorted(got.columns) == sorted([c for c in docs.columns if c != "ids"] + ["ids_crc32"])


def test_stages_on_odd_rows(spark, odd, empty, tmp_path):
    for name, df in (("odd", odd), ("empty", empty)):
        docs = df.select("doc_id", "text", "lang", "source", "n_chars")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
        assert (docs.count() == 0) == (name == "empty")


def test_keep_one_repeats(odd):
    kept = [r["doc_id"] for r in jaccard.keep_one(odd, jaccard.Join(words=5, percent=80)).collect()]
    assert Counter(kept) == Counter([1, 2, 3, 4, None, 6, 7, 8, 9])
    assert kept and 5 not in kept


def test_stages_send_small_batches(spark, tmp_path, monkeypatch):
    def sizes(spark, docs, sf_dir):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b""], pa.binary())], ["n", "ids"])

        return docs.select("text").mapInArrow(run, "n long, ids binary")

    spark.range(3000).selectExpr("id AS doc_id", "'a text' AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", sizes), ("last", lambda spark, docs, sf_dir: docs)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    n = [r["n"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(n) == 3000 and max(n) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_mixing_starts_one_python_step(spark, docs, monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("local rows go through Python workers of their own")

    monkeypatch.setattr(spark.sparkContext, "parallelize", refused)
    _, slots = mixing.lay_out(docs, mixing.Mix())
    asked = slots.where("block IS NOT NULL").groupBy("source_no", "block").count()
    assert asked._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert asked.count() > 0
