import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "pii", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        seen[name] = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id: r.text for r in seen["near_dedup"]}
    assert len(kept) == len(seen["near_dedup"]) < len(seen["quality"]) < len(whole)
    assert len({t for t in kept.values()}) == len(kept)
    clean = {r.doc_id: r.text for r in seen["pii"]}
    assert clean.keys() == kept.keys() and all("@mail" not in t for t in clean.values())
    assert {r.doc_id for r in seen["mixing"]} <= clean.keys()
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    starts = tokens.where("start = 0").count()
    assert starts == len(seen["mixing"])


def test_stages_of_odd_documents(spark):
    """Null texts, repeated rows, ids of several texts, clashing columns, and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.where("doc_id < 120")
    odd = some.unionByName(some.where("doc_id % 5 = 0")).unionByName(docs.where("doc_id between 120 and 130").withColumn("doc_id", F.col("doc_id") - 100))
    odd = odd.withColumn("text", F.when(F.col("doc_id") % 11 != 0, F.col("text"))).withColumns({"n": F.lit(1), "sha": F.lit("x"), "mix_size": F.lit("y"), "score": F.lit(2.0)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, odd, SF).cache()
        assert after.columns == odd.columns and {(r.n, r.sha, r.mix_size, r.score) for r in after.collect()} == {(1, "x", "y", 2.0)}
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in after.collect() if r.text is not None]
            texts = [t for _, t in rows]
            assert len(set(texts)) == len(texts) and {r.doc_id for r in odd.where("text is null").collect()} <= {r.doc_id for r in after.collect()}
        odd = after
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, SF)
    assert packed.where("start = 0").count() == odd.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
