"""The pipeline at a small scale: decisions take effect, columns stay, and the result equals a plain version."""

import corpus_pipeline as P
from lumenix.llm import exact_dedup, language_id, minhash, quality
from lumenix.llm.common import table

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, D, "documents")
    columns = docs.columns
    kept = docs
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        out = P.materialize(stage(spark, kept, D), name)
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(before)
            break
        assert out.columns == columns
        after = {r["doc_id"] for r in out.collect()}
        if name == "language_id":
            m = language_id.fit(language_id.training_rows(kept))
            want = {i for i, t in before.items() if (p := language_id.predict(m, t))[0] != "und" and p[1] >= P.LANGUAGE_THRESHOLD}
        elif name == "quality":
            want = {r["doc_id"] for r in quality.classify(kept, table(spark, D, "labels")).where("predicted = 1").collect()}
        elif name == "exact_dedup":
            want = {r["doc_id"] for r in exact_dedup.dedup(kept).where("kept").collect()}
            bare = {i: "".join(t.split()) for i, t in before.items()}
            assert len(want) == len(set(bare.values()))
        else:
            want = {r["doc_id"] for r in minhash.near_duplicates(kept).where("kept").collect()}
        assert after == want and len(after) > 0.5 * len(before)
        kept = out
    assert P.run(spark, D).select("doc_id").distinct().count() == len(before)


def test_registered():
    from lumenix.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and len(P.STAGES) == 5


def test_an_empty_table_and_clashing_columns(spark, tmp_path):
    """No document gives no piece; columns with the operators' own names pass through the filters."""
    docs = table(spark, D, "documents").limit(0)
    for name, stage in P.STAGES:
        docs = stage(spark, docs, D)
        assert docs.count() == 0
    from pyspark.sql import functions as F

    names = ["kept", "keep_id", "node", "score", "component_id", "kept_doc_id", "repeated_id", "picked", "label"]
    few = table(spark, D, "documents").where("doc_id < 40").withColumns({n: F.lit(1) for n in names})
    for _, stage in P.STAGES[2:4]:
        assert stage(spark, few, D).columns == few.columns
