"""The pipeline's stages, each against its operator's own verdicts."""

import corpus_pipeline

from pixelgrove.llm import neardup, pii, tiling, toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "encoding"]
    before, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns
        seen.append((before, after))
        before = after
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    (a, b), (_, c), (_, d), (_, e) = seen
    assert ids(a) - ids(b) == ids(toxicity.toxicity(a, labels).filter("predicted = 1"))
    assert ids(c) == ids(neardup.near_duplicates(b, words=5, percent=80).filter("kept"))
    assert ids(c) - ids(d) == ids(tiling.contamination(c, items))
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in e.collect()} == {i: ((x := pii.redact(t, pii.find_spans(t)[1])), len(x)) for i, t in texts.items()}
    last = corpus_pipeline.STAGES[-1][1](spark, e, sf).collect()
    assert {r["doc_id"] for r in last} == set(texts) and all(r["round_trip"] for r in last)


def test_odd_rows(spark, sf, tmp_path, odd, none):
    """Nulls, empties, repeats, extra columns and an empty table through all stages."""
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    for name, docs, ids in (("odd", odd, [None, 1, 2, 3, 6, 7, 8]), ("none", none, [])):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        items.write.parquet(f"{d}/benchmark.parquet")
        before = spark.read.parquet(f"{d}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            after = stage(spark, before, d)
            assert after.columns == before.columns
            after.write.parquet(f"{d}/{k}.parquet")
            before = spark.read.parquet(f"{d}/{k}.parquet")
        rows = corpus_pipeline.STAGES[-1][1](spark, before, d).collect()
        assert sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i)) == ids
        assert all(r["round_trip"] is None if r["ids"] is None else r["round_trip"] for r in rows)
        assert corpus_pipeline.run(spark, d).count() == len(ids)
