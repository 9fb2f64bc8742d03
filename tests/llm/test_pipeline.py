import corpus_pipeline as cp


def test_stages_in_turn(spark, sf, rows):
    """Each stage's decisions against what its operator says of the same input."""
    from spinmill.llm import decontam, linededup, mixing, quality, similar
    from spinmill.llm.common import table

    docs = table(spark, sf, "documents")
    assert [f.__name__ for _, f in cp.STAGES] == ["keep_quality", "dedup_lines", "drop_near_duplicates", "decontaminate", "mix_sources"]
    kept = cp.keep_quality(spark, docs, sf)
    assert kept.columns == docs.columns
    judged = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, cp.trusted_ids(spark, sf)).collect()}
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(kept) == sorted(d for d, k in judged.items() if k)
    kept = kept.cache()
    lines = cp.dedup_lines(spark, kept, sf).cache()
    left = {r["doc_id"]: r["text"] for r in linededup.line_dedup(kept).collect() if r["text"].split()}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == left and lines.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    near = cp.drop_near_duplicates(spark, lines, sf).cache()
    groups = lines.select("doc_id", "text").join(similar.similar_groups(lines, "doc_id"), "doc_id").groupBy("group").agg({"doc_id": "min"}).collect()
    assert ids(near) == sorted(r["min(doc_id)"] for r in groups) and near.columns == docs.columns
    clean = cp.decontaminate(spark, near, sf).cache()
    found = {r["doc_id"]: r["n_hit"] for r in decontam.contamination(near, table(spark, sf, "benchmark")).collect()}
    assert ids(clean) == sorted(d for d, n in found.items() if not n) and clean.columns == docs.columns
    mixed = {r["doc_id"]: r["taken"] for r in cp.mix_sources(spark, clean, sf).collect()}
    assert mixed == {r["doc_id"]: r["taken"] for r in mixing.mix(clean).collect() if r["repeats"]}
    assert {r["doc_id"]: r["taken"] for r in cp.run(spark, sf).collect()} == mixed and mixed


def test_null_ids_and_empty_tables(spark, sf, frame, odd_rows):
    for _, stage in cp.STAGES:
        assert stage(spark, frame([]), sf).count() == 0
        assert stage(spark, frame(odd_rows), sf).count() <= len(odd_rows)
    assert cp.without(frame(odd_rows), spark.createDataFrame([(None,), (5,), (5,)], "doc_id bigint")).where("doc_id is null or doc_id = 5").count() == 0
