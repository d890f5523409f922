"""The stages, each on what the one before kept."""

import corpus_pipeline as P


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows
        if name != "mixing":
            assert len(rows) <= n and len({r["doc_id"] for r in rows}) == len(rows)
        else:
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
        n, docs = len(rows), spark.createDataFrame(rows, docs.schema)
    last = P.STAGES[4][1](spark, docs, sf).collect()
    assert len(last) == n and all(r["n_tokens"] == len(r["ids"]) // 4 for r in last)


def test_clashing_columns_pass_through(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd_docs
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd_docs.columns
    assert P.STAGES[4][1](spark, docs, str(tmp_path)).count() == docs.count()
