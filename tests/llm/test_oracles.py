"""The queries with SQL against DuckDB on the smallest tables, where those are there; and the pipeline's stages in order."""

import os

import pytest

SF = "/root/testdata/sf0.001"
HERE = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@HERE
@pytest.mark.parametrize("name", ["op4_warc", "op7_fingerprints"])
def test_oracle(spark, name):
    import duckdb

    from tidelog.llm.queries import oracle_sql, queries

    db = duckdb.connect()
    for t in ("pages", "documents"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries()[name](spark, SF)
    want = db.sql(oracle_sql()[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


@HERE
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tidelog.llm import decontam, pii, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(d.columns == columns for d in seen[1:-1])
    ids = [{r.doc_id for r in d.select("doc_id").distinct().collect()} for d in seen]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4] == ids[5]
    scores = quality.classify_documents(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[1] == {r.doc_id for r in scores.where("selected").collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids[2] - ids[3] == {r.doc_id for r in decontam.contaminated(seen[2], bench).collect()}
    assert all(not pii.base_spans(r.text) for r in seen[4].collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "personal_data", "packing"]
