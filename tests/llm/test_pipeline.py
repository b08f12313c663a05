"""The pipeline's stages: what each one keeps."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda d: [r[0] for r in d.select("doc_id").collect()]
    before, columns = ids(docs), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = ids(docs)
        assert set(after) <= set(before)
        if name != "packing":
            assert docs.columns == columns
        if name in ("quality_rules", "near_dedup", "substring_dedup"):
            assert len(after) == len(set(after))
        if name == "substring_dedup":
            assert sorted(after) == sorted(before)
        before = after
    assert docs.where("length > 2048").isEmpty()
