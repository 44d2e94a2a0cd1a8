"""The pipeline on the smallest table, stage by stage."""

import corpus_pipeline
from tidewheel.llm.base import materialize

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert n >= sizes[0] >= sizes[1] >= sizes[2] > 0.5 * n
    assert len({r["doc_id"] for r in docs.select("doc_id").distinct().collect()}) <= sizes[2]
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert got.doc_id.nunique() == docs.select("doc_id").distinct().count()
