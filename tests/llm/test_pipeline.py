"""Each stage of the pipeline against its operator on the rows it gets."""

import corpus_pipeline
from marketloom.llm import factor_quality, near_dup, secret_scan
from tests.oracle import DATA


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "secrets", "packing"]
    good = stages["quality"](spark, docs, DATA)
    assert good.columns == docs.columns
    want = {r.doc_id for r in factor_quality.scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == want and len(want) < docs.count()
    one = stages["near_duplicates"](spark, good, DATA)
    found = near_dup.similar(good).toPandas()
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(found.component_id)
    clean = stages["secrets"](spark, one, DATA)
    assert clean.columns == docs.columns and clean.count() == one.count()
    words = secret_scan.dictionary_of(one)
    assert not any(secret_scan.spans(r.text, words) for r in clean.collect())
    packed = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in clean.collect()}
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
