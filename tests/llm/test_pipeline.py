"""The pipeline against a brute-force version of its stages."""

from collections import Counter

import corpus_pipeline
from helixframe.llm import quality
from helixframe.llm.tokens import default_tokenizer
from tests.llm import brute


def test_stages_keep_columns_and_take_effect(spark, folder, rows, items):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        after = Counter((r.doc_id, r.text) for r in docs.collect())
        if stage is corpus_pipeline.keep_quality:
            kept = quality.quality_measures(spark.createDataFrame(before, "doc_id long, text string").withColumnRenamed("text", "t"), "t").where("kept").select("doc_id")
            assert Counter(i for i, _ in after.elements()) == Counter(r.doc_id for r in kept.collect())
        elif stage is corpus_pipeline.drop_near_duplicates:
            want = Counter(d for d, (i, _, c) in zip(before, brute.jaccard(before, 5, 80), strict=True) if i is None or i == c)
            assert after == Counter({d: n if d[0] is None else 1 for d, n in want.items()})
        elif stage is corpus_pipeline.drop_contaminated:
            want = Counter(d for d, r in zip(before, brute.contamination(before, items), strict=True) if not r[-1])
            assert after == want
        else:
            assert set(after) <= set(before) and max(after.values(), default=0) <= 4
    found = Counter(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect())
    assert found == Counter(brute.token_ids([(r.doc_id, r.text) for r in docs.collect()], default_tokenizer()))


def test_run(spark, folder, empty):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
    assert corpus_pipeline.run(spark, empty).collect() == []
