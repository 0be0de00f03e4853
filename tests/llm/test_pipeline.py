"""The pipeline's stages against brute force on the smallest tables."""

import collections

import corpus_pipeline
from gazette.llm import decontaminate
from tests.llm.test_operators import components, shingles


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small).cache()
        assert after.columns == columns
        seen[name] = ({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in after.collect()})
        docs = after
    before, after = seen["language_id"]
    assert all(any(c.isalpha() for c in t) for t in after.values()) and len(after) >= 0.99 * len(before)
    before, after = seen["line_dedup"]
    assert set(before) == set(after)
    for d, text in after.items():
        lines, kept = before[d].split("\n"), iter(text.split("\n"))
        assert collections.Counter(kept) <= collections.Counter(lines) or text == ""
    before, after = seen["jaccard_join"]
    top = components({d: shingles(t) for d, t in before.items()})
    assert after == {d: before[d] for d in before if top[d][1] == d}
    before, after = seen["decontaminate"]
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    left = spark.createDataFrame([(d, t) for d, t in after.items() if t != before[d]], "doc_id long, text string")
    again = {r.id: len(r.spans) for r in decontaminate.contamination(left, bench).collect()}
    assert sum(n > 0 for n in again.values()) <= 0.02 * max(1, len(again))
    packed = corpus_pipeline.best_fit_packing(spark, docs, small)
    assert {r.doc_id for r in packed.collect()} == set(after)


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
