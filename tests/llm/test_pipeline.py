"""The pipeline's stages, each against brute force on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
from tidemark.llm.common import written
from tidemark.llm.exact_dedup import drop_copies

from . import brute

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SMALL), "test-stage")
        assert out.columns == columns
        kept[name] = (rows(docs), rows(out))
        docs = out
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    before, after = kept["quality"]
    stay = {i for i, _ in after}
    judged = [(labels[i], i in stay) for i, _ in before if i in labels]
    assert sum(q == 1 and not s for q, s in judged) <= 0.02 * len(judged)
    assert sum(q == 0 and s for q, s in judged) <= 0.25 * max(1, sum(q == 0 for q, _ in judged))
    before, after = kept["exact"]
    assert sorted(i for i, _ in after) == sorted(r[0] for r in brute.exact(before) if r[3])
    before, after = kept["near"]
    assert sorted(i for i, _ in after) == sorted(i for i, _, c in brute.simhash(before) if i == c)
    before, after = kept["benchmark"]
    items = [r["text"].lower() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert {i for i, t in before if any(x in t.lower() for x in items)} == {i for i, _ in before} - {i for i, _ in after}
    before, after = kept["mix"]
    assert max(Counter(i for i, _ in after).values()) <= 2
    assert sum(len(brute.words(t)) for _, t in after) < 1.9 * sum(len(brute.words(t)) for _, t in before)


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a  b"), (1, "a b"), (1, "c"), (2, "a b"), (None, "a b"), (None, "d"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in drop_copies(docs).selectExpr("doc_id", "regexp_replace(text, ' +', ' ')").collect()))) == sorted(map(str, [(1, "a b"), (1, "c"), (None, "d"), (None, None)]))
