"""The pipeline and the registered queries."""

import collections
import re

import corpus_pipeline
from weftlog.llm import common, decontaminate, jaccard, quality, secrets
from weftlog.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = common.save(stage(spark, docs, SF))
        seen.append((name, docs, out))
        docs = out
    for _, before, after in seen[:-1]:
        assert after.columns == before.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    assert ids(b) == {r.doc_id for r in quality.judge(a).filter("kept").collect()}
    groups = jaccard.similar_groups(b, 5, 80, 100).collect()
    assert ids(c) == {r.component_id for r in groups}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(d) == {r.doc_id for r in decontaminate.overlaps(c, bench).filter("not contaminated").collect()}
    assert ids(e) == ids(d) == ids(f)
    for r in e.collect():
        assert not secrets.base_spans(r.text) and (r.text == texts[r.doc_id] or secrets.REDACTED in r.text) and r.n_chars == len(r.text)
    lengths = collections.Counter()
    for r in f.collect():
        lengths[r.sequence_id] += r.length
    assert max(lengths.values()) <= 2048


def test_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (1, text), (2, text + " x"), (3, text.upper()), (None, text), (4, "other " * 3), (1, "not the same " + " ".join(f"q{i}" for i in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(((r.doc_id or 0), r.text[:3]) for r in got) == [(0, "w0 "), (1, "not"), (1, "w0 "), (4, "oth")]


def test_run_and_queries(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES} == set(range(1, 11))
    for name in ("op2_license_scan", "op10_url_filter"):
        if name in QUERIES:
            assert QUERIES[name](spark, SF).count() > 0
