"""The pipeline against the operators' own brute-force forms, and on odd tables."""

import re

import pyarrow as pa
import pytest

import corpus_pipeline
from batchwatch.llm.common import written
from test_corpus import brute_join
from test_scans import base_spans


def stages(spark, docs, sf_dir):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = written(stage(spark, docs, sf_dir), f"test-{name}")
    return out


def test_pipeline_equals_brute_force(spark, docs, sf_dir):
    got = stages(spark, docs, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert {r["doc_id"] for r in got["language"].collect()} == known
    first = {i for i, _, c, _ in brute_join([(i, texts[i]) for i in sorted(known)]) if i == c}
    assert {r["doc_id"] for r in got["near_duplicates"].collect()} == first
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i for i in first if not any(f" {t} " in f" {words(texts[i])} " for t in items)}
    assert {r["doc_id"] for r in got["decontamination"].collect()} == clean
    redacted = got["secrets"].collect()
    assert {r["doc_id"] for r in redacted} == clean and all(not base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in redacted)
    assert {r["doc_id"] for r in redacted if r["text"] != texts[r["doc_id"]]} == {i for i in clean if base_spans(texts[i])}
    assert {r["doc_id"] for r in got["tokens"].collect()} == clean
    assert all(got[n].columns == docs.columns for n in list(got)[:-1])


@pytest.mark.parametrize("source", ["edge", "empty"])
def test_pipeline_takes_odd_tables(request, spark, sf_dir, source):
    docs = request.getfixturevalue(source)
    got = stages(spark, docs, sf_dir)
    assert got["tokens"].count() == (0 if source == "empty" else got["secrets"].count())
    assert all(got[n].columns == docs.columns for n in list(got)[:-1])


def test_long_texts_reach_workers_in_small_batches(spark, empty, sf_dir):
    def sizes_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    for named, most in ((None, 9_000_000), ("1m", 2_000_000)):
        session = spark.newSession()
        if named:
            session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", named)
        corpus_pipeline.keep_first_of_class(session, session.createDataFrame([], empty.schema), sf_dir).collect()
        texts = session.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('0123456789', 1000) as text")
        sizes = [r["size"] for r in texts.mapInArrow(sizes_of, "size bigint").collect()]
        assert sum(sizes) >= 30_000_000 and max(sizes) <= most
