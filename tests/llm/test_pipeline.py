"""Every stage is held against its operator's brute force on what the stage before kept."""

import re

import pytest
from llm_support import SF_SMALL, docs_of, few_partitions, lower  # noqa: F401
from test_decontam import brute as contaminated
from test_minhash import brute as components_of
from test_substrings import brute as cut_of

import corpus_pipeline as pipeline
from issuegrid.llm.quality import quality_scores


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out.append(docs)
    for k, (_, f) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, docs, SF_SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes
    for df in stages[:-1]:
        assert all(r.n_chars == len(r.text) for r in df.collect())


def test_quality_stage(spark, stages):
    good = {r.doc_id for r in quality_scores(stages[0], spark.read.parquet(f"{SF_SMALL}/labels.parquet")).collect() if r.score >= 0.5}
    assert texts(stages[1]) == {i: t for i, t in texts(stages[0]).items() if i in good}
    assert 0 < len(good) < stages[0].count()


def test_near_dedup_stage(stages):
    kept = components_of(list(texts(stages[1]).items()), 5, 80)
    assert texts(stages[2]) == {i: t for i, t in texts(stages[1]).items() if kept[i][2]}


def test_cut_stage(stages):
    before, after = texts(stages[2]), texts(stages[3])
    expect = cut_of(list(before.items()))
    assert before.keys() == after.keys()
    for i, t in after.items():
        n_bytes, removed, spans, _ = expect[i]
        assert n_bytes - removed <= len(t.encode()) <= n_bytes - removed + 6 * spans      # whole characters only
        assert t == before[i] if not removed else len(t) < len(before[i])


def test_decontamination_stage(spark, stages):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    bad = {x[0] for x in contaminated(list(texts(stages[3]).items()), bench) if x[5]}
    assert texts(stages[4]) == {i: t for i, t in texts(stages[3]).items() if i not in bad} and bad


def test_encoding_stage(stages):
    last, before = {r.doc_id: r for r in stages[5].collect()}, texts(stages[4])
    assert {i: r.decoded for i, r in last.items()} == before
    assert all(r.n_tokens == len(r.ids) for r in last.values())
    assert all(re.match(r"\S|\s|\Z", lower(t)) for t in before.values())


def test_run_gives_the_last_stage(spark, stages):
    assert sorted((r.doc_id, r.n_tokens) for r in pipeline.run(spark, SF_SMALL).collect()) == sorted((r.doc_id, r.n_tokens) for r in stages[5].collect())


def test_stages_take_clashing_columns_and_edge_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "some plain words of a text."), (3, "some plain words of a text."), (None, "other words, also plain."), (5, "é" * 300)])
    for _, f in pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = f(spark, df, SF_SMALL)
            out.collect()
            assert f is pipeline.encode or out.columns == docs.columns
