"""The pipeline stage by stage, and the checked queries against their SQL."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from checks.compare import connect, difference
from railpulse.llm import registry
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def test_stages_act_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).checkpoint()
        if name != "packing":
            assert docs.columns == columns
        seen[name] = (before, docs)
    before, after = (x.select("doc_id", "text").collect() for x in seen["line_dedup"])
    classes = plain.line_classes([tuple(r) for r in before])
    texts = {r.doc_id: r.text for r in after}
    assert len(after) == len(before)
    for r in before:
        kept = [x for n, x in enumerate((r.text or "").split("\n")) if r.text is not None and classes[(r.doc_id, n)] == (r.doc_id, n)]
        assert (texts[r.doc_id] or "") == "\n".join(kept)
    before, after = (x.select("doc_id", "text").collect() for x in seen["near_dedup"])
    want = {c for _, c in plain.near_components([tuple(r) for r in before]).values()}
    assert sorted(r.doc_id for r in after) == sorted(want)
    before, after = (x.select("doc_id").collect() for x in seen["mixing"])
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    before, after = seen["packing"]
    rows = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
    words = sum(len(plain.words(r.text)) for r in before.select("text").collect())
    packed = after.collect()
    assert sum(r.length for r in packed) == words and {r.doc_id for r in packed} == set(rows)


def test_the_pipeline_is_the_chain_of_its_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "bin_id", "length"} <= set(got.columns) and got.count() > 0


def test_stages_on_odd_rows_and_empty_tables(spark, frame, odd_rows, sentence):
    a, b = sentence(60), sentence(60)
    odd = [*odd_rows, (20, a), (20, f"{b}\nq"), (None, f"{b}\nq"), (None, sentence(60)), (21, a)]
    for rows in (odd, []):
        docs = frame(rows)
        for name, stage in corpus_pipeline.STAGES[1:]:  # the first one learns from labels of its own folder
            columns, docs = docs.columns, stage(spark, docs, SF).checkpoint()
            assert docs.columns == columns or name == "packing"
        assert bool(docs.count()) == bool(rows)


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert difference(registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name])) is None
