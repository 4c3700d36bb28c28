"""Stages of the pipeline on small rows against the plain versions; all queries on the smallest tables."""

import os

import pytest

import corpus_pipeline
from policyflow.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def rows_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        seen[name] = (rows_of(before), docs)
        assert name.startswith("BPE") or docs.columns == columns
    scored = {r["doc_id"]: r["predicted"] for r in QUERIES["op6_attention_bags"](spark, SF).collect()}
    before, after = seen["quality classifier"]
    assert rows_of(after) == [x for x in before if scored[x[0]] == 1]
    before, after = seen["line dedup"]
    lengths = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()}
    assert set(lengths) <= {i for i, _ in before} and all(len(t) == n for t, n in lengths.values())
    before, after = seen["n-gram Jaccard join"]
    assert sorted(rows_of(after)) == sorted(x for x in before if x[0] in {c for _, _, c in brute.near_duplicates(before)})
    before, after = seen["benchmark decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    from policyflow.llm.decontaminate import distance, most_edits

    hit = set()
    for i, t in before:
        own = brute.plain_words(t)
        for _, text in items:
            need = brute.plain_words(text)
            if distance(need, own, 99)[0] <= most_edits(len(need)):
                hit.add(i)
    assert hit and sorted(rows_of(after)) == sorted(x for x in before if x[0] not in hit)
    before, after = seen["BPE encoding and decoding"]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, _ in before)


def test_stages_take_odd_tables(spark):
    """Nulls, empty texts, repeated rows, extra columns with clashing names, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines int, mark string, component_id int"
    data = [
        (1, None, None, None, None, "s", 1, "m", 1), (2, "", "en", "a", 0, "s", 1, "m", 1), (None, "no id but text", "en", "a", 14, None, None, None, None),
        (3, "same words here and there and more", "en", "a", 34, "s", 1, "m", 1), (3, "same words here and there and more", "en", "a", 34, "s", 1, "m", 1),
    ]
    for rows in (data, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name.startswith("BPE") or out.columns == docs.columns
            assert out.count() <= len(rows)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < 200 and {"doc_id", "n_tokens", "ids", "ids_sha256"} <= set(out.columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLES.get(name), SF) == ""


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11))
