"""Gradients by differences, accuracy on held-out labels, and odd input."""

import os

import numpy as np
import pyarrow as pa
import pytest

from policyflow.llm import quality
from policyflow.llm.common import raw

SF = "/root/testdata/sf0.01"


def test_gradients():
    draw = np.random.default_rng(1)
    model = quality.Attention(n=5, hidden=4, gate=3)
    bounds = np.array([0, 1, 4, 9])
    x, label, pull = draw.standard_normal((9, 5)), np.array([0.0, 1.0, 1.0]), np.array([0.2, 0.3, 0.5])

    def loss():
        p = model.forward(x, bounds)[-1]
        return -(pull * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum()

    for part, gradient in zip(model.parts, model.gradients(x, bounds, label, pull)):
        for at in np.ndindex(part.shape):
            old = part[at]
            part[at] = old + 1e-6
            up = loss()
            part[at] = old - 1e-6
            down = loss()
            part[at] = old
            assert abs((up - down) / 2e-6 - gradient[at]) < 1e-6


def test_attention_weights_sum_to_one():
    model = quality.Attention()
    bounds = np.array([0, 3, 4, 40])
    weight = model.forward(np.random.default_rng(2).standard_normal((40, quality.N_FEATURES)), bounds)[3]
    assert np.allclose(np.add.reduceat(weight, bounds[:-1]), 1)


def test_passages_see_whole_texts():
    texts = ["", "a", " ".join(["word"] * 63), " ".join(["word"] * 64) + " LAST!!", "é " * 200]
    x, bounds = quality.passages(*raw(pa.array(texts, pa.large_string())))
    assert np.diff(bounds).tolist() == [1, 1, 1, 2, 4]
    assert not x[0].any() and np.isfinite(x).all() and x[bounds[3] + 1].any()


def test_held_out(spark):
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    from policyflow.llm.queries import QUERIES

    out = QUERIES["op6_attention_bags"](spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows) and out.count() == 1000


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "a " * 50000, "x"), (3, "a " * 50000, "x"), (4, "ok text", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 0), (4, None), (None, 1), (9, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
    kept = quality.score(docs, model, keep=True, into="__s")
    assert kept.columns == ["doc_id", "text", "score", "__s"] and kept.filter("score = 'x'").count() == 5
    none = quality.learn(docs, labels.limit(0))
    assert none is None and {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).collect() == [] and quality.learn(docs.limit(0), labels) is None


def test_learns_from_every_passage(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.Attention, "fit", lambda self, bags, label: seen.append(sorted(map(len, bags))) or self)
    docs = spark.createDataFrame([(k, "word " * (quality.PASSAGE_WORDS * k)) for k in (1, 60, 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (60, 1), (200, 0)], "doc_id long, quality int")
    quality.learn(docs, labels)
    assert seen == [[1, 60, 200]]
    quality.learn(docs, labels, at_most_bytes=1)  # the sample is smaller, its document whole
    assert len(seen[1]) == 1 and seen[1][0] in (1, 60, 200)
