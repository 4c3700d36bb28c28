"""Scores against dictionaries, and contexts that sum to one."""

import random

import numpy as np
import pytest

from policyflow.llm import katz
from policyflow.llm.common import fold
from tests.llm import brute


def corpus():
    draw = random.Random(5)
    vocabulary = [f"W{min(int(draw.expovariate(0.02)), 300)}" for _ in range(2000)]
    rows = [(k, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 60)))) for k in range(300)]
    return rows + [(7, None), (None, "W1 w2 zz"), (9, ""), (9, ""), (1000, "w1 " * 5000), (1001, "never seen words")]


@pytest.mark.parametrize("rounds,tasks", [(8, 4), (3, 40)])
def test_against_dictionaries(spark, rounds, tasks):
    rows = corpus()
    model = brute.Katz([t for i, t in rows if i is not None and brute.fold(i, 5) != 1], 10**9)
    for context in list(model.after)[:20]:
        assert abs(sum(model.p(context, w) for w in model.unigram) - 1) < 1e-9
    want = sorted((model.row(i, t) for i, t in rows), key=str)
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, learn string, slice int").repartition(tasks)  # each a slice
    out = katz.score(frame, fold("doc_id", 5) != 1, rounds)
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out.collect()), key=str)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert np.allclose([x[4:] for x in got], [x[4:] for x in want], rtol=1e-9, atol=1e-9)


def test_nothing_learned(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    out = {r["doc_id"]: r for r in katz.score(frame, F.lit(False)).collect()}
    assert out[1]["n_tokens"] == 3 and out[1]["n_known"] == 0 and out[1]["train_tokens"] == 0 and np.isfinite(out[1]["score"])
    assert katz.score(frame.limit(0), F.lit(True)).collect() == []


def test_discounts():
    d = katz.discounts({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 5})
    assert np.all((d[1:] > 0) & (d[1:] < 1))
    # what is taken from small counts is what was seen once, as Good and Turing have it
    n = np.array([0, 100, 40, 20, 12, 8])
    assert abs(((1 - d) * np.arange(6) * n).sum() - 100) < 1e-9
    assert np.all(katz.discounts({}) == 1) and np.all(katz.discounts({1: 5, 6: 5}) == 1)


def test_every_learned_word_keeps_its_symbol(spark):
    draw = random.Random(8)
    # 70,000 words, each learned twice beside the same neighbour: no count is left above which fewer than 65,000 stand
    rows = [(k, " ".join(f"a{j} b{j}" for j in range(100 * k, 100 * k + 100))) for k in range(350)] * 2
    rows += [(1000 + k, " ".join(f"b{draw.randrange(35_000)}" for _ in range(5))) for k in range(3)] + [(2000, "a17 b17"), (2001, "a17 b18")]
    model = brute.Katz([t for i, t in rows if i < 1000], 10**9)
    from pyspark.sql import functions as F

    out = katz.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), F.col("doc_id") < 1000)
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    want = {i: model.row(i, t)[5] for i, t in rows[:2] + rows[700:]}
    assert all(abs(got[i] - want[i]) < 1e-9 * abs(want[i]) for i in want)
    assert got[2000] > got[2001]


def test_many_groups_and_split_contexts(spark):
    """Pairs are counted in groups that stay small; a frequent context lies in several, and its sums are added up."""
    rows = corpus()
    frame = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(7)
    model = brute.Katz([t for i, t in rows if i is not None and brute.fold(i, 5) != 1], 10**9)
    want = sorted((model.row(i, t) for i, t in rows), key=str)
    out = katz.score(frame, fold("doc_id", 5) != 1, rounds=2, group=300, split=20)
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out.collect()), key=str)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert np.allclose([x[4:] for x in got], [x[4:] for x in want], rtol=1e-9, atol=1e-9)


def test_each_slice_moves_once_to_be_scored(spark, monkeypatch):
    """Every round shuffled all slices again, which took more memory than an executor has; now a share of them goes at a time, and each once."""
    moved, own = [], katz.by_document

    def recorded(parts, *rest):
        moved.append([r["slice"] for r in parts.select("slice").collect()])
        return own(parts, *rest)

    monkeypatch.setattr(katz, "by_document", recorded)
    rows = corpus()
    # a frequent word whose only neighbour here was never learned, in a slice of its own
    rows = [(i, t) for i, t in rows if i != 1001] + [(None, "w1 neverlearned")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    model = brute.Katz([t for i, t in rows if i is not None and brute.fold(i, 5) != 1], 10**9)
    want = sorted((model.row(i, t)[::5] for i, t in rows), key=str)
    for split in (20, 10**9):
        moved.clear()
        got = sorted(((r["doc_id"], r["score"]) for r in katz.score(frame, fold("doc_id", 5) != 1, split=split).collect()), key=str)
        assert [x[0] for x in got] == [x[0] for x in want]
        assert np.allclose([x[1] for x in got], [x[1] for x in want], rtol=1e-9, atol=1e-9)
        every = [x for part in moved for x in part]
        assert len(every) == len(set(every)) and max(map(len, moved)) < len(every)
