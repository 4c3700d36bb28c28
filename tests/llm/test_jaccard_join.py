"""Near duplicates against all pairs."""

import itertools
import random

import numpy as np
import pytest

from policyflow.llm import jaccard_join
from policyflow.llm.common import Tables
from tests.llm import brute


def corpus(seed, n=500):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda k: [draw.choice(vocabulary) for _ in range(k)]
    base, passage = [text(draw.randint(1, 120)) for _ in range(8)], text(14)
    rows = []
    for k in range(n):
        if draw.random() < 0.55:
            d = list(draw.choice(base))
            for _ in range(draw.randint(0, max(1, len(d) // 25))):
                d[draw.randrange(len(d))] = draw.choice(vocabulary)
            d += text(draw.randint(0, 9)) if draw.random() < 0.3 else []
        else:
            d = text(draw.randint(0, 60))
        if draw.random() < 0.4:
            at = draw.randint(0, len(d))
            d = d[:at] + passage + d[at:]
        rows.append((k, draw.choice([" ", "\n", "\t "]).join(d) if draw.random() > 0.02 else None))
    return rows + [(None, rows[3][1]), (5, rows[9][1]), (7, rows[7][1]), (900, "Ab c"), (901, "aB  C"), (902, "  "), (903, "q " * 30000)]


@pytest.mark.parametrize("sizes", [{}, {"region": 600, "shown": 300}])
def test_against_all_pairs(spark, sizes):
    rows = corpus(1)
    frame = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, node int, component_id string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(frame, **sizes).collect()), key=str)
    assert got == brute.near_duplicates(rows)


def test_representatives(spark):
    rows = corpus(2, 200)
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, mark string")
    out = jaccard_join.representatives(frame)
    assert out.columns == frame.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    firsts = {c for _, _, c in brute.near_duplicates(rows) if c is not None}
    assert {i for i, _ in kept if i is not None} == firsts
    assert set(kept) <= set(rows) and (None, rows[3][1]) in kept


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join(frame).collect() == [] and jaccard_join.representatives(frame).collect() == []


def test_region_links_connect_what_is_linked():
    draw = np.random.default_rng(5)
    limit = jaccard_join.Limit(80)
    for _ in range(60):
        centres = [np.unique(draw.integers(0, 400, 40)) for _ in range(3)]
        sets = []
        for _ in range(30):
            own = centres[draw.integers(0, 3)].copy()
            own[draw.random(len(own)) < draw.choice([0.02, 0.1, 0.2])] += 1000 + draw.integers(0, 50)
            sets.append(np.unique(own).astype(np.int64))
        parent = list(range(len(sets)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in itertools.combinations(range(len(sets)), 2):
            if limit.linked(len(np.intersect1d(sets[x], sets[y])), len(sets[x]), len(sets[y])):
                parent[root(x)] = root(y)
        want = [root(x) for x in range(len(sets))]
        found = jaccard_join.region_links(sets, limit)
        assert all(want[x] == want[y] for x, y in found)
        parent[:] = range(len(sets))
        for x, y in found:
            parent[root(x)] = root(y)
        assert len({root(x) for x in range(len(sets))}) == len(set(want))


def test_components(spark):
    draw = random.Random(8)
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(draw.randint(2000, 2100), draw.randint(2000, 2100)) for _ in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    frame = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    got = {r["node"]: r["component"] for r in jaccard_join.components(Tables(spark), frame).collect()}
    want = {x: root(x) for x in list(parent)}
    assert {x: c for x, c in got.items()} == {x: c for x, c in want.items() if x != c}
