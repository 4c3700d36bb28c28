"""Hard negatives against plain Python."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from policyflow.llm import hard_negatives as hn


def plain(rows, positives=5, negatives=10, low=30, high=90, dim=8):
    """Sorted result rows; rows: (vec_id, label, vector)."""
    whole = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) for x in v) or len(v) != dim:
            continue
        whole[i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = True
    own = list(whole)
    out = []
    for a, label, v in own:
        if a % 10:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, c) for i, c, w in own if i != a)
        for s, i, c in [x for x in scores if x[2] == label][:positives]:
            fits = [(t, j) for t, j, d in scores if d != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, i, n, j, -s, -t) for n, (t, j) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def clusters(seed, n=400, dim=8):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dim))
    rows = []
    for i in range(n):
        k = int(draw.integers(6))
        rows.append((i, int(draw.integers(4)) if i % 3 else k % 4, (centres[k] + 0.4 * draw.normal(size=dim)).tolist()))
    same = rows[7][2]
    rows += [(n + k, k % 3, same) for k in range(120)]  # one vector that many share
    rows += [(n + 200, 1, [0.0] * dim), (n + 201, 2, None), (n + 202, None, same), (None, 1, same), (n + 203, 1, [math.nan] * dim), (n + 204, 1, [None, *same[1:]]),
             (n + 205, 1, [math.inf] * dim), (n + 206, 1, [1.0]), (n + 207, 1, []), rows[10], rows[10]]
    return rows


def mined(spark, rows, **given):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, label int, embedding array<float>, cell string, akey int")
    out = hn.mine(frame.repartition(4), F.col("vec_id") % 10 == 0, **given)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def test_against_plain(spark):
    rows = clusters(1)
    want = plain(rows)
    assert len(want) > 500
    assert mined(spark, rows) == want
    assert mined(spark, rows, cells=16, block=20) == want


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0, 2.0])]) == []  # no anchor
    few = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.0]), (3, 2, [0.95, 0.0]), (4, None, [0.5, 0.0])]
    assert mined(spark, few) == [(0, 1, 1, 2, 65536, 32768)] == plain(few, dim=2)


def test_bounds_hold():
    draw = np.random.default_rng(2)
    x, q = draw.integers(-300, 300, (500, 6)), draw.integers(-300, 300, (40, 6))
    x[:50] = x[0]
    square = float((x**2).sum(axis=1).max()) * (1 + 1e-9)
    tree = hn.Tree(x, square)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(500))
    row = {"vec_ids": np.arange(500, dtype="<i8").tobytes(), "labels": np.zeros(500, "<i8").tobytes(), "vectors": x.astype("<i8").tobytes(), **tree.packed()}
    block = hn.Block(row, square)
    low, high, reached = block.leaves(hn.Bounds(q, square), lambda a, b: np.ones(a.shape, bool))
    assert reached.all()
    exact = q @ x.T
    for k, leaf in enumerate(tree.leaves):
        assert (exact[:, leaf].min(axis=1) >= low[:, k]).all() and (exact[:, leaf].max(axis=1) <= high[:, k]).all()
    # levels shrink, and what a level covers lies inside its angle
    for above, below in zip(tree.levels, tree.levels[1:]):
        assert all(radius <= above[parent][1] / hn.SHRINK + 1e-6 for _, radius, parent, _ in below)


def test_descent_skips_nodes(spark):
    """On clustered rows most leaves are excluded by their bounds."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 8)) * 300
    x = np.floor(np.concatenate([c + draw.normal(size=(50, 8)) * 3 for c in centres])).astype(np.int64)
    square = float((x**2).sum(axis=1).max()) * (1 + 1e-9)
    tree = hn.Tree(x, square)
    block = hn.Block({"vec_ids": np.arange(len(x), dtype="<i8").tobytes(), "labels": np.zeros(len(x), "<i8").tobytes(), "vectors": x.astype("<i8").tobytes(), **tree.packed()}, square)
    exact = x[:20] @ x.T
    floors = np.sort(exact, axis=1)[:, -5][:, None]
    reached = block.leaves(hn.Bounds(x[:20], square), lambda low, high: high >= floors)[2]
    assert reached.mean() < 0.3


def test_large_products_are_exact():
    big = np.array([[1 << 29, 3], [(1 << 29) - 1, 5]])
    block = hn.Block.__new__(hn.Block)
    block.vectors = big
    assert block.scores(big, np.array([0, 1])).tolist() == [[(1 << 58) + 9, (1 << 58) - (1 << 29) + 15], [(1 << 58) - (1 << 29) + 15, ((1 << 29) - 1) ** 2 + 25]]
