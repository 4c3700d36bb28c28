"""Shared helpers against plain Python."""

import random

import numpy as np
import pyarrow as pa

from policyflow.llm import common
from tests.llm import brute

TEXTS = ["", " ", "a", "Ab  aB\tc\n", "é É\x0bx\x0cy\rz", " x y", "no\x1cbreak", "x" * 5000, "A b C d E f G", "a b", "漢字 a"]


def test_words_and_shingles():
    draw = random.Random(4)
    texts = TEXTS + ["".join(draw.choice("aB \t\né") for _ in range(draw.randint(0, 40))) for _ in range(300)]
    data, bounds = common.raw(pa.array(texts, pa.large_string()))
    hashes, at = common.word_hashes(data, bounds)
    seen = {}
    for t, a, b in zip(texts, at[:-1], at[1:]):
        own = brute.words(t)
        assert len(own) == b - a
        for w, h in zip(own, hashes[a:b].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    for t, s in zip(texts, common.shingle_sets(hashes, at, 5)):
        assert len(s) == len(brute.shingles(t)) and np.all(s[1:] > s[:-1])


def test_slices_cover_all_rows():
    bounds = np.array([0, 3, 3, 10, 500, 501, 502])
    for most in (1, 4, 1000):
        parts = list(common.slices(bounds, most))
        assert [x for a, b in parts for x in range(a, b)] == list(range(6))
    assert list(common.slices(np.array([0]))) == []


def test_fold(rows):
    ids = [0, 1, 17, -5, None]
    got = [r[0] for r in rows([(i,) for i in ids], "doc_id long").select(common.fold("doc_id", 3)).collect()]
    assert got == [brute.fold(i, 3) for i in ids]


def test_package_goes_to_executors(spark):
    common.bounded_batches(spark)
    assert "policyflow.zip" in spark.sparkContext._python_includes
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= common.BATCH_ROWS
