"""The algebra of the vectors, accuracy on held-out rows, and odd input."""

import os

import numpy as np
import pytest

from policyflow.llm import langid

SF = "/root/testdata/sf0.01"


def plain_bundle(text, dim):
    """Sum over all trigrams of the product of permuted letter vectors."""
    own = langid.letter_vectors(dim)[2].astype(int)
    numbers = langid.letter_numbers()
    letters = [0]
    for c in text.lower():
        n = int(numbers[ord(c)])
        if n or letters[-1]:
            letters.append(n)
    if letters[-1]:
        letters.append(0)
    out = np.zeros(dim)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        out += np.roll(own[a], 2) * np.roll(own[b], 1) * own[c]
    return out


def test_bundle():
    for text in ("Ab, cab!  x", "é漢字 é", "a", "mississippi " * 300, "İstanbul"):
        assert np.array_equal(langid.bundle(text, 64), plain_bundle(text, 64)), text
    assert langid.bundle("", 64) is None and langid.bundle("12 ...", 64) is None


def test_many_trigrams():
    draw = np.random.default_rng(1)
    text = "".join(chr(c) for c in draw.integers(0x4E00, 0x4E00 + 3000, 4000))
    small = langid.Trigrams(32)
    small.MOST = 100
    codes, counts = np.unique(draw.integers(0, langid.LETTERS**3, 500), return_counts=True)
    assert np.allclose(small.bundle(codes, counts), (counts[:, None] * small.bind(codes).astype(float)).sum(axis=0))
    assert np.array_equal(langid.bundle(text, 32), plain_bundle(text, 32))


def test_held_out(spark):
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    from policyflow.llm.queries import QUERIES

    rows = QUERIES["op7_hyperdimensional"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_odd_rows(spark):
    data = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "de"), (4, "the cat and the dog", "en"), (5, "der Hund und die Katze", "de"), (None, "the the", None), (4, "the cat and the dog", "en"), (6, "und " * 30000, None)]
    docs = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, lang string, score int")
    prototypes = langid.learn(docs)
    assert sorted(prototypes) == ["de", "en"]
    out = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(docs, prototypes).collect()), key=str)
    assert [x[:2] for x in out] == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de"), (6, "de"), (None, "en")], key=str)
    assert all(0 <= x[2] <= 1 for x in out)
    assert langid.learn(docs.limit(0)) == {} and {r["lang_pred"] for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.predict(docs.limit(0), prototypes).collect() == []
