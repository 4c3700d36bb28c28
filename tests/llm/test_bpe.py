"""Tree-joined encoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from policyflow.llm import bpe

PIECES = [
    "a", "b", "'s", "'ll", "'", " ", "  ", "\n", "\t", "1", "22", "é", "ß", "漢", "字", "👍🏽", "###", "<|endoftext|>", "<|endo", "ftext|>", "the", "ing", "aaaa", "ʼ", "!",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_join_is_exact(library):
    draw, own = random.Random(1), bpe.Codec(bpe.vocabulary_path())
    for _ in range(600):
        text = "".join(draw.choice(PIECES) * draw.choice([1, 1, 1, 2, 30]) for _ in range(draw.randint(1, 120)))
        if draw.random() < 0.3:
            text = text.replace(" ", "").replace("\n", "")
        own.leaf, own.reach = draw.choice([3, 7, 24, 100]), draw.choice([2, 8, 24])
        assert own.encode(text).tolist() == ids_of(library, text), text
        assert own.decode(own.encode(text)) == text


def test_unsplit_text(library):
    draw, own = random.Random(2), bpe.Codec(bpe.vocabulary_path())
    for text in ("ab" * 20_000, " " * 20_000 + "x", "".join(draw.choice("abcdefgh") for _ in range(40_000))):
        assert own.encode(text).tolist() == ids_of(library, text)


def test_operator(spark, library):
    long = "word after word, é 漢 " * 60 + "x" * 900
    data = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, long), (4, long), (4, long), (5, long[::-1])]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in data], "doc_id long, text string, ids string, n_tokens int")
    out = bpe.encode(docs, bpe.vocabulary_path(), part=100)
    want = []
    for i, t in data:
        ids = ids_of(library, t or "")
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = sorted(((r["doc_id"], r["text"]) for r in bpe.decode(out, bpe.vocabulary_path()).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t in data), key=str)
    assert all(len(np.frombuffer(r["ids"], "<i4")) == r["n_tokens"] for r in out.collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, bpe.vocabulary_path()).collect() == []
