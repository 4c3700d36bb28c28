"""Repeated passages against plain Python."""

import random

import pytest

from policyflow.llm import passages


def plain(rows, size):
    """Sorted (doc_id, n_words, n_removed, kept) by sets of windows."""
    words = [[w.decode() for w in (t or "").encode().split()] for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - size + 1) if i is not None else ():
            run = tuple(w[k : k + size])
            first[run] = min(first.get(run, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def corpus(draw, n, size):
    vocabulary = [f"w{k}" for k in range(40)] + ["Größe", "é", "x y", "z "]
    text = lambda k: " ".join(draw.choice(vocabulary) for _ in range(k))
    shared = [text(draw.randint(size - 3, 3 * size)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [draw.choice(shared) if draw.random() < 0.5 else text(draw.randint(0, 2 * size)) for _ in range(draw.randint(0, 5))]
        if parts and draw.random() < 0.3:  # part of a passage
            own = draw.choice(shared).split(" ")
            a = draw.randrange(len(own))
            parts.append(" ".join(own[a : a + draw.randint(1, 2 * size)]))
        rows.append((draw.randrange(3 * n), draw.choice([" ", "\n", "\t \x0b"]).join(parts)))
    rows += [(r[0], r[1]) for r in rows[:5]]  # repeated rows
    rows += [(1000 + k, rows[k][1]) for k in range(5)]  # copies
    rows += [(rows[0][0], shared[0]), (None, shared[0]), (2000, None), (2001, ""), (2002, "same " * 400), (2003, "same " * 200), (2004, shared[0] + " " + shared[0]), (-5, "same " * 60)]
    return rows


@pytest.mark.parametrize("size", [50, 7])
def test_against_plain(spark, size):
    rows = corpus(random.Random(size), 80, size)
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, anchor string, n_removed int")
    want = plain(rows, size)
    got = passages.located(frame, size).collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in got), key=str) == sorted((w[:3] for w in want), key=str)
    assert sum(w[2] for w in want) > 100
    cleaned = passages.clean(frame, size)
    assert cleaned.columns == ["doc_id", "text", "anchor", "n_words", "n_removed"]
    assert sorted(((r["doc_id"], " ".join(w.decode() for w in (r["text"] or "").encode().split())) for r in cleaned.collect()), key=str) == sorted(((w[0], w[3]) for w in want), key=str)


def test_pieces_slices_and_the_hot_passage(spark, monkeypatch):
    """Small pieces and slices, one passage in every document."""
    draw = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(130))
    rows = [(i, " ".join(f"d{i}x{k}" for k in range(draw.randint(0, 30))) + " " + passage + f" end{i}") for i in range(60)]
    monkeypatch.setattr(passages, "SLICE", 4000)
    monkeypatch.setattr(passages, "PIECE", 9)
    out = {r["doc_id"]: r["n_removed"] for r in passages.located(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == 0 and all(out[i] == 130 for i in range(1, 60))


def test_automaton_compares_words():
    own = passages.Automaton([1], [" ".join(f"a{k}" for k in range(60))], 50)
    text = [f"a{k}" for k in range(60)]
    assert own.covered(2, text).all() and not own.covered(1, text).any() and not own.covered(0, text).any()
    text[30] = "other"
    assert not own.covered(2, text).any()
    assert passages.Automaton([], [], 50).covered(2, text).sum() == 0


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert passages.located(frame).collect() == [] and passages.clean(frame).collect() == []
