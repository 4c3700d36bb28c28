"""Items in documents against the edit distance to every place."""

import random

import numpy as np
import pyarrow as pa

from policyflow.llm import decontaminate
from policyflow.llm.common import raw
from tests.llm import brute


def test_distance():
    draw = random.Random(3)
    for _ in range(2000):
        a = [draw.randint(0, 5) for _ in range(draw.randint(1, 12))]
        b = [draw.randint(0, 5) for _ in range(draw.randint(0, 20))]
        least, end = decontaminate.distance(a, b, 3)
        assert least == brute.edit_inside(a, b) and 0 <= end <= len(b)


def test_walk_reads_words_in_order():
    windows = np.arange(1, 41, dtype=np.uint64).reshape(2, 20)
    walked = decontaminate.walk(windows, np.array([5, 6, 7], np.uint64))
    assert walked.shape == (3, 2, 60)
    for r in range(3):
        for w in range(2):
            read = [x for x in walked[r, w].tolist() if x]
            assert read == sorted(read) and set(read) <= set(windows[w].tolist()) and read[0] == windows[w, 0]


def items_and_docs(seed):
    draw = random.Random(seed)
    common_words, rare = ["the", "of", "and", "a", "to"], [f"w{k}" for k in range(3000)]
    text = lambda n: [draw.choice(common_words) if draw.random() < 0.4 else draw.choice(rare) for _ in range(n)]
    items = [(k, text(draw.randint(8, 50))) for k in range(30)] + [(90, ["the", "of"]), (91, ["w1", "w2", "w3"]), (92, ["w4", "w5", "w6", "w7"])]
    docs = []
    for i in range(150):
        words = text(draw.randint(0, 80))
        if i % 3 == 0:
            _, item = draw.choice(items)
            copy = list(item)
            for _ in range(draw.randint(0, int(0.3 * len(item)))):
                p = draw.randrange(len(copy))
                copy[p : p + 1] = draw.choice([[], [draw.choice(rare)], [draw.choice(rare), copy[p]]]) if len(copy) > 1 else copy[p : p + 1]
            at = draw.randint(0, len(words))
            words = words[:at] + copy + words[at:]
        docs.append((i, draw.choice([" ", ", ", "\n"]).join(w.upper() if draw.random() < 0.2 else w for w in words)))
    return docs, [(k, " ".join(w)) for k, w in items]


def test_against_all_places(spark):
    docs, items = items_and_docs(4)
    docs += [(None, items[0][1]), (500, None), (501, ""), (1, docs[1][1]), (502, "x " * 30000 + items[2][1])]
    benchmark = [*items, (None, "no id here at all"), (70, None), (71, ""), items[0]]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    held = spark.createDataFrame([(k, t, 1) for k, t in benchmark], "item_id long, text string, doc_id int")
    want = brute.items_in(docs[:-1], items) + brute.items_in([(502, items[2][1])], items)
    for blocks in (20_000, 7):
        got = [(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.find(frame, held, blocks).collect()]
        assert set(got) <= set(want) and len(set(got) & set(want)) >= 0.97 * len(set(want))
        assert {x for x in want if x[2] == 0} <= set(got)
        clean = decontaminate.clean(frame, held, blocks)
        assert clean.columns == frame.columns
        hit = {i for i, _, _ in got}
        assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted((i for i, _ in docs if i not in hit), key=str)


def test_recall_of_edited_items():
    draw = random.Random(6)
    words = lambda n: [np.uint64(draw.getrandbits(62)) for _ in range(n)]
    items = [(k, np.array(words(draw.randint(15, 60)), np.uint64)) for k in range(60)]
    tables = decontaminate.Tables(items)
    hits = []
    for k, item in items:
        for _ in range(4):
            copy = list(item)
            for _ in range(decontaminate.most_edits(len(item))):
                p, kind = draw.randrange(len(copy)), draw.randrange(3)
                copy[p : p + 1] = [[], words(1), [*words(1), copy[p]]][kind]
            text = np.array(words(30) + copy + words(30), np.uint64)
            hits.append(any(i == k for i, _, _ in decontaminate.matches([text], tables)[0]))
    assert np.mean(hits) >= 0.97


def test_recall_at_mixed_lengths():
    """Many short items beside few long ones, from 1 to 400 words."""
    draw = random.Random(7)
    words = lambda n: [np.uint64(draw.getrandbits(62)) for _ in range(n)]
    lengths = [8] * 400 + [12] * 200 + [1, 2, 3, 4, 5, 6, 7, 20, 40, 60, 80, 120, 160, 200, 200, 200, 250, 300, 350, 400, 400]
    items = [(k, np.array(words(n), np.uint64)) for k, n in enumerate(lengths)]
    tables = decontaminate.Tables(items)
    assert all(0 <= w <= decontaminate.MOST_WALKS for w in tables.walks.values()) and tables.walks[3] == 1
    hits = {"short": [], "long": []}
    for k, item in items[::40] + items[600:]:
        for _ in range(3):
            copy = list(item)
            for _ in range(decontaminate.most_edits(len(item))):
                p, kind = draw.randrange(len(copy)), draw.randrange(3)
                copy[p : p + 1] = [[], words(1), [*words(1), copy[p]]][kind]
            text = np.array(words(30) + copy + words(30), np.uint64)
            found = decontaminate.matches([text], tables)[0]
            assert all(i == k for i, _, _ in found)
            hits["long" if len(item) > 50 else "short"].append(bool(found))
    assert np.mean(hits["short"]) >= 0.97 and np.mean(hits["long"]) >= 0.97


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs, items).collect() == [] and decontaminate.clean(docs, items).count() == 1
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.find(docs.limit(0), some).collect() == []


def test_words():
    texts = ["Ab, c-d 1x", "", "é É"]
    hashes, at = decontaminate.plain_words(*raw(pa.array(texts, pa.large_string())))
    assert np.diff(at).tolist() == [len(brute.plain_words(t)) for t in texts]
