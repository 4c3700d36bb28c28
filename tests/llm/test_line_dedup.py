"""Line dedup against a plain version, and the properties of the alignment."""

import random

from policyflow.llm import line_dedup


def key(line):
    return line.replace("\t", " ").replace("\r", " ").strip(" ")


def without(text, marks, min_words=5):
    """The text without runs of marked lines (and the blank lines inside them) that hold enough words."""
    lines = text.split("\n")
    gone, k = set(), 0
    while k < len(lines):
        if k in marks:
            run = [k]
            while run[-1] + 1 < len(lines) and (run[-1] + 1 in marks or not lines[run[-1] + 1].split()):
                run.append(run[-1] + 1)
            k = run[-1]
            while not lines[run[-1]].split():
                run.pop()
            if sum(len(lines[j].split()) for j in run) >= min_words:
                gone.update(run)
        k += 1
    return "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)


def plain(rows):
    """Rows (doc_id, text, n_lines, n_removed) without Spark and without any alignment: a line goes if a smaller document has it."""
    owner = {}
    for i, t in rows:
        for x in t.split("\n") if i is not None and t is not None else ():
            owner[key(x)] = min(owner.get(key(x), i), i)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
        else:
            marks = {k for k, x in enumerate(t.split("\n")) if i is not None and key(x) and owner[key(x)] < i}
            out.append((i, *without(t, marks)))
    return sorted(out, key=str)


def test_rounds_reach_every_shared_line():
    draw = random.Random(5)
    for _ in range(1000):
        a = [draw.randint(1, 12) for _ in range(draw.randint(0, 20))]
        b = [draw.randint(1, 12) for _ in range(draw.randint(0, 20))]
        found = [k for part in line_dedup.rounds(a, b) for k in part]
        assert sorted(found) == [k for k, h in enumerate(b) if h in a]
    # in order: one alignment; two crossed blocks: two; a passage twice: the second time in a later round
    assert [len(x) for x in line_dedup.rounds([1, 2, 3, 4], [9, 1, 2, 8, 3, 4])] == [4]
    assert [len(x) for x in line_dedup.rounds([1, 2, 3, 4, 5], [4, 5, 1, 2, 3])] == [3, 2]
    assert len(list(line_dedup.rounds(list(range(1, 3000)), list(range(3000, 0, -1))))) == line_dedup.ROUNDS + 1


def test_patience_properties():
    draw = random.Random(3)
    for _ in range(2000):
        a = [draw.randint(0, 8) for _ in range(draw.randint(0, 15))]
        b = [draw.randint(0, 8) for _ in range(draw.randint(0, 15))]
        pairs = sorted(line_dedup.patience(a, b))
        assert all(a[p] == b[q] for p, q in pairs)
        assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
        unique = [x for x in set(a) if a.count(x) == 1 and b.count(x) == 1]
        if len(unique) == 1 and len(set(a) & set(b)) == 1:
            assert len(pairs) >= 1
    assert sorted(line_dedup.patience(list("abcde"), list("xabcyde"))) == [(0, 1), (1, 2), (2, 3), (3, 5), (4, 6)]


def test_blocks_and_blank_lines():
    text = "one two three\n\nfour five six\nkeep this\nshort"
    assert line_dedup._without(text, {0, 2, 4}, 5) == ("keep this\nshort", 5, 3)
    assert line_dedup._without(text, {4}, 5) == (text, 5, 0)
    assert line_dedup._without("", set(), 5) == ("", 1, 0)


def test_against_plain(spark):
    draw = random.Random(9)
    lines = [" ".join(draw.choice(["aa", "bb", "cc", "dd"]) for _ in range(draw.randint(1, 9))) + f" {k}" for k in range(60)]
    rows = []
    for i in range(120):
        if draw.random() < 0.3 and rows:
            t = draw.choice(rows)[1] or ""
            t = "\n".join(x for x in t.split("\n") if draw.random() > 0.15)
        else:
            t = "\n".join(draw.choice(lines) if draw.random() < 0.5 else f"own line {i} {k} with words" for k in range(draw.randint(0, 12)))
        rows.append((i, t))
    rows += [(3, rows[3][1]), (3, "another version\n" + rows[4][1]), (7, None), (None, rows[5][1]), (200, ""), (201, "\n\n \t"), (202, "\r\n".join(lines[:6])), (203, "x " * 20000)]
    frame = spark.createDataFrame([(i, t, "clash", 1.5) for i, t in rows], "doc_id long, text string, n_lines string, marks double")
    out = line_dedup.clean(frame)
    assert out.columns == ["doc_id", "text", "marks", "n_lines", "n_removed"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()), key=str) == plain(rows)


def test_one_copy_stays(spark):
    passage = "\n".join(f"line {k} of a passage that many documents share" for k in range(5))
    rows = [(i, f"intro number {i} is its own\n{passage}\nend number {i} is its own") for i in range(50)] + [(100 + i, passage) for i in range(50)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == rows[0][1] and all(out[i] == f"intro number {i} is its own\nend number {i} is its own" for i in range(1, 50))
    assert all(out[100 + i] == "" for i in range(50))
    assert line_dedup.clean(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_crossed_and_repeated_blocks(spark):
    one, two = ("\n".join(f"{name} line {k} that is long enough" for k in range(3)) for name in ("one", "two"))
    rows = [
        (1, f"{one}\nbetween them stands a line of its own\n{two}"),
        (2, f"{two}\nown words of the second document here\n{one}"),
        (3, f"{one}\nown words of the third document here\n{one}"),
    ]
    kept = {1: rows[0][1], 2: "own words of the second document here", 3: "own words of the third document here"}
    clean = lambda data: {r["doc_id"]: r["text"] for r in line_dedup.clean(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert clean(rows) == kept
    # the same documents give the same result beside many more copies
    assert {i: t for i, t in clean(rows + [(10 + i, rows[0][1]) for i in range(60)]).items() if i < 10} == kept
