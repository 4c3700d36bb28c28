"""Collocations against plain Python."""

import collections
import random
import re

from policyflow.llm import collocations


def plain(rows, least, best, cover):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [q for q, n in f.items() if len(q) > len(p) and n >= least and 100 * n >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not longer:
                found.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, n, p, a, l, r, totals[lang], s) for n, (s, a, p, l, r) in enumerate(found[:best], 1)]
    return sorted(out)


def mined(spark, rows, **given):
    frame = spark.createDataFrame([(k, lang, text, "clash", 1.5) for k, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, w1 string, n double")
    out = collocations.mine(frame.repartition(3), **given)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in out.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    return sorted(tuple(r) for r in out.collect())


def corpus(seed, n=150):
    draw = random.Random(seed)
    words = ["The", "of", "New", "york", "city", "hall", "größe", " x", "a-b", "日本"] + [f"rare{k}" for k in range(200)]
    weights = [8] * 10 + [0.1] * 200
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(draw.randint(0, 30)):
            parts.append(draw.choice(["new York city hall", "of the", "", " "]) if draw.random() < 0.4 else " ".join(draw.choices(words, weights, k=draw.randint(1, 6))))
            parts.append(draw.choice([" ", "\t", ".", ", ", "\n", "\x0b", "\x0c", "?!", ";:"]))
        rows.append((draw.choice(["en", "en", "en", "de", None, "und"]), "".join(parts)))
    return rows + [("fr", None), ("fr", ""), (None, " . ,"), ("en", "over and over " * 3000), *rows[:5]]


def test_against_plain(spark):
    rows = corpus(1)
    for given in ({"least": 30, "best": 2000, "cover": 80}, {"least": 5, "best": 12, "cover": 50}):
        want = plain(rows, **given)
        assert len(want) > 5 and mined(spark, rows, **given) == want


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    """Bits that several pairs share only keep windows longer."""
    rows = corpus(2, 60)
    bits = collocations.bitmap
    monkeypatch.setattr(collocations, "bitmap", lambda keys: bits(keys, 1 << 15) | 0xFF)
    assert mined(spark, rows, least=10) == plain(rows, 10, 2000, 80)


def test_ties_and_nothing(spark):
    rows = [("en", "b a. a b. d c. c d. " * 40)]
    got = mined(spark, rows)
    assert [(r[1], r[2]) for r in got] == [(1, "a b"), (2, "b a"), (3, "c d"), (4, "d c")]
    assert mined(spark, []) == [] and mined(spark, [("en", None), (None, "")]) == []
    assert mined(spark, [("en", "a b. " * 29)]) == []


def test_wide_products(spark):
    """Counts whose products pass 64 bits."""
    big = 1 << 45
    grams = spark.createDataFrame([("en", ["a"], 3 * big), ("en", ["b"], 2 * big), ("en", ["a", "b"], big + 1)], "lang string, words array<string>, f long")
    row = collocations.scored(grams).first()
    assert (row["score"], row["l"], row["r"]) == (2_000_000 * (big + 1) // (5 * big), 3 * big, 2 * big)


def test_windows_end_before_rare_triples(spark, monkeypatch):
    """Every pair is frequent and no triple is: no window of three words is kept, and what is counted stays the same."""
    draw = random.Random(4)
    rows = [("en", " ".join(f"w{draw.randrange(12)}" for _ in range(400))) for _ in range(30)]
    kept, phrases = [], collocations.phrases
    monkeypatch.setattr(collocations, "phrases", lambda counted, least: kept.append(counted.filter("w3 <> ''").count()) or phrases(counted, least))
    assert mined(spark, rows) == plain(rows, 30, 2000, 80)
    assert kept == [0]
