"""Plain spans against the patterns as they are written; disguises by example."""

import random
import re

import pyarrow as pa

from policyflow.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_plain_spans():
    draw = random.Random(2)
    texts = ["".join(draw.choice("a@b.1 2+3-4()9.0-c@@..+%é") for _ in range(draw.randint(0, 40))) for _ in range(5000)]
    texts += ["1" * 3000 + ".1.1.1 " + "4" * 16, "a" * 3000, "@" * 3000, "+1" + " " * 3000, "1." * 1001, "4111 1111 1111 1111", "mail a.b@c.d.e, +49 151 234567"]
    for t in texts:
        assert plain(t) == [s[:3] for s in pii.find(t) if s[3]], t


def test_disguises():
    hidden = {
        "write john (at) mail7 dot example dot com now": ("email", "john (at) mail7 dot example dot com"),
        "john.doe at example dot com": ("email", "john.doe at example dot com"),
        "jоhn@exаmple.com": ("email", "jоhn@exаmple.com"),
        "jo​hn@exam​ple.com": ("email", "jo​hn@exam​ple.com"),
        "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ": ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        "john[at]example[dot]com": ("email", "john[at]example[dot]com"),
        "x four one one one one one one one one one one one one one one one y": ("card", "four one one one one one one one one one one one one one one one"),
        "4l11 1111 1111 1111": ("card", "4l11 1111 1111 1111"),
        "call plus four nine one five one two three four five six seven": ("phone", "plus four nine one five one two three four five six seven"),
        "call +49 one five one two three four five six seven ok": ("phone", "+49 one five one two three four five six seven"),
        "１９２.１６８.１.１": ("ip", "１９２.１６８.１.１"),
        "192 dot 168 dot 1 dot 1": ("ip", "192 dot 168 dot 1 dot 1"),
    }
    texts = list(hidden)
    for t, may in zip(texts, pii.may_spell(pa.array(texts, pa.large_string()))):
        assert [(k, t[a:b], p) for k, a, b, p in pii.find(t, bool(may))] == [(*hidden[t], False)], t
    for clean in ("we meet at noon dot and on", "one two three cats", "at the dot", "Über den Fluß à 3 h", "1O1 l1"):
        assert pii.find(clean) == []


def test_plain_spans_stay_beside_disguised_ones():
    t = "a@b.co and c (at) d (dot) org 1.2.3.4"
    assert [(k, t[a:b], p) for k, a, b, p in pii.find(t)] == [("email", "a@b.co", True), ("email", "c (at) d (dot) org", False), ("ip", "1.2.3.4", True)]


def test_operator(spark):
    data = [(1, None), (2, ""), (3, "é a@b.co"), (3, "é a@b.co"), (None, "+1 555 1234567"), (4, "x (at) y (dot) com " * 300)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in data], "doc_id long, text string, spans string")
    got = sorted(((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in pii.detect(docs).collect()), key=str)
    assert got == sorted(((i, pii.find(t or "")) for i, t in data), key=str)
    assert pii.detect(docs.limit(0)).collect() == []


def test_prefilters_skip_nothing():
    card = "four" + " one" * 15
    hidden = {
        "my card is 411111111111111 one please call me back soon": ("card", "411111111111111 one"),
        "so we took four 111111111111111 from the big list of mine": ("card", "four 111111111111111"),
        "this is a longer text and\u00a0" + card.replace(" ", "\u00a0") + " ends it here": ("card", card.replace(" ", "\u00a0")),
        "mein Text hat 16 Ziffern: FÜNF 555555555554444 und noch mehr": ("card", "FÜNF 555555555554444"),
        "send to john\tat\tmail\tdot\tcom or someone else in there": ("email", "john\tat\tmail\tdot\tcom"),
        "send to john [  at  ] mail [\tdot\t] com or someone else": ("email", "john [  at  ] mail [\tdot\t] com"),
        "please call plus 49 151 2345678 today or some time later": ("phone", "plus 49 151 2345678"),
        "it says 4O1111111111111 one on the front of the card": None,
    }
    for t, may in zip(hidden, pii.may_spell(pa.array(list(hidden), pa.large_string())).tolist()):
        want = [(*hidden[t], False)] if hidden[t] else []
        assert [(k, t[a:b], p) for k, a, b, p in pii.find(t, may)] == want == [(k, t[a:b], p) for k, a, b, p in pii.find(t)], t
    assert pii.find("\u017fix one two s\u0130x") == []


def test_prefilters_against_all_texts():
    draw = random.Random(6)
    parts = ["one", "Two", "fünf", "411111", "1", "dot", "at", "[at]", "( dot )", "plus", "x", "a@b.co", ",", "-", "l", "com", "four"]
    texts = ["".join(draw.choice(parts) + draw.choice([" ", "  ", "\t", "\u2003", "", "-"]) for _ in range(draw.randint(1, 14))) for _ in range(4000)]
    for t, may in zip(texts, pii.may_spell(pa.array(texts, pa.large_string())).tolist()):
        assert pii.find(t, may) == pii.find(t), t


def test_partly_disguised():
    spans = lambda t: [(k, t[a:b], p) for k, a, b, p in pii.find(t)]
    assert spans("x john [dot] smith@example.com y") == [("email", "john [dot] smith@example.com", False), ("email", "smith@example.com", True)]
    assert spans("jane@mail.example [dot] com") == [("email", "jane@mail.example", True), ("email", "jane@mail.example [dot] com", False)]
    assert spans("a@b.co and c (dot) d") == [("email", "a@b.co", True)]
