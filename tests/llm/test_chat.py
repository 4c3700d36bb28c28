"""Perspectives against a plain rendering."""

import collections

from policyflow.llm import chat


def rendered(rows, part_turns):
    """{(conv, perspective, part): (n, text, masks)}"""
    parts, speakers, dialogues = collections.defaultdict(list), collections.defaultdict(set), collections.defaultdict(list)
    for conv, turn, who, text in rows:
        turn, who, text = -1 if turn is None else turn, who or chat.NOBODY if who is None else who, text or ""
        dialogues[conv].append((turn, who, text))
        if who != "system":
            speakers[conv].add(who)
    for conv, turns in dialogues.items():
        for k, turn in enumerate(sorted(turns)):
            parts[conv, k // part_turns].append(turn)
    out = {}
    for (conv, part), turns in parts.items():
        for me in speakers[conv]:
            text, masks = "", []
            for _, who, said in sorted(turns):
                role = "assistant" if who == me else "system" if who == "system" else "user name=" + who.replace("<|", "< |")
                text += f"<|im_start|>{role}\n"
                start = len(text)
                text += said.replace("<|", "< |") + "<|im_end|>"
                if who == me:
                    masks.append((start, len(text)))
                text += "\n"
            out[conv, me, part] = (len(turns), text, masks)
    return out


def test_rotation(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "é漢👍"), (1, 3, "cy", ""), (1, 70, "ann", "later"), (1, 70, "ann", "later"),
        (2, 0, "system", "alone"), (3, 0, None, None), (3, None, "bob", "first"), (3, -4, "bob", "before"), (None, 0, "ann", "no id"), (4, 5, "as<|x", "y"), (5, 1, "", "blank"),
    ] + [(6, k, "ab"[k % 2], "t" * k) for k in range(200)] + [(7, None, "ab"[k % 2], f"no number {k}") for k in range(150)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, perspective string, part int")
    for size in (64, 7):
        got = {(r["conv_id"], r["perspective"], r["part"]): (r["n_turns"], r["text"], [tuple(m) for m in r["masks"]]) for r in chat.rotate(frame, part_turns=size).collect()}
        assert got == rendered(rows, size)


def test_native_and_empty(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.rotate(frame)
    assert out.collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
