"""Tag rendering on one text column. A context is a struct column (see ``CONTEXT_FIELDS``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import numbers

# A Unicode noncharacter: never part of interchanged text, so it can mark cut points.
CUT = "\ufdd0"

# The tag names of the document format.
CONTROL_KINDS = ["면책", "감액있음", "비갱신", "갱신", "감액한번", "감액두번", "진단확정", "자동갱신형", "독립특약"]
PHRASE_KINDS = ["단체", "감액", "연장형", "부모", "예약가입", "진단확정"]
MODEL_KINDS = ["세부보장", "감액기간", "지급률"]
# any tag of these kinds with up to three numbers; one kind carries its first number after a hyphen
CLEANUP = r"\{(?:%s)\d*(?:-\d+){0,2}\}" % "|".join([*PHRASE_KINDS, *MODEL_KINDS, *CONTROL_KINDS, "감액2-"])
PHRASE_TAG = r"\{(?:단체|감액|연장형|부모|예약가입|진단확정)\d*\}|\{감액2-\d+\}|\{보통약관 해약환급금\}"
NAME_TAG = r"\{세부보장(\d+)\}"
PERIOD_TAG = r"\{감액기간(\d+)-(\d+)\}"
RATE_TAG = r"\{지급률(\d+)-(\d+)-(\d+)\}([*/])?(\d+\.?\d*)?(%)?"
REFUND_TAG = "{보통약관 해약환급금}"

CONTEXT_FIELDS = {
    "exempt": "int", "reduce": "int", "confirm": "int", "parent": "int", "reserve": "int", "extend": "int",
    "team": "int", "renew": "int", "no_renew": "int", "independent": "int", "once": "boolean", "twice": "boolean",
    "names": "array<string>", "periods": "array<array<int>>", "codes": "array<string>",
    "rates": "map<string,array<array<double>>>",
}


def attribute_truth(ctx: Column) -> dict[str, Column]:
    """Truth of each control kind; the number in a tag plays no part."""
    return {
        "면책": ctx["exempt"] > 0,
        "감액있음": ctx["reduce"] > 0,
        "비갱신": (ctx["no_renew"] > 0) | (ctx["renew"] == 0),
        "갱신": ctx["renew"] > 0,
        "감액한번": ctx["once"] & ~ctx["twice"],
        "감액두번": ctx["twice"],
        "진단확정": ctx["confirm"] > 0,
        "자동갱신형": ctx["renew"] > 0,
        "독립특약": ctx["independent"] > 0,
    }


def has_control_tag(text: Column) -> Column:
    return F.contains(text, F.lit("{")) & text.rlike(r"\{(?:%s)\d+-" % "|".join(CONTROL_KINDS))


def pair_pattern(kind: str, first: int, second: int) -> str:
    """Same-named pair, shortest content."""
    return r"(?s)\{%s(\d+)-%d\}(.*?)\{%s\1-%d\}" % (kind, first, kind, second)


def drop_pairs(text: Column, kind: str, first: int, second: int, keep: Column) -> Column:
    """Remove the tags of every pair, and the content too unless ``keep``."""
    kept = F.when(F.coalesce(keep, F.lit(False)), "$2").otherwise("")
    return F.regexp_replace(text, F.lit(pair_pattern(kind, first, second)), kept)


def pair_count(text: Column, kind: str, first: int, second: int) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pair_pattern(kind, first, second)), F.lit(0)))


def render_control(text: Column, truth: dict[str, Column]) -> Column:
    """-1/-2 keeps its content when the attribute holds, -3/-4 when it does not."""
    for kind, holds in truth.items():
        holds = F.coalesce(holds, F.lit(False))
        text = drop_pairs(text, kind, 1, 2, holds)
        text = drop_pairs(text, kind, 3, 4, ~holds)
    return text


def map_matches(text: Column, pattern: str, answer) -> Column:
    """Replace every match of ``pattern`` by ``answer(match)`` in one pass over the text."""
    pieces = F.split(F.regexp_replace(text, pattern, CUT + "$0" + CUT), CUT)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, answer(p)).otherwise(p)), "")


def phrase_key(tag: Column) -> Column:
    """Name under which the phrase of a tag is stored."""
    numbered = F.regexp_replace(tag, r"^\{(단체|감액)\}$", "{$11}")
    return F.regexp_replace(numbered, r"^\{감액2-\d+\}$", "{감액2}")


def phrase_kind(tag: Column) -> Column:
    return F.regexp_extract(tag, r"^\{(단체|감액|연장형|부모|예약가입|진단확정)", 1)


def phrase_attribute(kind: Column) -> Column:
    """Attribute a phrase must carry; null when any will do."""
    return F.when(kind == "예약가입", F.lit("예약가입연령")).when(kind != "", kind)


def phrase_flag(kind: Column, ctx: Column) -> Column:
    """1 or 0 as the attribute holds, null for a tag without attribute."""
    fields = dict(zip(PHRASE_KINDS, ["team", "reduce", "extend", "parent", "reserve", "confirm"]))
    tests = [F.when(kind == k, (ctx[f] > 0).cast("int")) for k, f in fields.items()]
    return F.coalesce(*tests)


def render_phrases(text: Column, phrases: Column) -> Column:
    """``phrases`` maps a tag as written to its text; tags without entry become ''."""
    return map_matches(text, PHRASE_TAG, lambda p: F.coalesce(F.try_element_at(phrases, p), F.lit("")))


def name_answer(tag: Column, name_of) -> Column:
    """``name_of(n)`` gives the n-th sub-coverage name."""
    name = name_of(F.regexp_extract(tag, NAME_TAG, 1).try_cast("int"))
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("「"), name, F.lit("」"))).otherwise("")


def period_answer(tag: Column, periods_of) -> Column:
    """``periods_of(n)`` gives the reduction periods of the n-th reduced sub-coverage."""
    group = periods_of(F.regexp_extract(tag, PERIOD_TAG, 1).try_cast("int"))
    days = numbers.kth_smallest(group, F.regexp_extract(tag, PERIOD_TAG, 2).try_cast("int"))
    return F.coalesce(numbers.period_text(days), F.lit("NA"))


def rate_answer(tag: Column, rates_of) -> Column:
    """``rates_of(n, m)`` gives the pay rates of sub-coverage m of the n-th representative code."""
    part = [F.regexp_extract(tag, RATE_TAG, i) for i in range(7)]
    group = rates_of(part[1].try_cast("int"), part[2].try_cast("int"))
    rate = numbers.kth_smallest(group, part[3].try_cast("int"))
    return F.coalesce(numbers.rate_text(rate, part[4], part[5], part[6]), F.lit(""))


def context_getters(ctx: Column) -> dict:
    """Getters over the arrays of a context struct."""
    return {
        "name_of": lambda n: numbers.pick(ctx["names"], n),
        "periods_of": lambda n: numbers.pick(ctx["periods"], n),
        "rates_of": lambda n, m: numbers.pick(F.try_element_at(ctx["rates"], numbers.pick(ctx["codes"], n)), m),
    }


def render_model(text: Column, name_of, periods_of, rates_of) -> Column:
    """Sub-coverage names, reduction periods and pay rates."""
    text = map_matches(text, NAME_TAG, lambda p: name_answer(p, name_of))
    text = map_matches(text, PERIOD_TAG, lambda p: period_answer(p, periods_of))
    return map_matches(text, RATE_TAG, lambda p: rate_answer(p, rates_of))


def cleanup(text: Column) -> Column:
    return F.regexp_replace(text, CLEANUP, "")


def render(text: Column, ctx: Column, phrases: Column) -> Column:
    """Control tags, phrase tags, model tags, cleanup; texts without braces stay."""
    out = render_control(text, attribute_truth(ctx))
    out = render_phrases(out, phrases)
    out = render_model(out, **context_getters(ctx))
    return F.when(F.contains(text, F.lit("{")), cleanup(out)).otherwise(text)


def found_phrase_tags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PHRASE_TAG), F.lit(0)))


def zero_age(text: Column, flag: Column) -> Column:
    """Delete the zero-age passage when the flag is 0, else only its tags and the character before the opening tag."""
    # The pair of section tags of the document format.
    pattern = r"(?s).?\{0세자녀-1\}(.*?)\{0세자녀-2\}"
    whole = r"(?s)\{0세자녀-1\}.*?\{0세자녀-2\}"
    return F.when(flag == 0, F.regexp_replace(text, whole, "")).otherwise(F.regexp_replace(text, pattern, "$1"))
