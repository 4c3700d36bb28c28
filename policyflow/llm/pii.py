"""Personal data with offsets, also where it is disguised.

The plain detectors run over the source text. A chain of small transducers then rewrites disguises (look-alike characters,
invisible characters, spelled digits, "at" and "dot" in words or brackets) while every character of the rewritten text keeps the
source range that it came from; the same detectors run over it, and what they find is mapped back to source characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, lowered, query, raw, slices, span_hashes, table, text_column

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_ANY_DOTTED = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and dotted domain, found from the @ signs so that long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, start)
        at = text.find("@", max(done, at + 1))


def ips(text: str) -> Iterator[tuple[int, int]]:
    if _ANY_DOTTED.search(text) is None:
        return
    for chain in _DOTTED.finditer(text):
        parts = chain.group().split(".") if chain.end() - chain.start() >= 7 else ()
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = dict(zip(KINDS, (emails, ips, cards, phones)))


class Aligned:
    """A rewritten text whose characters know their source ranges."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text = text
        self.starts = np.arange(len(text)) if starts is None else starts
        self.ends = self.starts + 1 if ends is None else ends

    def rewrite(self, pattern: re.Pattern, output: Callable[[re.Match], str]) -> Aligned:
        """Every match replaced; each new character stands for the whole source range of its match."""
        text, starts, ends, done = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = output(m)
            text += self.text[done : m.start()], new
            starts += self.starts[done : m.start()], np.full(len(new), self.starts[m.start()])
            ends += self.ends[done : m.start()], np.full(len(new), self.ends[m.end() - 1])
            done = m.end()
        if not done:
            return self
        return Aligned("".join([*text, self.text[done:]]), np.concatenate([*starts, self.starts[done:]]), np.concatenate([*ends, self.ends[done:]]))

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])


# Letters of other scripts beside the Latin letter that they look like.
LOOK_ALIKES = dict(zip("аеорсухіјѕһԁԛԝвкмнтАВЕКМНОРСТУХІЈЅαονρικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwbkmhtABEKMHOPCTYXIJSaovpiktuxABEZHIKMNOPTYX"))
# Characters without width.
INVISIBLE = "­​‌‍⁠﻿"
# Number words of four languages by digit.
NUMBER_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}


def _plain(character: str) -> str:
    """The ASCII character that a look-alike stands for, or itself."""
    if character in INVISIBLE:
        return ""
    if character in LOOK_ALIKES:
        return LOOK_ALIKES[character]
    digit = unicodedata.decimal(character, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", character)
    return folded if len(folded) == 1 and folded.isascii() and folded > " " else character


#: Look-alikes, invisible characters, digits of other scripts, full-width and mathematical forms; superscripts and spaces are left alone.
_ODD = re.compile(
    "[" + "".join(map(re.escape, LOOK_ALIKES)) + INVISIBLE
    + "٠-٩۰-۹०-९০-৯․！-～﹒﹫\U0001d400-\U0001d7ff]"
)
_NUMBER = "|".join(sorted(NUMBER_WORDS, key=lambda w: (-len(w), w)))
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:{_NUMBER})(?![^\W_])[\s,-]{{0,3}}|[0-9][\s,-]{{0,3}}|(?:dot|point)(?![^\W_])[\s]{{1,3}}){{3,}}", re.I)
_SPELLED_ONE = re.compile(rf"(?<![^\W_])({_NUMBER})(?![^\W_])(?:[\s,-]{{1,3}}(?=(?:{_NUMBER})(?![^\W_])|[0-9]))?", re.I)
_PLUS = re.compile(r"(?<![^\W_])plus\s+(?=\+?[0-9])", re.I)
_ANY_DIGIT_LIKE = re.compile(r"[0-9][oOlI]+(?=[0-9])")
_DIGIT_LIKE = re.compile(r"(?<=[0-9])[oOlI]+(?=[0-9])")
_OPEN, _CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
# Last labels that make "x at y dot z" without brackets an address.
_LAST = "com|org|net|edu|gov|info|biz|example|test|io|co|dev|app|ai|eu|de|fr|es|uk|us|it|nl|ch|at|ca|mx|ar"
_BARE_AT = re.compile(rf"(?<=[A-Za-z0-9_%+-])\s+at\s+(?=[A-Za-z0-9.-]+(?:(?:\s+dot\s+|{_OPEN}(?:dot|\.){_CLOSE})[A-Za-z0-9-]+)*?(?:\s+dot\s+(?:{_LAST})(?![^\W_])|{_OPEN}(?:dot|\.){_CLOSE}[A-Za-z0-9]))", re.I)
_AT = re.compile(rf"{_OPEN}(?:at|@|arroba|arobase){_CLOSE}", re.I)
_DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:{_OPEN}(?:dot|point|punto|punkt|\.){_CLOSE}|\s+dot\s+)(?=[A-Za-z0-9])", re.I)
#: What every match of the patterns above has in it.
_BRACKETED = re.compile(r"[\[({<]\s*(?:at|@|arroba|arobase|dot|point|punto|punkt|\.)", re.I)
_SPACED_DOT = re.compile(r"\sdot\s", re.I)


def _digit_like(m: re.Match) -> str:
    return "".join("0" if c in "oO" else "1" for c in m.group())


def _number(word: str) -> str:
    """The digit of a number word; without regard to case some letters have a second form."""
    low = word.lower()
    return str(NUMBER_WORDS[low if low in NUMBER_WORDS else word.translate({0x17F: "s", 0x130: "i", 0x131: "i"}).lower()])


def _is_odd(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
        return "\xad" in text
    except UnicodeEncodeError:
        return _ODD.search(text) is not None


def normalised(text: str, spelled: bool = True) -> Aligned | None:
    """The text after all transducers, or None where none of them has anything to rewrite. ``spelled``: it may hold spelled digits."""
    folded = Aligned(text)
    odd = _is_odd(text)
    if odd:
        folded = folded.rewrite(_ODD, lambda m: _plain(m.group()))
        spelled = True
    low = folded.text.lower()
    hints = "dot" in low and _SPACED_DOT.search(folded.text) is not None or _BRACKETED.search(folded.text) is not None
    mixed = _ANY_DIGIT_LIKE.search(folded.text) is not None
    out = folded.rewrite(_DIGIT_LIKE, _digit_like) if mixed else folded
    spelled = spelled and _SPELLED.search(out.text) is not None
    plus = "plu" in low and (spelled or _PLUS.search(out.text) is not None)
    if not (odd or hints or spelled or mixed or plus):
        return None
    if spelled:
        inside = [m.span() for m in _SPELLED.finditer(out.text)]
        begins = np.array([a for a, _ in inside])
        ends = np.array([b for _, b in inside])

        def digit(m: re.Match) -> str:
            k = int(np.searchsorted(begins, m.start(), "right")) - 1
            return _number(m.group(1)) if k >= 0 and m.start() < ends[k] else m.group()

        out = out.rewrite(_SPELLED_ONE, digit)
    if plus:
        out = out.rewrite(_PLUS, lambda m: "+")
    if hints:
        out = out.rewrite(_BARE_AT, lambda m: "@").rewrite(_AT, lambda m: "@").rewrite(_DOT, lambda m: ".")
    return out if out.text != text else None


def find(text: str, spelled: bool = True) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) of one text, by kind and start; disguised finds inside a plain one of their kind are left out."""
    out = []
    rewritten = normalised(text, spelled)
    for kind, detect in DETECTORS.items():
        plain = list(detect(text))
        more = []
        if rewritten is not None:
            taken = sorted(plain)
            starts = [a for a, _ in taken]
            for start, end in (rewritten.source(*s) for s in detect(rewritten.text)):
                k = int(np.searchsorted(starts, start, "right"))
                if not (k and taken[k - 1][1] >= end):
                    more.append((start, end))
        out += sorted([(kind, a, b, True) for a, b in plain] + [(kind, a, b, False) for a, b in more], key=lambda s: s[1:3])
    return out


def _hashes(words: Iterable[str]) -> np.ndarray:
    own = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in own])
    return np.sort(span_hashes(np.frombuffer(b"".join(own), np.uint8), ends - [len(w) for w in own], ends))


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def may_spell(texts: pa.Array) -> np.ndarray:
    """Whether each text may have spelled digits: a number word beside a number word, a digit or a dot, other signs between them or not. True of all
    texts that are not ASCII, which have more kinds of space and case."""
    data, bounds = raw(texts)
    numbers, dots, out = _hashes(NUMBER_WORDS), _hashes(("dot", "point")), np.zeros(len(texts), bool)
    for first, last in slices(bounds):
        own = lowered(data[bounds[first] : bounds[last]])
        cuts = bounds[first : last + 1] - bounds[first]
        inside = ((own - np.uint8(97)) < 26) | (own >= 128) | ((own - np.uint8(48)) < 10)
        edge = np.zeros(len(own) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[cuts] = True
        starts, ends = np.flatnonzero(edge[:-1] & inside), np.flatnonzero(edge[1:] & inside) + 1
        keys = span_hashes(own, starts, ends)
        number = _among(keys, numbers)
        beside = number | _among(keys, dots) | ((own[starts] - np.uint8(48)) < 10)
        text = np.searchsorted(cuts, starts, "right") - 1
        near = (number[1:] & beside[:-1] | number[:-1] & beside[1:]) & (text[1:] == text[:-1])
        out[first + text[1:][near]] = True
        wide = np.flatnonzero(own >= 128)
        out[first + np.unique(np.searchsorted(cuts, wide, "right") - 1)] = True
    return out


SPANS = "array<struct<kind: string, start: int, end: int, plain: boolean>>"


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of every text, in code points, end exclusive.

    Null texts are empty, null ids and repeated rows are kept, other columns are ignored. Texts are worked on row by row, whole."""
    bounded_batches(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            found = [find(t, s) for t, s in zip(texts.to_pylist(), may_spell(texts).tolist())]
            flat = [s for f in found for s in f]
            columns = list(zip(*flat)) or [(), (), (), ()]
            values = pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, span)], fields=list(span))
            bounds = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds), values)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def _listed(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


@query("op5_pii_transducers")
def op5(spark, sf_dir):
    """Counts and digest of the plain spans, and all spans, of every document."""
    found = detect(table(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: s["plain"])

    def count(kind: str):
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(kind) for kind in KINDS],
        F.sha2(_listed(plain), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(plain)).cast("long").alias("n_disguised"),
    )
