"""Text, path and hash expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import names

# Fixed value: the characters that count as blank at the ends of a text.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: inside array functions Spark repeats every mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    """Trim every Unicode blank, not only spaces."""
    return F.btrim(c, F.lit(BLANKS))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def non_blank(c: Column) -> Column:
    """Null when the text is null or blank."""
    return F.when(strip(c) != "", c)


def first_filled(*cols: Column) -> Column:
    """First alternative that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def short_code(name: Column) -> Column:
    return F.upper(F.substring(F.md5(name), 1, 8))


def version_label(ts: Column) -> Column:
    return F.date_format(ts, "'v'yyMM")


def keyword_label(c: Column, pairs: list[tuple[str, str]], default: str) -> Column:
    """Label of the first keyword, in the given order, that the lower-cased text contains."""
    lowered = F.lower(c)
    tests = [F.when(lowered.contains(word), F.lit(label)) for word, label in pairs]
    return F.coalesce(*tests, F.lit(default))


def product_type(name: Column) -> Column:
    return keyword_label(name, names.TYPE_KEYWORDS, names.UNCLASSIFIED)


def base_category(name: Column) -> Column:
    return keyword_label(name, [(w, w) for w in names.BASE_CATEGORIES], names.OTHER_CATEGORY)


def between_markers(text: Column, start: str, end: str) -> Column:
    """Text after the first start marker up to the next end marker; '' without start, the rest without end."""
    at = F.instr(text, start)
    after = F.substring(text, at + F.lit(len(start)), F.length(text))
    stop = F.instr(after, end)
    inner = F.when(stop > 0, F.substring(after, F.lit(1), stop - 1)).otherwise(after)
    return F.when(at > 0, inner).otherwise(F.lit(""))


def clean(text: Column) -> Column:
    """Drop characters 14, 13, 10, 160, 9 and 12, then trim."""
    return strip(F.translate(text, "\x0e\r\n\xa0\t\x0c", ""))


def code_list(text: Column) -> Column:
    """Comma list to array of trimmed codes."""
    return F.transform(F.split(text, ","), strip)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def folder_name(path: Column) -> Column:
    """Name of the folder that holds the file, 'default_group' when there is none."""
    folder = F.regexp_extract(path, r"([^/\\]*)[/\\][^/\\]*$", 1)
    return F.when(folder == "", F.lit("default_group")).otherwise(folder)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is not an extension."""
    return F.regexp_replace(file_name(path), r"^(\.*[^.].*)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^\.*[^.].*(\.[^.]*)$", 1))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[/\\]", "_")


def rider_name(file: Column) -> Column:
    """Text between '약관_' and the next '_'."""
    return F.regexp_extract(file, "약관_([^_]+)_", 1)


def group_number(file: Column) -> Column:
    """Integer before the first '_', else -1."""
    head = F.trim(F.split_part(file, F.lit("_"), F.lit(1)))
    number = F.when(F.contains(file, F.lit("_")), head.try_cast("int"))
    return F.coalesce(number, F.lit(-1))


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line, quotes removed."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    inner = lambda f: F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
    return F.transform(fields, lambda f: F.when(F.startswith(f, F.lit('"')), inner(f)).otherwise(f))


def cut(text: Column, limit: int, marker: str = "") -> Column:
    """First ``limit`` characters; the marker is added only when something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def iso_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def mask_url(url: Column) -> Column:
    return F.when(text_or_empty(url) == "", F.lit("")).otherwise(
        F.concat(F.split_part(url, F.lit("///"), F.lit(1)), F.lit("///***"))
    )


def lookup_label(key: Column, labels: dict[str, str]) -> Column:
    """Label of a key; unknown keys stay as they are, empty becomes '-'."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.when(text_or_empty(key) == "", F.lit("-")).otherwise(F.coalesce(F.try_element_at(table, key), key))


def replace_all(text: Column, pairs: Column) -> Column:
    """Apply an array of (find, repl) structs one after the other."""
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["find"], p["repl"]))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
