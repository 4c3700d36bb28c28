"""Policy text to pages, articles, appendices and chunks. Each document is parsed inside its row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import names
from ..functions.tags import CUT
from ..functions.text import let, strip

# Headers of the document format, one line each. (?dmU): only \n ends a line, ^ at every line, Unicode classes.
ARTICLE = r"제\d+조(?:의\d+)?"
ARTICLE_HEADER = r"(?dmU)^(%s)[^\S\n]*[\(（](.+?)[\)）]"
PARAGRAPH = r"(?dmU)^([①②③④⑤⑥⑦⑧⑨⑩])[^\S\n]*(.+)"
ITEM = r"(?dU)^[^\S\n]*(\d+)\.[^\S\n]+(.+)"
APPENDIX = r"(?U)(별표\s*[\[【\(]?\s*(?:질병관련|수술관련|상해관련|보장관련)?\s*\d*\s*[\]】\)]?)"
# A title of the first kind can only start where a word does, or right after the title before: tested first, as \S+ is slow.
BENEFIT = r"(?U)((?:(?<!\S)|\G)(?:무배당\s+)?\S+\s*특약\s*약관|제\d+관\s+\S+\s+특약)"
PAGE_MARK = r"<!-- Page (\d+) -->"
INNER = "\ufdd1"


def _lines(text: Column) -> Column:
    """Trimmed non-blank lines."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def _pieces(text: Column, pattern: str, word: str) -> Column:
    """Split at every match and keep the match: odd entries are matches, even ones the text between.

    Texts without ``word``, which every match holds, skip the pattern.
    """
    cut = F.split(F.regexp_replace(text, pattern, CUT + "$0" + CUT), CUT)
    return F.when(F.contains(text, F.lit(word)), cut).otherwise(F.array(text))


def _paragraph(lines: Column) -> Column:
    head, rest = F.element_at(lines, 1), F.slice(lines, 2, 1 << 30)
    items = F.filter(rest, lambda x: x.rlike(ITEM))
    return F.struct(
        F.regexp_extract(head, PARAGRAPH, 1).alias("marker"),
        F.regexp_extract(head, PARAGRAPH, 2).alias("text"),
        F.transform(
            items,
            lambda x: F.struct(F.regexp_extract(x, ITEM, 1).alias("number"), F.regexp_extract(x, ITEM, 2).alias("text")),
        ).alias("items"),
        F.filter(rest, lambda x: ~x.rlike(ITEM)).alias("loose"),
    )


def _without_break(block: Column) -> Column:
    return F.regexp_replace(block, r"\n$", "")


def _article(lines: Column, header: str) -> Column:
    head = F.element_at(lines, 1)
    body = F.array_join(F.slice(lines, 2, 1 << 30), "\n")
    parts = F.split(F.regexp_replace(body, PARAGRAPH, INNER + "$0"), INNER)

    def from_parts(parts):
        before = F.filter(F.split(F.element_at(parts, 1), "\n"), lambda x: x != "")
        paragraphs = F.transform(
            F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.split(_without_break(p), "\n")), _paragraph
        )
        return let(F.struct(before.alias("before"), paragraphs.alias("paragraphs")), finish)

    def finish(r):
        loose = F.concat(r["before"], F.flatten(F.transform(r["paragraphs"], lambda p: p["loose"])))
        return F.struct(
            F.regexp_extract(head, header, 1).alias("number"),
            F.regexp_extract(head, header, 2).alias("title"),
            F.concat_ws("", F.transform(loose, lambda x: F.concat(x, F.lit("\n")))).alias("content"),
            F.transform(
                r["paragraphs"],
                lambda p: F.struct(p["marker"].alias("marker"), p["text"].alias("text"), p["items"].alias("items")),
            ).alias("paragraphs"),
        )

    return let(parts, from_parts)


def articles(text: Column, article: str = ARTICLE) -> Column:
    """Articles with their content, paragraphs and items; lines before the first article are dropped."""
    header = ARTICLE_HEADER % article
    body = F.array_join(_lines(text), "\n")
    blocks = F.split(F.regexp_replace(body, header, CUT + "$0"), CUT)
    lines = F.transform(F.slice(blocks, 2, 1 << 30), lambda b: F.split(_without_break(b), "\n"))
    return F.transform(lines, lambda x: _article(x, header))


def article_rows(docs: DataFrame, text: str = "text", article: str = ARTICLE) -> DataFrame:
    """One row per article with ``article_no`` from 1 and the article's fields."""
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.posexplode(articles(F.col(text), article)).alias("article_no", "a"))
    return rows.select(*keep, (F.col("article_no") + 1).alias("article_no"), "a.*")


def appendices(text: Column, pattern: str = APPENDIX, limit: int | None = None, word: str = "별표") -> Column:
    """Appendix name, start page (first page mark inside, else 0) and trimmed content, cut at ``limit`` characters if one is given."""

    def one(pair):
        page = F.regexp_extract(pair["content"], PAGE_MARK, 1).try_cast("int")
        content = strip(pair["content"])
        return F.struct(
            strip(pair["name"]).alias("name"),
            F.coalesce(page, F.lit(0)).alias("start_page"),
            (content if limit is None else F.substring(content, 1, limit)).alias("content"),
        )

    def all_of(parts):
        return F.transform(_pairs(parts), one)

    return let(_pieces(text, pattern, word), all_of)


def _pairs(parts: Column) -> Column:
    """(name, content) for every match: the match and the text after it."""
    named = F.transform(parts, lambda p, i: F.struct(p.alias("name"), i.alias("i")))
    after = F.filter(F.slice(parts, 2, 1 << 30), lambda p, i: i % 2 == 1)
    names_ = F.transform(F.filter(named, lambda x: x["i"] % 2 == 1), lambda x: x["name"])
    return F.transform(F.arrays_zip(names_.alias("name"), after.alias("content")), lambda z: F.struct(z["name"].alias("name"), z["content"].alias("content")))


def appendix_rows(docs: DataFrame, text: str = "text", pattern: str = APPENDIX, limit: int | None = None) -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.posexplode(appendices(F.col(text), pattern, limit)).alias("pos", "a"))
    return rows.select(*keep, (F.col("pos") + 1).alias("pos"), "a.*")


def chunks(text: Column, size: int = 8000, pattern: str = BENEFIT, word: str = "특약") -> Column:
    """Text by rider title: long parts in fixed cuts titled '(part k)', others trimmed, blank ones dropped."""
    kind = "array<struct<title:string,content:string,char_count:int>>"

    def one(pair):
        title, content = pair["name"], pair["content"]
        cuts = F.transform(
            F.sequence(F.lit(1), F.ceil(F.length(content) / F.lit(size)).cast("int")),
            lambda k: let(
                F.substring(content, (k - 1) * size + 1, F.lit(size)),
                lambda cut: F.struct(
                    F.concat(title, F.lit(" (part "), k.cast("string"), F.lit(")")).alias("title"),
                    cut.alias("content"), F.length(cut).alias("char_count"),
                ),
            ),
        )
        whole = let(strip(content), lambda t: F.struct(title.alias("title"), t.alias("content"), F.length(t).alias("char_count")))
        short = F.filter(F.array(whole), lambda c: c["char_count"] > 0)
        return F.when(F.length(content) > size, cuts.cast(kind)).otherwise(short.cast(kind))

    def all_of(parts):
        main = F.array(F.struct(F.lit(names.MAIN_TERMS).alias("name"), F.element_at(parts, 1).alias("content")))
        return F.flatten(F.transform(F.concat(main, _pairs(parts)), one))

    return let(_pieces(text, pattern, word), all_of)


def chunk_rows(docs: DataFrame, text: str = "text", size: int = 8000, pattern: str = BENEFIT) -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.posexplode(chunks(F.col(text), size, pattern)).alias("part_no", "c"))
    return rows.select(*keep, (F.col("part_no") + 1).alias("part_no"), "c.*")


def preprocess(docs: DataFrame, text: str = "text", size: int = 8000, appendix_limit: int | None = None) -> DataFrame:
    """Structure, appendices (cut at ``appendix_limit`` characters if given), chunks and counts of each document; an empty text gives an error row."""
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    body = docs.select(
        *docs.columns,
        F.when(empty, "empty text").alias("error"),
        F.when(~empty, articles(F.col(text))).alias("articles"),
        F.when(~empty, appendices(F.col(text), limit=appendix_limit)).alias("appendices"),
        F.when(~empty, chunks(F.col(text), size)).alias("chunks"),
    )
    return body.select(
        "*", F.length(text).alias("total_chars"), F.size("articles").alias("article_count"),
        F.size("appendices").alias("appendix_count"), F.size("chunks").alias("chunk_count"),
    )


def region(text: Column, start: str, end: str) -> Column:
    """From the first start marker to the next end marker; null without start, the rest without end."""
    at = F.instr(text, start)
    tail = F.substring(text, at, F.length(text))
    stop = F.instr(F.substring(tail, F.lit(len(start) + 1), F.length(tail)), end)
    inner = F.when(stop > 0, F.substring(tail, F.lit(1), stop + len(start) - 1)).otherwise(tail)
    return F.when(at > 0, inner)


def table_markdown(rows: Column) -> Column:
    """Array of cell arrays to a markdown table; null cells are empty; null unless there is a row below the header."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    rule = F.concat(
        F.lit("|"), F.array_join(F.transform(F.try_element_at(rows, F.lit(1)), lambda c: F.lit("---")), "|"), F.lit("|")
    )
    body = F.concat(F.array(line(F.try_element_at(rows, F.lit(1))), rule), F.transform(F.slice(rows, 2, 1 << 30), line))
    return F.when(F.size(rows) > 1, F.array_join(body, "\n"))


def page_piece(page_no: Column, text: Column, tables: Column) -> Column:
    """What one page adds: its tables as markdown when it has any, else its text when that is not blank."""
    number = page_no.cast("string")
    shown = F.filter(F.transform(tables, table_markdown), lambda m: m.isNotNull())
    tabled = F.concat_ws("", F.transform(shown, lambda m: F.concat(F.lit("\n<!-- Page "), number, F.lit(" Table -->\n"), m, F.lit("\n"))))
    plain = F.when(
        strip(F.coalesce(text, F.lit(""))) != "", F.concat(F.lit("\n<!-- Page "), number, F.lit(" -->\n"), text, F.lit("\n"))
    ).otherwise("")
    return F.when(F.size(tables) > 0, tabled).otherwise(plain)


def assemble(rows: DataFrame, keys: list[str], pos: str, piece: str, separator: str = "") -> DataFrame:
    """Pieces of a document in order as one text: the result row is the document."""
    ordered = F.array_sort(F.collect_list(F.struct(pos, piece)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[piece]), separator).alias("text"))


def html_tables(html: Column) -> Column:
    """Rows and cells of every table in a page, tags removed."""
    bare = lambda c: strip(F.regexp_replace(c, "<[^>]*>", ""))
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), bare)
    rows = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), cells)
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1)), rows)
