"""Phrases for tags, clause ranges, copy-once, section ends, assembly and appendix replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import names
from ..functions import tags, text as tx
from ..session import cut
from .lookups import category_lookup
from .ordered import BLOCK, first_per_key, first_row, next_filled, number_in_order

PHRASE_SCHEMA = "map<string,string>"


def phrase_table(raw: DataFrame, pos: str) -> DataFrame:
    """Phrase rows under the names tag, attribute, flag, phrase, pos from any of the column names in use."""
    have = lambda options: [F.col(f"`{c}`") for c in options if c in raw.columns]
    return raw.select(
        tx.strip(tx.first_filled(*have(["tag", "코드명", "태그명", "태그명(코드명)"]))).alias("tag"),
        tx.strip(tx.first_filled(*have(["attribute", "담보속성"]))).alias("attribute"),
        tx.strip(tx.first_filled(*have(["flag", "적용구분"]))).alias("flag"),
        tx.first_filled(*have(["phrase", "약관문구", "적용문구", "적용문구(약관문구)"])).alias("phrase"),
        F.col(pos).alias("pos"),
    ).filter("tag <> ''")


def phrase_index(phrases: DataFrame) -> DataFrame:
    """(tag, attribute, wanted, phrase): the answer for each wanted flag.

    Per tag and attribute the first row in file order counts whose flag is blank (answer '') or equals the wanted one.
    Rows with null attribute and null wanted answer a tag that asks for neither.
    """
    blank = F.col("flag") == ""
    answer = F.when(blank, "").otherwise(F.col("phrase"))
    number = F.col("flag").try_cast("int")
    per_flag = phrases.select("tag", "attribute", "pos", answer.alias("answer"), F.explode(
        F.when(blank, F.array(F.lit(0), F.lit(1))).otherwise(F.array(number))
    ).alias("wanted")).filter("wanted in (0, 1)")
    flagged = per_flag.groupBy("tag", "attribute", "wanted").agg(F.min_by("answer", "pos").alias("phrase"))
    free = phrases.groupBy("tag").agg(F.min_by(answer, F.col("pos")).alias("phrase")).select(
        "tag", F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("int").alias("wanted"), "phrase"
    )
    return flagged.unionByName(free)


def find_phrases(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """Rows with (tag, attribute, wanted) plus ``phrase``, '' on a miss."""
    right = index.select(
        F.col("tag").alias("__t"), F.col("attribute").alias("__a"), F.col("wanted").alias("__w"), "phrase"
    )
    joined = wanted.join(
        right,
        (F.col("tag") == F.col("__t")) & F.col("attribute").eqNullSafe(F.col("__a")) & F.col("wanted").eqNullSafe(F.col("__w")),
        "left",
    )
    return joined.select(*wanted.columns, F.coalesce("phrase", F.lit("")).alias("phrase"))


def phrase_maps(clauses: DataFrame, index: DataFrame, id_columns: list[str], text: str, ctx: str) -> DataFrame:
    """(ids, ``phrases`` map from tag as written to its phrase) for the tags found in each text; the ids tell texts and contexts apart."""
    found = clauses.filter(F.contains(F.col(text), F.lit("{"))).select(
        *id_columns, ctx, F.explode(tags.found_phrase_tags(F.col(text))).alias("written")
    )
    asked = found.withColumn("kind", tags.phrase_kind(F.col("written"))).select(
        *id_columns, "written", tags.phrase_key(F.col("written")).alias("tag"),
        tags.phrase_attribute(F.col("kind")).alias("attribute"), tags.phrase_flag(F.col("kind"), F.col(ctx)).alias("wanted"),
    ).distinct()
    joined = find_phrases(asked, index)
    return joined.groupBy(*id_columns).agg(F.map_from_entries(F.collect_list(F.struct("written", "phrase"))).alias("phrases"))


def render_clauses(
    clauses: DataFrame, index: DataFrame, text: str, ctx: str, out: str = "rendered", getters: dict | None = None,
) -> DataFrame:
    """Full rendering of every text with its context; ``getters`` replace the arrays of the context.

    The phrases are joined to the tags of each distinct text and context; Spark broadcasts a small phrase table. Texts without tags are not moved for it.
    """
    getters = getters or tags.context_getters(F.col(ctx))
    keyed = clauses.withColumn("__id", F.when(F.contains(F.col(text), F.lit("{")), F.xxhash64(F.col(text), F.to_json(F.col(ctx)))))
    controlled = keyed.withColumn("__text", tags.render_control(F.col(text), tags.attribute_truth(F.col(ctx))))
    # the tags of the text before its sections are dropped include those after
    controlled = controlled.join(phrase_maps(keyed, index, ["__id"], text, ctx), "__id", "left")
    phrased = tags.render_phrases(F.col("__text"), F.coalesce("phrases", F.create_map().cast(PHRASE_SCHEMA)))
    body = tags.cleanup(tags.render_model(phrased, **getters))
    return controlled.withColumn(out, F.when(F.col("__id").isNull(), F.col(text)).otherwise(body)).drop("__id", "__text", "phrases")


def replacements(text: Column, ctx: Column, phrases: Column) -> Column:
    """Map from each substitution tag of the text to its replacement; unresolved periods are left out."""
    entry = lambda t, v: F.struct(t.alias("key"), v.alias("value"))
    all_of = lambda pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    phrase = F.transform(all_of(tags.PHRASE_TAG), lambda t: entry(t, F.coalesce(F.try_element_at(phrases, t), F.lit(""))))
    get = tags.context_getters(ctx)
    named = F.transform(all_of(tags.NAME_TAG), lambda t: entry(t, tags.name_answer(t, get["name_of"])))
    periods = F.transform(all_of(tags.PERIOD_TAG), lambda t: entry(t, tags.period_answer(t, get["periods_of"])))
    known = F.filter(periods, lambda e: e["value"] != "NA")
    return F.map_from_entries(F.concat(phrase, named, known))


def comment_ranges(comments: DataFrame, doc: str, pos: str, start: str, width: int = BLOCK) -> DataFrame:
    """``range_end`` = start of the next comment of the document; the last comment has an empty range."""
    out = next_filled(comments, [doc], pos, F.col(start), "range_end", width)
    return out.withColumn("range_end", F.coalesce("range_end", F.col(start)))


def section_ends(
    comments: DataFrame, doc: str, pos: str, start: str, text: str, width: int = BLOCK,
    markers: list[str] = names.SECTION_MARKERS,
) -> DataFrame:
    """``section_end`` = start of the next comment that holds a section marker and is a different section.

    A marker comment whose text contains the row's own text is the same section and is passed over. The next marker of all settles nearly
    all rows. For the texts whose next marker is of their own section, the markers that contain them are found by the first characters of the text, an equi join with the
    pieces of the marker texts; those that follow each other without a gap are one stretch, and the marker after the stretch is the end. Work is in proportion to the
    comments and to the markers that contain a text. Blank texts stand in every section and have no end.
    """
    marked = tx.any_of([F.contains(F.col(text), F.lit(m)) for m in markers])
    marks = cut(number_in_order(comments.filter(marked).select(doc, pos, start, text), [doc], pos, "__n", width))
    numbers = marks.select(F.struct(doc).alias("__d"), F.col(pos).alias("__p"), "__n")
    at = F.struct(F.col(start).alias("start"), F.col(text).alias("text"), F.col("__n").alias("n"))
    known = comments.join(numbers, (F.struct(doc) == F.col("__d")) & (F.col(pos) == F.col("__p")), "left").drop("__d", "__p")
    rows = next_filled(known, [doc], pos, F.when(F.col("__n").isNotNull(), at), "__m", width).drop("__n")
    same = F.coalesce(F.contains(F.col("__m.text"), F.col(text)), F.lit(False))
    # few rows, read by several branches
    asking = cut(rows.filter(same & (F.col(text) != "")).select(doc, F.col(pos).alias("__pos"), F.col(text).alias("__own"), F.col("__m.n").alias("__n")))

    long = F.coalesce(*[F.when(F.length("__own") >= n, F.lit(n)) for n in _FIRSTS])
    own = asking.select(doc, "__own").distinct().withColumn("__size", long).withColumn("__piece", F.substring(F.col("__own"), F.lit(1), F.col("__size")))
    texts = marks.select(doc, text).distinct()

    def pieces(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.struct(F.lit(n).alias("__size"), F.substring(F.col(text), i, F.lit(n)).alias("__piece")))
        return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<struct<__size:int,__piece:string>>"))

    cells = texts.select(doc, text, F.explode(F.array_distinct(F.concat(*map(pieces, _FIRSTS)))).alias("c")).select(doc, text, "c.*")
    inside = own.join(cells, [doc, "__size", "__piece"]).filter(F.contains(F.col(text), F.col("__own"))).select(doc, "__own", text)

    held = inside.join(marks.select(doc, text, "__n"), [doc, text]).select(doc, "__own", "__n")
    stretch = number_in_order(held, [doc, "__own"], "__n", "__k", width).withColumn("__stretch", F.col("__n") - F.col("__k"))
    ends = stretch.groupBy(doc, "__own", "__stretch").agg((F.max("__n") + 1).alias("__end"))
    after = asking.join(stretch.select(doc, "__own", "__n", "__stretch"), [doc, "__own", "__n"]).join(ends, [doc, "__own", "__stretch"])
    late = after.join(marks.select(doc, F.col("__n").alias("__end"), F.col(start).alias("__late")), [doc, "__end"])
    late = late.select(F.col(doc).alias("__doc"), "__pos", "__late")
    joined = rows.join(late, (F.col(doc) == F.col("__doc")) & (F.col(pos) == F.col("__pos")), "left")
    return joined.withColumn("section_end", F.when(same, F.col("__late")).otherwise(F.col("__m.start"))).drop("__m", "__doc", "__pos", "__late")


#: First characters of a text that a marker must hold, the most that the text has.
_FIRSTS = (8, 4, 2, 1)


def nearest_section(text: Column, start: Column, markers: list[str] = names.SECTION_MARKERS) -> Column:
    """End of a pasted clause when its own end is lost: start of the nearest later line that holds a marker, else the end.

    ``start`` counts from 0. For each marker only its first occurrence at or after ``start`` is looked at, and it counts
    only when its line starts after ``start``.
    """
    ends = []
    for marker in markers:
        at = F.position(F.lit(marker), text, start + 1)
        head = F.substring(text, F.lit(1), at - 1)
        line = F.length(head) - F.length(F.substring_index(head, "\n", -1))
        ends.append(F.when((at > 0) & (line > start), line))
    return F.least(F.length(text), *ends)


def copy_once(clauses: DataFrame, title: str, pos: str) -> DataFrame:
    """First clause per title in coverage order."""
    return first_row(clauses, [title], pos)


def section_title(module: Column, category: Column) -> Column:
    head = F.when(tx.text_or_empty(module) != "", F.concat(module, F.lit("-"))).otherwise("")
    return F.concat(head, category, F.lit(names.SECTION_SUFFIX))


def assemble_rows(
    coverages: DataFrame, ranges: DataFrame, sections: DataFrame, code: str = "code", category: str = "category",
    pos: str = "pos", module: str = "module", values: list[str] = ("title", "body"), section_pos: str = "section_no",
    width: int = BLOCK,
) -> DataFrame:
    """The assembled document as ordered rows (section_no, line_no, title, body).

    Each coverage takes its clause range (own category first), a title already copied is skipped, an empty range adds
    nothing, and the clause goes to the end of its section. ``line_no`` numbers the clauses of a section.
    """
    title, *others = values
    # titles and places decide; the other values are joined to the clauses that are left
    found = category_lookup(coverages, ranges.withColumn("__clause", F.col("comment_no")), code, category, [title, "__clause"], "comment_no")
    once = copy_once(found.filter(F.col(title).isNotNull()), title, pos)
    rows = ranges.select(F.col(code).alias("__code"), F.col("comment_no").alias("__pos"), *others)
    kept = once.join(rows, (F.col(code) == F.col("__code")) & (F.col("__clause") == F.col("__pos"))).filter(F.col(others[0]) != "")
    kept = kept.drop("__code", "__pos", "__clause")
    targets = first_per_key(sections.select("section", section_pos), ["section"], section_pos)
    placed = kept.withColumn("section", section_title(F.col(module), F.col(category))).join(targets, "section")
    return number_in_order(placed, [section_pos], pos, "line_no", width)


def replace_appendices(
    targets: DataFrame, base: DataFrame, category: str, name: str, body: str, pos: str
) -> DataFrame:
    """Target appendix bodies replaced by the base body of their category and name; ``replaced`` tells which."""
    own = first_row(base.select(category, name, pos, F.col(body).alias("__base")), [category, name], pos).drop(pos)
    joined = targets.join(own, [category, name], "left")
    return joined.select(
        *[F.coalesce("__base", F.col(body)).alias(body) if c == body else F.col(c) for c in targets.columns],
        F.col("__base").isNotNull().alias("replaced"),
    )


def success_log(rows: DataFrame, keys: list[str], product: str, ok: Column, pos: str, done: str = "수정", gone: str = ":해당별표없음") -> DataFrame:
    """Two texts per item: products done and products where the item is missing, in order."""
    entries = rows.select(*keys, F.struct(F.col(pos).alias("p"), F.col(product).cast("string").alias("name"), ok.alias("ok")).alias("__e"))
    per = entries.groupBy(*keys).agg(F.array_sort(F.collect_list("__e")).alias("__e"))
    say = lambda flag, word: F.array_join(
        F.transform(
            F.filter("__e", lambda e: e["ok"] == F.lit(flag)), lambda e: F.concat(F.lit(" "), e["name"], F.lit(word + ","))
        ), "",
    )
    return per.select(*keys, say(True, done).alias("success_log"), say(False, gone).alias("failure_log"))


def cross_reference(text: Column) -> Column:
    return F.concat(F.lit("{별표"), F.replace(tx.clean(text), F.lit(" "), F.lit("")), F.lit("}"))


def circled(number: Column) -> Column:
    """The circled number, in brackets where there is none; null for null."""
    marks = F.array(*[F.lit(m) for m in names.CIRCLED])
    plain = F.concat(F.lit("("), number.cast("int").cast("string"), F.lit(")"))
    return F.when(number.cast("int").between(1, len(names.CIRCLED)), F.try_element_at(marks, number.cast("int"))).otherwise(plain)
