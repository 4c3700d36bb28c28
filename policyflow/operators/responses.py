"""Model responses: recover rows from text, prompts as data, rule texts, mapping context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import names
from ..functions import text as tx
from .ordered import batches, running_before

FENCE = r"```(?:json)?"


def object_schema(fields: list[str] = names.RESPONSE_FIELDS) -> str:
    return "struct<%s>" % ",".join(f"`{f}`:string" for f in fields)


def unfenced(raw: Column) -> Column:
    return tx.strip(F.regexp_replace(raw, FENCE, ""))


def array_slice(raw: Column) -> Column:
    """From the first '[' to the last ']' of the text without code fences, '' when there is none."""
    return F.regexp_extract(unfenced(raw), r"(?s)\[.*\]", 0)


def _parse_array(text: Column, fields: list[str]) -> Column:
    """Array of objects, null when the text is no valid JSON array of objects."""
    schema = "array<%s>" % object_schema(fields)
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def is_json(text: Column) -> Column:
    """Whether the whole text parses (a broken text gives null as variant)."""
    return F.try_parse_json(text).isNotNull()


def parse_slice(raw: Column, fields: list[str] = names.RESPONSE_FIELDS) -> Column:
    """Objects of the array slice, null when it does not parse."""
    piece = array_slice(raw)
    return F.when((piece != "") & is_json(piece), _parse_array(piece, fields))


def recover_objects(raw: Column, fields: list[str] = names.RESPONSE_FIELDS) -> Column:
    """Every brace pair without nesting parsed alone, broken ones dropped."""
    found = F.regexp_extract_all(unfenced(raw), F.lit(r"\{[^{}]*\}"), F.lit(0))
    good = F.filter(found, is_json)
    return F.transform(good, lambda o: F.from_json(o, object_schema(fields)))


def parse_response(raw: Column, fields: list[str] = names.RESPONSE_FIELDS) -> Column:
    """Array slice when it parses, recovered objects when not, nothing without an array."""
    empty = F.array().cast("array<%s>" % object_schema(fields))
    marked = F.contains(unfenced(raw), F.lit("[")) & F.contains(unfenced(raw), F.lit("]"))
    return F.when(marked, F.coalesce(parse_slice(raw, fields), recover_objects(raw, fields))).otherwise(empty)


def parse_fenced(raw: Column, fields: list[str]) -> Column:
    """The whole text without fences must be an array; else null."""
    body = unfenced(raw)
    return F.when(F.startswith(body, F.lit("[")) & is_json(body), _parse_array(body, fields))


def response_rows(responses: DataFrame, raw: str, fields: list[str] = names.RESPONSE_FIELDS) -> DataFrame:
    """One row per recovered object with its position in the response."""
    keep = [c for c in responses.columns if c != raw]
    rows = responses.select(*keep, F.posexplode(parse_response(F.col(raw), fields)).alias("obj_no", "o"))
    return rows.select(*keep, "obj_no", *[F.col(f"o.{f}").alias(f) for f in fields])


def useful(raw: Column) -> Column:
    """Neither empty nor a 'nothing found' answer."""
    return (F.length(raw) > 0) & ~F.contains(raw, F.lit(names.NOTHING_FOUND))


def attributes(spark) -> DataFrame:
    """The nine attributes: key, display name, patterns."""
    return spark.createDataFrame(
        [(i, k, n, p) for i, (k, n, p) in enumerate(names.ATTRIBUTES)],
        "attribute_no int, attribute string, attribute_name string, patterns array<string>",
    )


def mapping_context(config: DataFrame, tables: DataFrame, name: str, content: str, pos: str) -> DataFrame:
    """(attribute, pos, content): the tables whose file name contains one of the attribute's patterns, in file order.

    The fixed patterns are tested on each name, so a table row is labelled without a join. An attribute without patterns
    or without any table gets one row at position -1 with the text that says so. Fold with ``context_text``.
    """
    hits = F.array(*[
        F.when(tx.any_of([F.contains(F.lower(F.col(name)), F.lit(p.lower())) for p in patterns]), F.lit(key))
        for key, _, patterns in names.ATTRIBUTES if patterns
    ])
    labelled = tables.select(F.explode(F.array_compact(hits)).alias("attribute"), F.col(pos).alias("pos"), F.col(content).alias("content"))
    missing = F.concat(F.lit(names.MAPPING_NOT_FOUND[0]), F.col("attribute_name"), F.lit(names.MAPPING_NOT_FOUND[1]))
    message = F.when(F.size("patterns") == 0, names.NO_MAPPING_TABLE).otherwise(missing)
    without = config.join(labelled.select("attribute").distinct(), "attribute", "left_anti")
    return labelled.unionByName(without.select("attribute", F.lit(-1).cast("long").alias("pos"), message.alias("content")))


def context_text(context: DataFrame) -> DataFrame:
    """One prompt context per attribute: the result row is the prompt's text, whole."""
    merged = context.groupBy("attribute").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("__t"))
    return merged.select("attribute", F.array_join(F.transform("__t", lambda t: t["content"]), "\n").alias("context"))


def merge_rules(rules: DataFrame, keys: list[str], pos: str, group: str, raw: str, default: str = names.DEFAULT_LOGIC) -> DataFrame:
    """Useful rule texts of all groups under a header each, joined by blank lines; the default text when none is left."""
    headed = F.concat(F.lit("=== [Logic from "), F.col(group), F.lit("] ===\n"), F.col(raw))
    per = rules.select(*keys, F.when(useful(F.col(raw)), F.struct(F.col(pos).alias("p"), headed.alias("t"))).alias("__r"))
    merged = per.groupBy(*keys).agg(F.array_sort(F.collect_list("__r")).alias("__r"))
    joined = F.array_join(F.transform("__r", lambda r: r["t"]), "\n\n")
    return merged.select(*keys, F.when(F.size("__r") > 0, joined).otherwise(default).alias("logic"))


def item_line(number: Column, benefit: Column, template: Column) -> Column:
    return F.concat(
        F.lit("["), number.cast("string"), F.lit("] 담보명: "), benefit, F.lit(" / 세부담보템플릿명: "), template
    )


def _section(title: str, text: Column | None) -> list[Column]:
    """A titled block, left out where the text is missing or empty."""
    if text is None:
        return []
    return [F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), text, F.lit("\n"))).otherwise("")]


def rules_prompt(attribute: Column, group: Column, context: Column, instructions: Column | None = None, example: Column | None = None) -> Column:
    """Phase 1: ask for the inference rules of one attribute from one reference group."""
    return F.concat(
        F.lit("Role: insurance terms analyst.\nGoal: from the reference group ("), group,
        F.lit(") derive the rules that lead to '"), attribute, F.lit("'.\n"), *_section("Instructions", instructions),
        F.lit("Mapping tables:\n"), context, F.lit("\n"), *_section("Example", example),
        F.lit("Answer with one JSON object: attribute, appendix_refs[], context_clues[], "
              "rules[{template_pattern, code, kcd_range, exclusions[], note}]; leave rules empty when there are none."),
    )


def values_prompt(
    attribute: Column, context: Column, logic: Column, items: Column, instructions: Column | None = None, example: Column | None = None
) -> Column:
    """Phase 2: ask for the value of one attribute for a batch of items."""
    fields = ", ".join(names.RESPONSE_FIELDS)
    return F.concat(
        F.lit("Task: infer '"), attribute, F.lit("' for every item.\n"), *_section("Instructions", instructions),
        F.lit("Mapping tables:\n"), context, F.lit("\nRules:\n"), logic, F.lit("\n"), *_section("Example", example),
        F.lit("Items:\n"), items,
        F.lit(f"\nAnswer with a JSON array of objects with the fields {fields}. "
              "An empty inferred_code needs its reason in ref_sentence."),
    )


def batch_prompts(items: DataFrame, config: DataFrame, benefit: str, template: str, pos: str, size: int = 20) -> DataFrame:
    """(attribute, batch_no, batch_total, prompt): one prompt per attribute and batch of ``size`` items.

    ``config`` holds attribute, attribute_name, context and logic, and if wanted instructions and a worked example: one row per
    attribute, of which there are nine. A batch collects ``size`` lines.
    """
    extra = [F.col(c) if c in config.columns else None for c in ("instructions", "example")]
    numbered = batches(items, pos, size)
    line = item_line(F.col("row_no"), F.col(benefit), F.col(template))
    lists = numbered.groupBy("batch_no", "batch_total").agg(F.array_sort(F.collect_list(F.struct("row_no", line.alias("line")))).alias("__l"))
    texts = lists.select("batch_no", "batch_total", F.array_join(F.transform("__l", lambda x: x["line"]), "\n").alias("items"))
    keys = F.array(*[F.lit(key) for key, _, _ in names.ATTRIBUTES])
    each = texts.withColumn("attribute", F.explode(keys)).join(config, "attribute")
    prompt = values_prompt(F.col("attribute_name"), F.col("context"), F.col("logic"), F.col("items"), *extra)
    return each.select("attribute", "batch_no", "batch_total", prompt.alias("prompt"))


def budget_rows(pieces: DataFrame, keys: list[str], pos: str, name: str, content: str, limit: int | None = None) -> DataFrame:
    """Non-empty pieces under '=== name ===' headers in order: (keys, pos, ``before``, ``piece``).

    ``before`` counts the characters of the earlier pieces in full, headers included. With a ``limit`` the piece that passes it is cut and
    later ones are left out; without one nothing is. Only lengths are put in order, the contents are joined back.
    """
    at = F.struct(*keys, pos)
    sizes = pieces.filter(F.length(content) > 0).select(
        *keys, pos, (F.length(content) + F.length(name) + F.lit(11)).cast("long").alias("__len")
    )
    placed = running_before(sizes, keys, pos, F.col("__len"), "before")
    kept = placed if limit is None else placed.filter(F.col("before") < limit)
    opened = pieces.withColumn("__at", at).join(kept.select(at.alias("__at"), "before"), "__at")
    body = F.col(content) if limit is None else F.substring(F.col(content), F.lit(1), (F.lit(limit) - F.col("before")).cast("int"))
    piece = F.concat(F.lit("\n=== "), F.col(name), F.lit(" ===\n"), body, F.lit("\n"))
    return opened.select(*keys, pos, "before", piece.alias("piece"))


def budget_text(pieces: DataFrame, keys: list[str], pos: str, name: str, content: str, limit: int) -> DataFrame:
    """The pieces of ``budget_rows`` as one text per key: a group collects at most ``limit`` characters plus headers."""
    shown = budget_rows(pieces, keys, pos, name, content, limit)
    merged = shown.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("piece").alias("t")))).alias("__p"))
    return merged.select(*keys, F.array_join(F.transform("__p", lambda r: r["t"]), "").alias("text"))


def csv_lines(table: DataFrame, name: str, pos: str, columns: list[str]) -> DataFrame:
    """A table as CSV text, one row per line: name at -2, header at -1, then the rows by position."""
    spark = table.sparkSession
    top = spark.createDataFrame([(-2, f"=== {name} ==="), (-1, ",".join(columns))], "line_no long, line string")
    return top.unionByName(table.select(F.col(pos).cast("long").alias("line_no"), F.to_csv(F.struct(*columns)).alias("line")))


def call_model(prompts: DataFrame, model_fn, schema: str) -> DataFrame:
    """Optional hook: ``model_fn`` maps an iterator of prompt frames to response frames."""
    return prompts.mapInPandas(model_fn, schema)
