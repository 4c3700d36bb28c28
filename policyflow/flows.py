"""Whole runs: attribute extraction, risk items, terms generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import names
from .functions import numbers, tags, text as tx
from .operators import assembly, containment, lookups, project, responses, review, structures
from .operators.ordered import batches
from .session import cut


def each_attribute(items: DataFrame) -> DataFrame:
    """Items once per attribute: the attribute is a column, not a loop."""
    nine = F.array(*[
        F.struct(F.lit(key).alias("attribute"), F.lit(title).alias("attribute_name")) for key, title, _ in names.ATTRIBUTES
    ])
    return items.select("*", F.explode(nine).alias("__a")).select(*items.columns, "__a.*")


def extract(items: DataFrame, raw: DataFrame, benefit: str = "benefit_name", template: str = "template_name", provider: str = "primary") -> DataFrame:
    """Result rows of all attributes.

    ``raw`` holds (attribute, pos, raw): the answers of the model in order. Objects are recovered from the texts, matched to
    the items, given their reason and score, and gated. Unmatched items stay with ``matched`` false.
    """
    objects = responses.response_rows(raw, "raw")
    # one order over all answers of an attribute: answer, then object
    objects = objects.withColumn("at", F.struct("pos", "obj_no"))
    values = ["inferred_code", "confidence", "source", "ref_page", "ref_sentence"]
    matched = containment.match_responses(each_attribute(items), objects, benefit, template, values, "at", by=["attribute"])
    reason = containment.reason(F.col("attribute_name"), F.col("ref_sentence"), F.col("matched"), names.UNMATCHED)
    scored = matched.withColumns({
        "reason": reason, "confidence_label": F.col("confidence"),
        "confidence": F.when(F.col("matched"), numbers.label_score(F.col("confidence"))), "provider_used": F.lit(provider),
    })
    return scored.withColumn("verification_status", review.gate_status(F.col("confidence")))


def risk_batches(targets: DataFrame, pos: str, size: int = 5) -> DataFrame:
    """Distinct risk names in first-seen order, ``size`` of them per batch."""
    risk = project.find_risk_column(targets.columns)
    firsts = targets.filter(F.col(f"`{risk}`").isNotNull()).groupBy(F.col(f"`{risk}`").alias("risk")).agg(F.min(pos).alias("first_pos"))
    return batches(firsts, "first_pos", size)


def risk_items(targets: DataFrame, raw: DataFrame, pos: str) -> DataFrame:
    """Item rows of the answers with the id of the first target row of their risk.

    ``raw`` holds the answer texts in ``raw``; an answer whose array does not parse gives nothing. Columns: id, risk, item
    columns, reason.
    """
    risk = project.find_risk_column(targets.columns)
    parsed = F.explode(responses.parse_slice(F.col("raw"), names.RISK_FIELDS)).alias("o")
    items = raw.select(parsed).select(*[F.col(f"o.{c}").alias(risk if c == names.RISK_FIELDS[0] else c) for c in names.RISK_FIELDS])
    joined = lookups.join_first(project.ensure_columns(items, names.RISK_FIELDS[1:5]), targets, risk, pos)
    order = project.risk_columns(joined.columns, risk, names.RISK_FIELDS[1:5])
    return project.ordered_columns(joined, order)


def context_struct(coverage_columns: list[str]) -> Column:
    """Context struct from the coverage's own columns and the flags of its structure; missing ones are 0."""
    flag = lambda c: (numbers.lenient_int(F.col(c).cast("string")) if c in coverage_columns else F.lit(0)).alias(c)
    own = ["confirm", "parent", "reserve", "extend", "team", "renew", "independent"]
    return F.struct(
        F.coalesce("exempt", F.lit(0)).alias("exempt"), F.coalesce("reduce", F.lit(0)).alias("reduce"), *[flag(c) for c in own],
        (flag("renew") == 0).cast("int").alias("no_renew"), F.coalesce("once", F.lit(True)).alias("once"),
        F.coalesce("twice", F.lit(False)).alias("twice"),
    )


def _numbers_in(clauses: DataFrame, key: str, text: str, pattern: str, group: int) -> DataFrame:
    """(key, no): the numbers that the tags of each text ask for."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))))
    return clauses.select(key, found.alias("no")).select(key, F.col("no").try_cast("int").alias("no"))


def generate_terms(
    coverages: DataFrame, mapping: DataFrame, clauses: DataFrame, sections: DataFrame, phrases: DataFrame,
    model: DataFrame, structure: DataFrame, multiple: DataFrame, product: Column, pos: str = "pos",
    sub_names: DataFrame | None = None,
) -> DataFrame:
    """Rendered clauses in document order: (section_no, line_no, title, body).

    coverages: pos, coverage_code, module and attribute columns. mapping: coverage_code, rep_code, category, name, pos.
    clauses: code, category, comment_no, title, body. sections: section, section_no. The structure tables are those of
    ``structures.structure_chain`` with ``sub_code``; their names come from ``sub_names`` (default: the mapping). Only the coverage that brings a title is looked up in the structures.
    """
    mapped = lookups.tiered_lookup(coverages, mapping, "coverage_code", "coverage_code", ["rep_code", "category"], "pos")
    mapped = mapped.withColumnRenamed("rep_code", "code")
    placed = cut(assembly.assemble_rows(mapped, clauses, sections, pos=pos))

    run = cut(structures.structure_chain(placed.select(pos, "coverage_code"), model, structure, multiple, product, with_header=True))
    chain = run.filter("sub_no > 0")
    flags = structures.reduction_flags(chain, [pos], "exempt_days", "days", "days2", "ratio2")
    reduced = structures.reduced_rows(chain, [pos], "sub_no", "days", "days2")
    rated = chain.select(pos, F.col("sub_no").cast("int").alias("no"), *structures.period_and_rate("days", "days2", "rate"))
    # the n-th name is that of the n-th code of the run, whose first code is the header row's
    titles = mapping if sub_names is None else sub_names
    titles = titles.select(F.col("coverage_code").alias("code"), "name", F.col("pos").alias("name_pos"))
    named = lookups.sub_names(run, titles, [pos], "sub_no", "sub_code", "code", "name", "name_pos")
    named = named.select(pos, (F.col("sub_no") + 1).cast("int").alias("no"), "name")

    lists = [
        structures.wanted_lists(named, _numbers_in(placed, pos, "body", tags.NAME_TAG, 1), [pos], "name", "names"),
        structures.wanted_lists(reduced, _numbers_in(placed, pos, "body", tags.PERIOD_TAG, 1), [pos], "periods", "periods"),
        structures.wanted_lists(rated, _numbers_in(placed, pos, "body", tags.RATE_TAG, 2), [pos], "rates", "rates"),
    ]
    full = placed.join(flags, pos, "left")
    for part in lists:
        full = full.join(part, pos, "left")
    full = full.withColumn("ctx", context_struct(coverages.columns))
    codes = tx.code_list(F.col("code"))
    getters = {
        "name_of": lambda n: structures.entry(F.col("names"), n),
        "periods_of": lambda n: structures.entry(F.col("periods"), n),
        # the rates belong to the whole code text of the coverage
        "rates_of": lambda n, m: F.when(numbers.pick(codes, n) == F.col("code"), structures.entry(F.col("rates"), m)),
    }
    index = assembly.phrase_index(assembly.phrase_table(phrases, "pos"))
    rendered = assembly.render_clauses(full, index, "body", "ctx", "rendered", getters)
    return rendered.select("section_no", "line_no", "title", F.col("rendered").alias("body"))
