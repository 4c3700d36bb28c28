"""Benefit structures: model row, structure run, multiples, term rows and what is summed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..session import cut
from .ordered import BLOCK, first_per_key, number_in_order, number_sorted


def ascending_run(
    structure: DataFrame, key: str, pos: str, sequence: str, width: int = BLOCK
) -> DataFrame:
    """Rows of the run that opens each key.

    The first row is the header (``sub_no`` 0), the second always counts, a later one only while its sequence number is
    above the count so far; the run ends at the first row that is not.
    """
    # read for the ends of the runs and for their rows, so it is worked out once
    numbered = cut(number_in_order(structure, [key], pos, "__rn", width).withColumn("sub_no", F.col("__rn") - 1))
    breaks = (F.col("sub_no") >= 2) & ~F.coalesce(F.col(sequence) > F.col("sub_no") - 1, F.lit(False))
    ends = numbered.filter(breaks).groupBy(key).agg(F.min("sub_no").alias("__end"))
    joined = numbered.join(ends, key, "left")
    kept = joined.filter(F.col("__end").isNull() | (F.col("sub_no") < F.col("__end")))
    return kept.drop("__rn", "__end")


def run_length(run: DataFrame, key: str) -> DataFrame:
    """Number of sub-coverages per key: the run without its header row."""
    return run.groupBy(key).agg((F.count("*") - 1).alias("sub_count"))


def waiver(run: DataFrame, key: str, exits: str) -> DataFrame:
    """Premium waiver: second exit-rate count of the header row above zero."""
    head = run.filter(F.col("sub_no") == 0)
    return head.select(key, F.coalesce(F.col(exits) > 0, F.lit(False)).alias("waiver"))


def model_row(coverages: DataFrame, model: DataFrame, code: str, pos: str, kind: str | None = None) -> DataFrame:
    """First model row of the code, or of code and kind for an independent rider."""
    keys = [code] if kind is None else [code, kind]
    return coverages.join(first_per_key(model, keys, pos).drop(pos), keys, "left")


def structure_chain(
    coverages: DataFrame, model: DataFrame, structure: DataFrame, multiple: DataFrame, product: Column,
    code: str = "coverage_code", expansion: str = "expansion", key: str = "key", pos: str = "row_no",
    sequence: str = "sequence", multiple_key: str = "multiple_key", width: int = BLOCK, with_header: bool = False,
) -> DataFrame:
    """Coverage, its run of sub-coverages (with the header row if asked for) and the first multiple row of each."""
    chosen = model_row(coverages, model.select(code, pos, expansion), code, pos)
    chosen = chosen.withColumn(key, F.concat_ws("_", product, F.col(expansion)))
    run = ascending_run(structure, key, pos, sequence, width)
    run = run if with_header else run.filter("sub_no > 0")
    benefits = first_per_key(multiple, [multiple_key], pos).drop(pos)
    subs = run.drop(pos).join(benefits, multiple_key, "left")
    return chosen.join(subs, key)


def reduction_flags(
    subs: DataFrame, keys: list[str], exempt_days: str, days: str, days2: str, ratio2: str
) -> DataFrame:
    """Sums of exemption and reduction periods, their flags, and whether the benefit is reduced twice."""
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))
    twice = (number(days2) > 0) & (number(ratio2) > 0)
    sums = subs.groupBy(*keys).agg(
        F.sum(number(exempt_days)).alias("sum_exempt"), F.sum(number(days)).alias("sum_reduce"),
        F.max(twice).alias("twice"),
    )
    return sums.select(
        *keys, "sum_exempt", "sum_reduce",
        (F.col("sum_exempt") > 0).cast("int").alias("exempt"), (F.col("sum_reduce") > 0).cast("int").alias("reduce"),
        (~F.col("twice")).alias("once"), "twice",
    )


def entry_ages(terms: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Smallest and largest entry age; an empty cell counts as 0."""
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("int"), F.lit(0))
    return terms.groupBy(*keys).agg(
        F.coalesce(F.min(number(low)), F.lit(0)).alias("age_from"),
        F.greatest(F.coalesce(F.max(number(high)), F.lit(0)), F.lit(0)).alias("age_to"),
    )


def period_rows(terms: DataFrame, keys: list[str], pos: str, columns: list[str], width: int = BLOCK) -> DataFrame:
    """The list of term and payment periods, one numbered row per entry."""
    return number_in_order(terms.select(*keys, pos, *columns), keys, pos, "entry_no", width).drop(pos)


def period_and_rate(days: str, days2: str, rate: str) -> list[Column]:
    """Non-zero reduction periods and the pay rate (100.0 when missing or 0) of one sub-coverage."""
    number = lambda c: F.col(c).cast("string").try_cast("int")
    periods = F.filter(F.array(number(days), number(days2)), lambda x: x.isNotNull() & (x != 0))
    value = F.col(rate).cast("string").try_cast("double")
    rates = F.array(F.coalesce(F.when(value != 0, value), F.lit(100.0)))
    return [periods.alias("periods"), rates.alias("rates")]


def ordered_group_rows(coverages: DataFrame, group: str, fallback: str, code: str, name: str, fallback_name: str, pos: str) -> DataFrame:
    """Printed name -> benefit names by coverage code, one numbered row per name; equal codes keep file order."""
    rows = coverages.select(
        tx.strip(tx.first_filled(F.col(group), F.col(fallback))).alias(group),
        tx.strip(F.col(code)).alias(code), tx.strip(tx.first_filled(F.col(name), F.col(fallback_name))).alias(name), pos,
    ).filter((F.col(group) != "") & (F.col(name) != ""))
    return number_sorted(rows, [group], [code, pos], "name_no")


def reduced_rows(subs: DataFrame, keys: list[str], order: str, days: str, days2: str) -> DataFrame:
    """Sub-coverages with a reduction period, numbered from 1 in order: ``no`` and ``periods``."""
    periods, _ = period_and_rate(days, days2, days)
    rows = subs.select(*keys, order, periods).filter(F.size("periods") > 0)
    return number_in_order(rows, keys, order, "no").select(*keys, F.col("no").cast("int").alias("no"), "periods")


def wanted_lists(rows: DataFrame, wanted: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, ``out``): the entries a clause asks for as an array of (no, value).

    ``rows`` and ``wanted`` hold (keys, no). What is collected per clause is bounded by the tags of its text.
    """
    needed = rows.join(wanted.select(*keys, "no").distinct(), [*keys, "no"])
    return needed.groupBy(*keys).agg(F.collect_list(F.struct("no", F.col(value).alias("value"))).alias(out))


def entry(entries: Column, no: Column) -> Column:
    """Value of the entry with that number, null when there is none."""
    hit = F.filter(entries, lambda e: e["no"] == no)
    return F.try_element_at(hit, F.lit(1))["value"]
