"""Scores, periods, rates and lenient numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import names


def label_score(label: Column) -> Column:
    tests = [F.when(label == word, F.lit(score)) for word, score in names.SCORES.items()]
    return F.coalesce(*tests, F.lit(names.UNKNOWN_SCORE))


def score_label(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.6, "medium").otherwise("low")


def percent_value(text: Column) -> Column:
    """'85%' to 85.0; anything else that is no number to 0.0."""
    return F.coalesce(F.trim(F.replace(text, F.lit("%"), F.lit(""))).try_cast("double"), F.lit(0.0))


def percent_level(percent: Column) -> Column:
    return (
        F.when(percent.isNull(), "-").when(percent >= 95, "high").when(percent >= 70, "medium").otherwise("low")
    )


def lenient_int(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def lenient_double(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def period_text(days: Column) -> Column:
    """0 is empty; whole months below a year, whole years above, else days."""

    def say(value, unit):
        return F.concat(value.cast("int").cast("string"), F.lit(unit))

    return (
        F.when(days == 0, "")
        .when((days >= 30) & (days < 365) & (days % 30 == 0), say(days / 30, "개월"))
        .when((days >= 365) & (days % 365 == 0), say(days / 365, "년"))
        .otherwise(say(days, "일"))
    )


def rate_text(rate: Column, op: Column, operand: Column, percent: Column) -> Column:
    """Rate after an optional '*x' or '/x'; whole numbers lose their decimals, others keep one."""
    x = F.nullif(operand, F.lit("")).try_cast("double")
    value = F.when((op == "*") & x.isNotNull(), rate * x).when((op == "/") & (x != 0), rate / x).otherwise(rate)
    shown = F.when(value == F.floor(value), value.try_cast("bigint").cast("string")).otherwise(
        F.format_string("%.1f", value)
    )
    return F.when(rate.isNotNull(), F.concat(shown, F.coalesce(percent, F.lit(""))))


def progress(step: Column, total: int) -> Column:
    return F.round((step - 1) / F.lit(total), 2)


def pick(values: Column, n: Column) -> Column:
    """n-th entry counted from 1, the last for 0, null when out of range."""
    return F.when(n == 0, F.try_element_at(values, F.lit(-1))).otherwise(F.try_element_at(values, n))


def kth_smallest(values: Column, k: Column) -> Column:
    return pick(F.array_sort(values), k)
