"""Classification codes: letters followed by a number."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CODE = r"^([A-Z]+)(\d+(?:\.\d+)?)"


def alpha(code: Column) -> Column:
    """Letters of an upper-case code; the whole text when it is no code, '' for null.

    Never null, so that a join on it adds no test that Spark would push to every row below a distinct.
    """
    return F.coalesce(F.when(code.rlike(CODE), F.regexp_extract(code, CODE, 1)).otherwise(code), F.lit(""))


def number(code: Column, whole: bool = False) -> Column:
    """Number of an upper-case code, 0.0 when it is no code; ``whole`` drops decimals."""
    value = F.coalesce(F.regexp_extract(code, CODE, 2).try_cast("double"), F.lit(0.0))
    return F.floor(value).cast("double") if whole else value


def parse(code: Column) -> Column:
    code = F.upper(code)
    return F.struct(alpha(code).alias("alpha"), number(code).alias("num"))


def in_range(code: Column, low: Column, high: Column, mode: str = "reference", whole: bool = False) -> Column:
    """Range test.

    ``reference``: the letters of ``low`` decide; with the same letters only the numbers are compared,
    otherwise only the letters. ``ordered`` compares (letters, number) pairs.
    """
    code, low, high = F.upper(code), F.upper(low), F.upper(high)
    a, x = alpha(code), number(code, whole)
    fa, fx = alpha(low), number(low, whole)
    ta, tx = alpha(high), number(high, whole)
    if mode == "reference":
        return F.when(a == fa, x.between(fx, tx)).otherwise((fa <= a) & (a <= ta))
    if mode == "ordered":
        after = (a > fa) | ((a == fa) & (x >= fx))
        before = (a < ta) | ((a == ta) & (x <= tx))
        return after & before
    raise ValueError(f"unknown mode {mode!r}")


def same_code(a: Column, b: Column) -> Column:
    """Equal without case and blanks; two empty codes are equal."""
    plain = [F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(""))) for c in (a, b)]
    return plain[0] == plain[1]
