"""Aggregates whose state is kept in a table and merged later: distinct counts and quantiles per day for any span of days.

States are Spark's own sketches (HyperLogLog for distinct counts, KLL for quantiles), one row per day and key. Merging reads these rows only, whatever the
number of events behind them; a day that is delivered again replaces its states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Buckets of a distinct count are 2 to the power of this; its standard error is about 0.8 over their root, 0.65 percent. Size of a quantile's state; the rank it is
#: asked for is met within about 1.3 percent.
PRECISION, KEPT = 14, 200


def daily_states(df: DataFrame, day: Column, keys: list[str], distinct: dict[str, str], quantiles: dict[str, str]) -> DataFrame:
    """(day, keys, n, one state per name) of each day and key: ``distinct`` and ``quantiles`` name columns. Null values are not counted; rows without a day are left out,
    null keys are a key. States are combined before they are shuffled, so a large key is no burden."""
    return df.withColumn("day", day).filter(F.col("day").isNotNull()).groupBy("day", *keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.hll_sketch_agg(c, F.lit(PRECISION)).alias(n) for n, c in distinct.items()],
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KEPT)).alias(n) for n, c in quantiles.items()],
    )


def merged(states: DataFrame, keys: list[str], distinct: list[str], quantiles: list[str], span: Column | None = None) -> DataFrame:
    """(keys, n, one state per name) over the days for which ``span`` holds, all without it. The states can be merged again."""
    rows = states if span is None else states.filter(span)
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), *[F.hll_union_agg(c).alias(c) for c in distinct], *[F.kll_merge_agg_double(c).alias(c) for c in quantiles])


def read_states(states: DataFrame, distinct: list[str], quantiles: dict[str, list[float]]) -> DataFrame:
    """The states as numbers: a distinct count each, and for each quantile an array of the values at the given ranks (null where there is no value)."""
    ranks = {n: F.array(*[F.lit(float(r)) for r in given]) for n, given in quantiles.items()}
    values = {n: F.when(F.kll_sketch_get_n_double(n) > 0, F.kll_sketch_get_quantile_double(F.col(n), r)) for n, r in ranks.items()}
    return states.withColumns({**{n: F.hll_sketch_estimate(n) for n in distinct}, **values})
