"""Ranks with ties, moving frames, grouping sets and intersection, for keys that hold much of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from . import ordered
from .timed import SECOND, micros

#: Rows of a block of a moving frame.
BLOCK = 1 << 18


def ranks(df: DataFrame, keys: list[str], value: str, tie: str, tiles: int = 4) -> DataFrame:
    """Adds rank, dense_rank, percent_rank, cume_dist and ntile of the rows of a key by ``value``, from the smallest; nulls are the smallest.

    ``tie`` makes the order total for ntile; all other numbers are equal for equal values. Null keys are a key, repeated values ties. Rows are numbered over ranges of (key, value, tie), distinct values over
    ranges of (key, value); a value's rank and its end are the least and the largest number among its rows. No task holds a key or the rows of one value."""
    numbered = cut(ordered.number_sorted(df, keys, [value, tie], "__no"))
    same = F.struct(*keys, value)
    values = numbered.groupBy(*keys, value).agg(F.min("__no").alias("rank"), F.max("__no").alias("__last"))
    values = ordered.number_sorted(values, keys, [value], "dense_rank").select(same.alias("__same"), "rank", "dense_rank", "__last")
    totals = numbered.groupBy(*keys).agg(F.max("__no").alias("__n")).select(F.struct(*keys).alias("__of"), "__n")
    joined = numbered.join(values, same == F.col("__same")).join(totals, F.struct(*keys) == F.col("__of"))
    n, no = F.col("__n"), F.col("__no")
    size, larger = F.floor(n / tiles), n % tiles
    tile = F.when(no <= larger * (size + 1), F.floor((no - 1) / (size + 1)) + 1).otherwise(larger + F.floor((no - larger * (size + 1) - 1) / F.greatest(size, F.lit(1))) + 1)
    return joined.select(
        *df.columns, F.col("rank").cast("long").alias("rank"), F.col("dense_rank").cast("long").alias("dense_rank"),
        F.when(n > 1, (F.col("rank") - 1) / (n - 1)).otherwise(0.0).alias("percent_rank"), (F.col("__last") / n).alias("cume_dist"), tile.cast("long").alias("ntile"))


def moving_rows(df: DataFrame, keys: list[str], order: list[str], rows: int, aggregates: dict[str, Column], width: int = BLOCK) -> DataFrame:
    """Adds aggregates over the row and the ``rows - 1`` before it in its key, in the order of columns that make it total.

    Rows are numbered and cut in blocks of ``width`` numbers (or ``rows``, if that is more). The last ``rows - 1`` rows of a block also go to the next one, as its halo, and
    a window runs inside a block; the halo's own results are dropped. Null keys are a key."""
    width = max(width, rows)
    numbered = ordered.number_sorted(df, keys, order, "__no").withColumn("__place", F.expr(f"(__no - 1) div {width}"))
    halo = numbered.filter((F.col("__no") - 1) % width >= width - (rows - 1)).withColumn("__place", F.col("__place") + 1)
    both = numbered.withColumn("__own", F.lit(True)).unionByName(halo.withColumn("__own", F.lit(False)))
    frame = Window.partitionBy(*keys, "__place").orderBy("__no").rowsBetween(-(rows - 1), 0)
    return both.withColumns({n: c.over(frame) for n, c in aggregates.items()}).filter("__own").drop("__no", "__place", "__own")


def moving_time(df: DataFrame, keys: list[str], time: str, seconds: int, aggregates: dict[str, Column], frames: int = 4) -> DataFrame:
    """Adds aggregates over all rows of the key from ``seconds`` before the row's time up to it, both included (rows of one time see each other).

    A key is cut in blocks of ``frames`` times the frame; rows less than a frame before the end of a block also go to the next one, as its halo. A task holds a block and
    its halo, not a key. Rows without a time see the rows without one; null keys are a key."""
    frame = seconds * SECOND
    width = frames * frame
    timed = df.withColumn("__at", micros(F.col(time))).withColumn("__place", F.floor(F.col("__at") / width))
    halo = timed.filter((F.col("__place") + 1) * width - F.col("__at") <= frame).withColumn("__place", F.col("__place") + 1)
    both = timed.withColumn("__own", F.lit(True)).unionByName(halo.withColumn("__own", F.lit(False)))
    window = Window.partitionBy(*keys, "__place").orderBy("__at").rangeBetween(-frame, 0)
    return both.withColumns({n: c.over(window) for n, c in aggregates.items()}).filter("__own").drop("__at", "__place", "__own")


def cube(df: DataFrame, columns: list[str], sums: dict[str, Column], distinct: dict[str, str], sets: list[list[str]] | None = None) -> DataFrame:
    """Sums and distinct counts for several sets of grouping columns at once (all sets without ``sets``), with ``grouping_id``: a bit for each column that is
    summed over, the first column highest.

    ``sums`` are named columns that are added up; ``distinct`` names columns whose distinct non-null values are counted. The finest groups are
    made first, so that the rows that Spark expands into sets are groups, not the table's rows; for distinct counts they are the finest groups and
    values, which stay mergeable: a value counts once in each set, whatever number of finer groups has it. Null is a group of its own, told from "all" by grouping_id."""
    sets = sets if sets is not None else [[c for k, c in enumerate(columns) if not mask >> (len(columns) - 1 - k) & 1] for mask in range(1 << len(columns))]
    fine = df.groupBy(*columns).agg(*[F.sum(c).alias(n) for n, c in sums.items()])

    def expanded(rows: DataFrame, always: list[str], *aggregates: Column) -> DataFrame:
        given = [[F.col(c) for c in (*s, *always)] for s in sets]
        return rows.groupingSets(given, *[F.col(c) for c in (*columns, *always)]).agg(*aggregates, *[F.grouping(c).alias(f"__g{k}") for k, c in enumerate(columns)])

    number = sum((F.col(f"__g{k}").cast("long") * (1 << (len(columns) - 1 - k)) for k in range(len(columns))), F.lit(0).cast("long"))
    flags = [f"__g{k}" for k in range(len(columns))]
    out = expanded(fine, [], *[F.sum(n).alias(n) for n in sums]).withColumn("grouping_id", number).drop(*flags)
    for name, column in distinct.items():
        values = df.filter(F.col(column).isNotNull()).groupBy(*columns, F.col(column).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
        counted = expanded(values, ["__value"], F.sum("__n").alias("__n")).withColumn("grouping_id", number)
        counted = counted.groupBy(F.struct(*columns, "grouping_id").alias("__set")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counted, F.struct(*columns, "grouping_id") == F.col("__set"), "left").drop("__set").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def intersect(left: DataFrame, right: DataFrame, columns: list[str], every: bool = False) -> DataFrame:
    """Rows (by ``columns``) that both sides have: once, or with ``every`` as often as the side that has fewer. Null equals null.

    Rows of each side are counted by their digest and themselves in one aggregate over both sides, combined before the shuffle: no join, and a row that
    stands there a million times is one row with a count."""
    def counted(side: DataFrame, name: str, other: str) -> DataFrame:
        rows = side.select(F.xxhash64(*columns).alias("__digest"), *columns)
        return rows.withColumn(name, F.lit(1).cast("long")).withColumn(other, F.lit(0).cast("long"))

    both = counted(left, "__l", "__r").unionByName(counted(right, "__r", "__l"))
    totals = both.groupBy("__digest", *columns).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r")).filter("__l > 0 AND __r > 0")
    if every:
        totals = totals.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("__l", "__r"))))
    return totals.select(*columns)
