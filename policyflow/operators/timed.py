"""Joins and groups along time: as-of join, overlap join, sessions.

Times are any column that casts to timestamp; they are compared in whole microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import ordered

SECOND = 1_000_000
#: Ratio of the cell widths of two levels of the grid.
WIDER = 8


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def asof_join(
    left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_time: str, right_time: str, tie: str, take: dict[str, str],
    tolerance: int | None = None,
) -> DataFrame:
    """Every left row with the newest right row of its key at or before its time.

    ``on`` pairs the key columns of both sides; ``take`` names the right columns that come along, and how they are called. Of right rows with one time the one with
    the largest ``tie`` counts. ``tolerance``: seconds that the right row may be older at most; an older one is as none. Left rows without a match keep
    nulls, and so do those with a null key or time; right rows with either are never a match. Repeated left rows are kept.

    Both sides are merged in the order of key and time, and the newest right row is filled forward inside ranges of this order and carried over them, so that a
    large key is the work of many tasks; there is no join of the two sides."""
    keys = [f"__k{i}" for i in range(len(on))]
    own = F.struct(*left.columns)
    hit = F.struct(micros(F.col(right_time)).alias("at"), *[F.col(c).alias(name) for c, name in take.items()])
    rows = left.select(*[F.col(a).alias(k) for k, (a, _) in zip(keys, on)], micros(F.col(left_time)).alias("__at"), F.lit(1).alias("__side"),
                       F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), own.alias("__left"))
    found = right.select(*[F.col(b).alias(k) for k, (_, b) in zip(keys, on)], micros(F.col(right_time)).alias("__at"), F.lit(0).alias("__side"),
                         F.col(tie).alias("__tie"), hit.alias("__hit"))
    found = found.dropna(subset=[*keys, "__at"])
    both = rows.unionByName(found, allowMissingColumns=True)
    filled = ordered.last_filled_sorted(both, keys, ["__at", "__side", "__tie"], F.col("__hit"), "__hit").filter("__side = 1")
    near = F.col("__at").isNotNull()
    if tolerance is not None:
        near = near & (F.col("__at") - F.col("__hit.at") <= tolerance * SECOND)
    return filled.select("__left.*", *[F.when(near, F.col(f"__hit.{name}")).alias(name) for name in take.values()])


def _levels(left: DataFrame, right: DataFrame, start: str, end: str, unit: int) -> list[int]:
    """Cell widths from ``unit`` up to the longest interval of both sides."""
    length = F.max(F.col(end) - F.col(start))
    most = max([x or 0 for x in (left.agg(length).first()[0], right.agg(length).first()[0])])
    widths = [unit]
    while widths[-1] < most:
        widths.append(widths[-1] * WIDER)
    return widths


def _entered(side: DataFrame, widths: list[int], start: str, end: str) -> DataFrame:
    """The rows in their cells: at their own level, the first that is as wide as they are long, and at all wider ones; two cells a level at most."""
    length, own = F.col(end) - F.col(start), F.lit(len(widths) - 1)
    for k in range(len(widths) - 2, -1, -1):
        own = F.when(length <= widths[k], F.lit(k)).otherwise(own)
    width = F.element_at(F.array(*map(F.lit, widths)), F.col("__level") + 1).cast("long")
    levels = side.withColumn("__own", own).withColumn("__level", F.explode(F.sequence(F.col("__own"), F.lit(len(widths) - 1))))
    levels = levels.withColumn("__width", width).withColumn("__cell", F.explode(F.sequence(F.expr(f"`{start}` div __width"), F.expr(f"`{end}` div __width"))))
    return levels.withColumn("__own", F.col("__own") == F.col("__level"))


def overlap_join(
    left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_span: tuple[str, str], right_span: tuple[str, str],
    take: dict[str, str], overlap: str = "overlap_seconds", unit: int = 86_400,
) -> DataFrame:
    """Pairs of a left and a right row of one key whose time spans share at least a moment (both ends belong to a span).

    ``take`` names the right columns that come along; ``overlap`` is the shared time in seconds. Spans with a null end or a null key, or that end before they begin, are never in a pair;
    repeated rows pair as often as they stand there.

    A span is entered in the cells of a grid with several widths (``unit`` seconds, and WIDER times more each): two cells at its own width and each wider one.
    Two spans meet at the wider one's width and count in the first cell they share, so each pair comes up once, and the join is an equi join that can split a crowded cell."""
    keys = [f"__k{i}" for i in range(len(on))]
    span = lambda a, b: (micros(F.col(a)).alias("__a"), micros(F.col(b)).alias("__b"))
    mine = left.select(*[F.col(a).alias(k) for k, (a, _) in zip(keys, on)], *span(*left_span), F.struct(*left.columns).alias("__left"))
    their = right.select(*[F.col(b).alias(k) for k, (_, b) in zip(keys, on)], *span(*right_span), F.struct(*[F.col(c).alias(n) for c, n in take.items()]).alias("__right"))
    mine, their = (x.dropna(subset=[*keys, "__a", "__b"]).filter("__a <= __b") for x in (mine, their))
    widths = _levels(mine, their, "__a", "__b", unit * SECOND)
    mine = _entered(mine, widths, "__a", "__b")
    their = _entered(their, widths, "__a", "__b").select(*keys, "__level", "__cell", F.col("__a").alias("__c"), F.col("__b").alias("__d"), F.col("__own").alias("__theirs"), "__right")
    pairs = mine.join(their, [*keys, "__level", "__cell"]).filter("(__own OR __theirs) AND __a <= __d AND __c <= __b AND __cell = greatest(__a, __c) div __width")
    shared = (F.least("__b", "__d") - F.greatest("__a", "__c")) / SECOND
    return pairs.select("__left.*", "__right.*", shared.alias(overlap))


def with_sessions(df: DataFrame, keys: list[str], time: str, tie: str, gap: int, out: str = "session_no") -> DataFrame:
    """Numbers the sessions of a key from 1: a row opens one if it comes ``gap`` seconds or more after the row before it.

    ``tie`` orders rows of one time. Rows without a time are left out; null keys are a key. Ranges of (key, time) are numbered apart; of each range one
    row (first and last time, openings inside) is carried over the ranges of its key, which tells whether its first row goes on with an open session."""
    rows = ordered.in_ranges(df.withColumn("__at", micros(F.col(time))).dropna(subset=["__at"]), keys, ["__at", tie])
    inside = Window.partitionBy("__key", "__block").orderBy("__at", tie)
    before = F.lag("__at").over(inside)
    marked = rows.withColumn("__opens", F.when(before.isNull(), 0).otherwise((F.col("__at") - before >= gap * SECOND).cast("int")))
    marked = marked.withColumn("__local", F.sum("__opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = marked.groupBy("__key", "__block").agg(F.min("__at").alias("first"), F.max("__at").alias("last"), F.sum("__opens").alias("opened"))
    along = Window.partitionBy("__key").orderBy("__block")
    since = F.col("first") - F.lag("last").over(along)
    ranges = ranges.withColumn("opens", F.when(since.isNull() | (since >= gap * SECOND), 1).otherwise(0))
    total = F.sum(F.col("opens") + F.col("opened")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    carried = ranges.select("__key", "__block", (F.coalesce(total, F.lit(0)) + F.col("opens")).alias("__before"))
    return marked.join(carried, ["__key", "__block"]).withColumn(out, (F.col("__before") + F.col("__local")).cast("long")).drop(
        "__key", "__block", "__at", "__opens", "__local", "__before")


def sessions(df: DataFrame, keys: list[str], time: str, tie: str, gap: int, sums: dict[str, Column]) -> DataFrame:
    """One row per session: keys, session_no, started_at, ended_at, n_rows and the ``sums`` (aggregates by name). Sessions are combined
    before they are shuffled, so a long one is no burden."""
    numbered = with_sessions(df, keys, time, tie, gap)
    return numbered.groupBy(*keys, "session_no").agg(
        F.min(time).alias("started_at"), F.max(time).alias("ended_at"), F.count(F.lit(1)).alias("n_rows"), *[c.alias(n) for n, c in sums.items()])
