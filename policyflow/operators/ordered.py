"""First, last, numbering, running and neighbour values per key, safe for a key that holds much of the table.

First and last use aggregates with map-side combine. The others cut every key into blocks of consecutive
positions: a window runs inside a block, a one-row summary per block is carried over the blocks, and both are
joined again. No task ever holds more than a block, or the summaries of one key. Positions are whole numbers
that grow with file order (a stored row number, a line or turn number, an id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 1 << 20
_KEY, _BLOCK = "__key", "__block"


def _rest(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def first_per_key(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The whole row with the smallest position of each key."""
    rest = _rest(df, keys)
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(pos)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The whole row with the largest position of each key."""
    rest = _rest(df, keys)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def first_row(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """As ``first_per_key`` for wide rows: only keys and positions are aggregated, and the rows are kept by a semi join.

    The frame is read twice, the first time for its keys and positions. Positions are unique within a key.
    """
    least = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(pos).alias("__at"))
    same = F.col("__at") == F.col(pos)
    for i, k in enumerate(keys):
        same = same & F.col(f"__k{i}").eqNullSafe(F.col(k))
    return df.join(least, same, "left_semi")


def last_row(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """As ``first_row``, for the largest position."""
    most = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max(pos).alias("__at"))
    same = F.col("__at") == F.col(pos)
    for i, k in enumerate(keys):
        same = same & F.col(f"__k{i}").eqNullSafe(F.col(k))
    return df.join(most, same, "left_semi")


def _blocked(df: DataFrame, keys: list[str], pos: str, width: int) -> DataFrame:
    """Adds the key as one struct (null keys compare equal there) and the first position of the row's block."""
    key = F.struct(*keys) if keys else F.lit(0)
    return df.withColumns({_KEY: key, _BLOCK: F.col(pos) - F.pmod(F.col(pos), F.lit(width))})


def _inside(pos: str):
    return Window.partitionBy(_KEY, _BLOCK).orderBy(pos)


def _carry(blocked: DataFrame, summary: Column, carry) -> DataFrame:
    """One row per key and block with ``carry(window over the blocks of a key)`` of the block summaries."""
    blocks = blocked.groupBy(_KEY, _BLOCK).agg(summary.alias("__sum"))
    return blocks.select(_KEY, _BLOCK, carry(Window.partitionBy(_KEY).orderBy(_BLOCK)).alias("__carry"))


def _attach(local: DataFrame, carried: DataFrame) -> DataFrame:
    """Join the carried value back; the rows stay where the window inside the blocks put them."""
    return local.join(carried, [_KEY, _BLOCK], "left")


def number_in_order(df: DataFrame, keys: list[str], pos: str, out: str, width: int = BLOCK, total: str | None = None) -> DataFrame:
    """Row number from 1 within the key, by position; ``total`` adds the number of rows of the key."""
    blocked = _blocked(df, keys, pos, width)
    own = Window.partitionBy(_KEY)
    carried = _carry(
        blocked, F.count("*"),
        lambda w: F.struct(
            F.coalesce(F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.sum("__sum").over(own).alias("total"),
        ),
    )
    local = blocked.withColumn("__local", F.row_number().over(_inside(pos)))
    joined = _attach(local, carried).withColumn(out, F.col("__local") + F.col("__carry.before"))
    if total:
        joined = joined.withColumn(total, F.col("__carry.total"))
    return joined.drop("__local", "__carry", _KEY, _BLOCK)


def running_before(
    df: DataFrame, keys: list[str], pos: str, value: Column, out: str, width: int = BLOCK
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the key, 0 for the first."""
    blocked = _blocked(df.withColumn("__value", value), keys, pos, width)
    carried = _carry(
        blocked, F.coalesce(F.sum("__value"), F.lit(0)),
        lambda w: F.coalesce(F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    before = _inside(pos).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumn("__local", F.coalesce(F.sum("__value").over(before), F.lit(0)))
    joined = _attach(local, carried)
    return joined.withColumn(out, F.col("__local") + F.col("__carry")).drop("__value", "__local", "__carry", _KEY, _BLOCK)


def last_filled(
    df: DataFrame, keys: list[str], pos: str, value: Column, out: str, width: int = BLOCK
) -> DataFrame:
    """Last non-null ``value`` at or before the row (forward fill)."""
    blocked = _blocked(df.withColumn("__value", value), keys, pos, width)
    newest = F.max_by(F.col("__value"), F.when(F.col("__value").isNotNull(), F.col(pos)))
    carried = _carry(
        blocked, newest,
        lambda w: F.last("__sum", True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
    )
    upto = _inside(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumn("__local", F.last("__value", True).over(upto))
    joined = _attach(local, carried)
    return joined.withColumn(out, F.coalesce("__local", "__carry")).drop("__value", "__local", "__carry", _KEY, _BLOCK)


def next_filled(
    df: DataFrame, keys: list[str], pos: str, value: Column, out: str, width: int = BLOCK
) -> DataFrame:
    """First non-null ``value`` after the row; with a never-null value this is the next row's."""
    blocked = _blocked(df.withColumn("__value", value), keys, pos, width)
    oldest = F.min_by(F.col("__value"), F.when(F.col("__value").isNotNull(), F.col(pos)))
    carried = _carry(
        blocked, oldest,
        lambda w: F.first("__sum", True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    )
    after = _inside(pos).rowsBetween(1, Window.unboundedFollowing)
    local = blocked.withColumn("__local", F.first("__value", True).over(after))
    joined = _attach(local, carried)
    return joined.withColumn(out, F.coalesce("__local", "__carry")).drop("__value", "__local", "__carry", _KEY, _BLOCK)


def number_sorted(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Row number from 1 within the key, by any sortable columns that make the order total.

    Rows are range-partitioned on (keys, order), so a large key spreads over many partitions. The partition number is
    fixed by writing it; counts per key and partition, which read these two columns only, give each partition its offset.
    """
    from ..session import cut

    key = F.struct(*keys) if keys else F.lit(0)
    ranged = cut(df.repartitionByRange(*keys, *order).withColumns({_KEY: key, _BLOCK: F.spark_partition_id()}))
    carried = _carry(
        ranged, F.count("*"),
        lambda w: F.coalesce(F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    local = ranged.withColumn("__local", F.row_number().over(Window.partitionBy(_KEY, _BLOCK).orderBy(*order)))
    joined = _attach(local, carried)
    return joined.withColumn(out, F.col("__local") + F.col("__carry")).drop("__local", "__carry", _KEY, _BLOCK)


def in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows range-partitioned on (keys, order) and written, with the key as one struct and the number of the range, which rises with the order.

    A key that holds much of the table spreads over many ranges; a window over (key, range) sees one of them."""
    from ..session import cut

    key = F.struct(*keys) if keys else F.lit(0)
    return cut(df.repartitionByRange(*keys, *order).withColumns({_KEY: key, _BLOCK: F.spark_partition_id()}))


def last_filled_sorted(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """As ``last_filled``, in the order of any sortable columns that make it total; nulls come first."""
    ranged = in_ranges(df.withColumn("__value", value), keys, order)
    carried = _carry(
        ranged, F.max_by(F.col("__value"), F.when(F.col("__value").isNotNull(), F.struct(*order))),
        lambda w: F.last("__sum", True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
    )
    upto = Window.partitionBy(_KEY, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _attach(ranged.withColumn("__local", F.last("__value", True).over(upto)), carried)
    return joined.withColumn(out, F.coalesce("__local", "__carry")).drop("__value", "__local", "__carry", _KEY, _BLOCK)


def batches(df: DataFrame, pos: str, size: int, keys: list[str] | None = None, width: int = BLOCK) -> DataFrame:
    """Number rows and put ``size`` of them in a batch: adds ``row_no``, ``batch_no`` and ``batch_total``."""
    numbered = number_in_order(df, keys or [], pos, "row_no", width, "batch_total")
    return numbered.withColumns({
        "batch_no": F.floor((F.col("row_no") - 1) / F.lit(size)) + 1, "batch_total": F.ceil(F.col("batch_total") / F.lit(size)),
    })
