"""Code and key lookups: exact, suffix, several hits, any column, tiers.

A lookup side is reduced to one row per key by an aggregate before the join. No side is forced to be broadcast:
Spark does so by itself below ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges (with skew splitting) above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import names
from ..functions import text as tx
from .ordered import first_row, last_per_key


def _keyed(table: DataFrame, key: Column, values: list[str], pos: str, last: bool = False) -> DataFrame:
    """(``__key``, ``__hit`` struct) with one row per non-empty key."""
    rows = table.select(key.alias("__key"), F.col(pos).alias("__pos"), F.struct(*values).alias("__hit"))
    rows = rows.filter(F.col("__key").isNotNull() & (F.col("__key") != ""))
    pick = F.max_by if last else F.min_by
    return rows.groupBy("__key").agg(pick("__hit", "__pos").alias("__hit"))


def _join_key(df: DataFrame, keyed: DataFrame, key: Column, hit: str) -> DataFrame:
    right = keyed.select(F.col("__key").alias(f"{hit}_key"), F.col("__hit").alias(hit))
    return df.withColumn("__probe", key).join(right, F.col("__probe") == F.col(f"{hit}_key"), "left").drop(
        "__probe", f"{hit}_key"
    )


def exact_lookup(
    df: DataFrame, table: DataFrame, on: str, key: str, values: list[str], pos: str, last: bool = False
) -> DataFrame:
    """First (or last) row per trimmed key, values null on a miss."""
    keyed = _keyed(table, tx.strip(F.col(key)), values, pos, last)
    joined = _join_key(df, keyed, tx.strip(F.col(on)), "__hit")
    return joined.select(*df.columns, *[F.col(f"__hit.{v}").alias(v) for v in values])


def suffix_key(c: Column, n: int = 7) -> Column:
    """Last ``n`` characters, null when the text is shorter."""
    c = tx.strip(c)
    return F.when(F.length(c) >= n, F.right(c, F.lit(n)))


def tiered_lookup(
    df: DataFrame, table: DataFrame, on: str, key: str, values: list[str], pos: str,
    n: int = 7, priority: str = "exact_first", check: str = "check",
) -> DataFrame:
    """Exact key, else last ``n`` characters; ``check`` holds the error word on a miss.

    ``priority='row_order'`` takes whichever of the two hits stands first in the table.
    """
    fields = [*values, pos]
    exact = _keyed(table, tx.strip(F.col(key)), fields, pos)
    suffix = _keyed(table, suffix_key(F.col(key), n), fields, pos)
    joined = _join_key(df, exact, tx.strip(F.col(on)), "__exact")
    joined = _join_key(joined, suffix, suffix_key(F.col(on), n), "__suffix")
    if priority == "row_order":
        earlier = F.col(f"__suffix.{pos}") < F.col(f"__exact.{pos}")
        hit = F.when(earlier, F.col("__suffix")).otherwise(F.coalesce("__exact", "__suffix"))
    else:
        hit = F.coalesce("__exact", "__suffix")
    joined = joined.withColumn("__hit", hit)
    return joined.select(
        *df.columns,
        *[tx.text_or_empty(F.col(f"__hit.{v}")).alias(v) for v in values],
        F.when(F.col("__hit").isNull(), names.LOOKUP_ERROR).otherwise("").alias(check),
    )


def whole_suffix_lookup(
    df: DataFrame, table: DataFrame, on: str, key: str, value: str, pos: str, n: int = 7
) -> DataFrame:
    """The last ``n`` characters of a code must equal the whole stored code; a miss gives the error word."""
    keyed = _keyed(table, tx.strip(F.col(key)), [value], pos)
    joined = _join_key(df, keyed, F.right(tx.strip(F.col(on)), F.lit(n)), "__hit")
    return joined.select(
        *df.columns, F.coalesce(F.col(f"__hit.{value}"), F.lit(names.LOOKUP_ERROR)).alias(value)
    )


def multi_lookup(
    df: DataFrame, table: DataFrame, on: str, key: str, value: str, category: str, pos: str, filled: Column
) -> DataFrame:
    """All distinct values of a code: none is an error, one is the value, more a comma list.

    The category is that of the last matching row; rows for which ``filled`` holds are left out. The distinct values
    are found first, so the list built per code holds each value once.
    """
    todo = df.filter(~filled)
    rows = table.select(
        tx.strip(F.col(key)).alias("__key"), F.col(value).alias("__value"),
        F.col(category).alias("__cat"), F.col(pos).alias("__pos"),
    )
    per_value = rows.groupBy("__key", "__value").agg(
        F.min("__pos").alias("__first"), F.max("__pos").alias("__last"), F.max_by("__cat", "__pos").alias("__cat")
    )
    per_key = per_value.groupBy("__key").agg(
        F.array_sort(F.collect_list(F.struct("__first", "__value"))).alias("__all"),
        F.max_by("__cat", "__last").alias("__cat"),
    )
    joined = todo.withColumn("__probe", tx.strip(F.col(on))).join(per_key, F.col("__probe") == F.col("__key"), "left")
    hits = F.coalesce(F.size("__all"), F.lit(0))
    hits = F.when(F.col("__all").isNull(), 0).otherwise(hits)
    one = F.element_at(F.col("__all"), 1)["__value"]
    return joined.select(
        *df.columns,
        F.when(hits == 0, names.LOOKUP_ERROR).when(hits == 1, one).otherwise("").alias("rep_code"),
        F.when(hits > 0, F.col("__cat")).otherwise("").alias("category"),
        F.when(hits > 1, F.array_join(F.transform("__all", lambda x: x["__value"]), ",")).otherwise("").alias(
            "rep_codes"
        ),
    )


def any_column_match(df: DataFrame, table: DataFrame, on: str, pos: str) -> DataFrame:
    """Code equal to any cell of the table: value of its first column and the name of the column that holds the code."""
    cells = [c for c in table.columns if c != pos]
    pairs = F.array(*[
        F.struct(F.lit(i).alias("column_no"), F.lit(c).alias("column"), F.upper(tx.strip(F.col(c).cast("string"))).alias("cell"))
        for i, c in enumerate(cells)
    ])
    long = table.select(F.col(pos).alias("table_pos"), F.col(cells[0]).cast("string").alias("code"), F.explode(pairs).alias("p"))
    long = long.select("table_pos", "code", "p.*")
    probe = df.withColumn("__probe", F.upper(tx.strip(F.col(on))))
    hit = probe.join(long, F.col("__probe") == F.col("cell"))
    return hit.select(*df.columns, "code", F.lit("exact").alias("match_type"), "column", "column_no", "table_pos")


def code_exists(df: DataFrame, table: DataFrame, on: str, code_columns: list[str], out: str = "valid") -> DataFrame:
    """True when the trimmed code stands in any of the code columns."""
    known = table.select(F.explode(F.array(*[tx.strip(F.col(c).cast("string")) for c in code_columns])).alias("__known"))
    known = known.filter(F.col("__known").isNotNull()).distinct()
    joined = df.withColumn("__probe", tx.strip(F.col(on))).join(known, F.col("__probe") == F.col("__known"), "left")
    return joined.select(*df.columns, F.col("__known").isNotNull().alias(out))


def composite_lookup(
    df: DataFrame, table: DataFrame, on: list[str], values: list[str], pos: str
) -> DataFrame:
    """Exact match on several columns; the last duplicate wins, a miss gives ''."""
    keyed = last_per_key(table.select(*on, pos, *values), on, pos).drop(pos)
    joined = df.join(keyed, on, "left")
    return joined.select(*df.columns, *[tx.text_or_empty(F.col(v)).alias(v) for v in values])


def describe_code(df: DataFrame, table: DataFrame, on: str, key: str, value: str, pos: str) -> DataFrame:
    """Code to description, last duplicate wins, '' on a miss."""
    out = exact_lookup(df, table, on, key, [value], pos, last=True)
    return out.withColumn(value, tx.text_or_empty(F.col(value)))


def join_first(df: DataFrame, table: DataFrame, on: str, pos: str) -> DataFrame:
    """Left join with the first row per key of the right side; only keys and positions are aggregated, the rows are not."""
    return df.join(first_row(table, [on], pos).drop(pos), on, "left")


def category_positions(df: DataFrame, table: DataFrame, code: str, category: str, pos: str, out: str) -> DataFrame:
    """``out``: position of the row of (code, category), the last one; else of the first category seen for the code."""
    per = table.groupBy(code, category).agg(F.max(pos).alias("__exact"), F.min(pos).alias("__seen"))
    fallback = per.groupBy(code).agg(F.min_by("__exact", "__seen").alias("__any"))
    joined = df.join(per.drop("__seen"), [code, category], "left").join(fallback, code, "left")
    return joined.select(*df.columns, F.coalesce("__exact", "__any").alias(out))


def category_lookup(
    df: DataFrame, table: DataFrame, code: str, category: str, values: list[str], pos: str
) -> DataFrame:
    """Row of (code, category), the last comment winning; else that of the first category seen for the code.

    Positions are chosen first; the values are joined to them."""
    placed = category_positions(df, table, code, category, pos, "__at")
    rows = table.select(F.col(code).alias("__code"), F.col(pos).alias("__pos"), *[F.col(v).alias(f"__{v}") for v in values])
    joined = placed.join(rows, (F.col(code) == F.col("__code")) & (F.col("__at") == F.col("__pos")), "left")
    return joined.select(*df.columns, *[F.col(f"__{v}").alias(v) for v in values])


def document_for_category(df: DataFrame, documents: DataFrame, category: str, path: str, pos: str) -> DataFrame:
    """Base document of the category, else the first document of all."""
    own = last_per_key(documents.select(category, path, pos), [category], pos).select(category, F.col(path).alias("__own"))
    first = documents.agg(F.min_by(path, pos))
    joined = df.join(own, category, "left")
    return joined.select(*df.columns, F.coalesce(F.col("__own"), first.scalar()).alias(path))


def layout_flags(
    df: DataFrame, layout: DataFrame, code: str, kind: str, key: str, reduction: str, exemption: str, pos: str
) -> DataFrame:
    """Rider layout row of ``code_kind``: an X means without reduction / without exemption."""
    probe = df.withColumn("__layout", F.concat_ws("_", F.col(code), F.col(kind)))
    out = exact_lookup(probe, layout, "__layout", key, [reduction, exemption], pos)
    mark = lambda c, word: F.when(F.col(c).isNotNull(), F.when(F.contains(F.col(c), F.lit("X")), word + "없음").otherwise(word + "있음"))
    return out.select(
        *df.columns, mark(reduction, "감액").alias("reduction_kind"), mark(exemption, "면책").alias("exemption_kind")
    )


def appendix_lookup(
    df: DataFrame, sections: DataFrame, name: str, zero_age: str, section: str, value: str, pos: str,
    suffix: str = "[자녀]",
) -> DataFrame:
    """Section of the exact name, or of the name plus the child suffix when the zero-age flag is set; first wins."""
    keyed = _keyed(sections, tx.strip(F.col(section)), [value, pos], pos)
    joined = _join_key(df, keyed, tx.strip(F.col(name)), "__plain")
    child = F.when(F.col(zero_age) > 0, F.concat(tx.strip(F.col(name)), F.lit(suffix)))
    joined = _join_key(joined, keyed, child, "__child")
    earlier = F.col(f"__child.{pos}") < F.col(f"__plain.{pos}")
    use = F.when(earlier, F.col("__child")).otherwise(F.coalesce("__plain", "__child"))
    joined = joined.withColumn("__use", use)
    return joined.select(*df.columns, F.col(f"__use.{value}").alias(value), F.col("__use").isNotNull().alias("found"))


def sub_names(df: DataFrame, table: DataFrame, keys: list[str], order: str, code: str, key: str, name: str, pos: str) -> DataFrame:
    """Name of every sub-coverage code, the code itself when the name is missing or blank; one row per code."""
    out = exact_lookup(df, table, code, key, [name], pos)
    label = F.coalesce(tx.non_blank(tx.strip(F.col(name))), F.col(code))
    return out.select(*df.columns, label.alias(name)).select(*keys, order, code, name)


def queue_with_results(queue: DataFrame, results: DataFrame, columns: list[str], status: str = "pending") -> DataFrame:
    """Queue rows of one status with the columns of their result."""
    right = results.select(F.col("id").alias("result_id"), *columns)
    return queue.filter(F.col("status") == status).join(right, "result_id", "left")
