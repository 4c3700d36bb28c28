"""Diff and merge of a hand-off into the master table, and other set work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import names
from ..functions import text as tx


def classify(
    existing: DataFrame, incoming: DataFrame, keys: list[str] = names.KEY_FIELDS, fields: list[str] = names.COMPARE_FIELDS,
) -> DataFrame:
    """Incoming rows with ``change_type`` (insert, update, skip) and ``changes``, the fields that differ after trim."""
    trimmed = lambda: F.struct(*[tx.text_or_empty(tx.strip(F.col(f))).alias(f) for f in fields])
    old = existing.select(*keys, trimmed().alias("__old"))
    joined = incoming.withColumn("__new", trimmed()).join(old, keys, "left")
    differs = reduce(lambda a, b: a | b, [F.col(f"__old.{f}") != F.col(f"__new.{f}") for f in fields])
    kind = F.when(F.col("__old").isNull(), "insert").when(differs, "update").otherwise("skip")
    joined = joined.withColumn("change_type", kind)
    # the list is built for changed rows only
    diffs = F.filter(
        F.array(*[
            F.struct(F.lit(f).alias("field"), F.col(f"__old.{f}").alias("old"), F.col(f"__new.{f}").alias("new")) for f in fields
        ]),
        lambda x: x["old"] != x["new"],
    )
    none = F.array().cast("array<struct<field:string,old:string,new:string>>")
    changes = F.when(F.col("change_type") == "update", diffs).otherwise(none)
    return joined.select(*incoming.columns, "change_type", changes.alias("changes"))


def merged(existing: DataFrame, incoming: DataFrame, keys: list[str] = names.KEY_FIELDS) -> DataFrame:
    """Master table after the merge: incoming rows, and existing rows no incoming key touches."""
    kept = existing.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*incoming.columns).unionByName(incoming)


def diff_join(existing: DataFrame, incoming: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Full outer view of one field: old and new value of every key on either side."""
    old = existing.select(*keys, F.col(field).alias("old_value"))
    new = incoming.select(*keys, F.col(field).alias("new_value"))
    return old.join(new, keys, "full_outer")


def sync_counts(classified: DataFrame) -> DataFrame:
    """Inserted, updated and skipped rows in one row."""
    kind = F.col("change_type")
    return classified.agg(
        F.count_if(kind == "insert").alias("inserted"), F.count_if(kind == "update").alias("updated"),
        F.count_if(kind == "skip").alias("skipped"), F.count_if(kind.isNull()).alias("errors"),
    )


def unseen(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the known set."""
    return df.join(known.select(key).distinct(), key, "left_anti")


def append_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
