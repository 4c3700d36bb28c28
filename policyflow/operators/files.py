"""File lists: grouping, most recent file, inventories. Input frames hold a path or name and a modification time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import names
from ..functions import text as tx


def by_stem(files: DataFrame, path: str) -> DataFrame:
    """Files with ``group_key`` = their stem."""
    return files.withColumn("group_key", tx.stem(F.col(path)))


def by_folder(files: DataFrame, path: str) -> DataFrame:
    """Files with ``group_key`` = their folder; their stem when all files (more than one) share one folder."""
    folder = tx.folder_name(F.col(path))
    shape = files.agg(F.min(folder).eqNullSafe(F.max(folder)) & (F.count("*") > 1))
    return files.withColumn("group_key", F.when(shape.scalar(), tx.stem(F.col(path))).otherwise(folder))


def group_sizes(grouped: DataFrame, path: str) -> DataFrame:
    return grouped.groupBy("group_key").agg(
        F.count("*").alias("n_files"), F.min(path).alias("first_file"), F.max(path).alias("last_file")
    )


def reference_pairs(files: DataFrame, path: str, pos: str) -> DataFrame:
    """Per stem the first document and the first data file; groups with less than two files or without a side are dropped."""
    ext = tx.extension(F.col(path))
    doc, data = ext.isin(".docx", ".doc"), ext.isin(".csv", ".xlsx")
    per = by_stem(files, path).groupBy("group_key").agg(
        F.count("*").alias("n"),
        F.min_by(path, F.when(doc, F.col(pos))).alias("document"),
        F.min_by(path, F.when(data, F.col(pos))).alias("data"),
    )
    return per.filter("n >= 2 and document is not null and data is not null").select("group_key", "document", "data")


def most_recent(files: DataFrame, terms: list[str], name: str, mtime: str, pos: str) -> DataFrame:
    """Newest file per search term, without regard to case; '-' when no file has the term.

    상해 and 질병 skip names with 상해질병. On equal times the first listed file wins.
    """
    own = lambda t: F.contains(F.lower(F.col(name)), F.lit(t.lower())) & (
        ~F.contains(F.col(name), F.lit("상해질병")) if t in ("상해", "질병") else F.lit(True)
    )
    hits = F.array_compact(F.array(*[F.when(own(t), F.lit(t)) for t in terms]))
    labelled = files.select(F.explode(hits).alias("term"), name, mtime, pos)
    # max_by orders structs; -pos prefers the earlier of two equal times
    best = labelled.groupBy("term").agg(
        F.max_by(F.struct(name, mtime), F.struct(F.col(mtime), (-F.col(pos)).alias("p"))).alias("b")
    )
    wanted = files.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    joined = wanted.join(best, "term", "left")
    return joined.select("term", F.coalesce(F.col(f"b.{name}"), F.lit("-")).alias(name), F.col(f"b.{mtime}").alias(mtime))


def rider_files(files: DataFrame, name: str, mtime: str, pos: str) -> DataFrame:
    """Newest normal and simplified file per leading group number, '' when there is none."""
    kind = F.when(F.contains(F.col(name), F.lit("_간편_")), "간편").otherwise("일반")
    rows = files.select(tx.group_number(F.col(name)).alias("group_no"), kind.alias("kind"), name, mtime, pos)
    order = F.struct(F.col(mtime), (-F.col(pos)).alias("p"))
    best = rows.groupBy("group_no").pivot("kind", ["일반", "간편"]).agg(F.max_by(F.col(name), order))
    return best.select(
        "group_no", F.coalesce("일반", F.lit("")).alias("normal_file"), F.coalesce("간편", F.lit("")).alias("simple_file")
    )


def last_of_type(files: DataFrame, path: str, kind: Column, pos: str) -> DataFrame:
    """Type -> file, a later file of a type replaces the earlier one."""
    return files.groupBy(kind.alias("kind")).agg(F.max_by(path, pos).alias(path))


def inventory(files: DataFrame, path: str, mtime: str) -> DataFrame:
    """Product rows of a folder tree of documents; ``path`` is relative to the tree."""
    p = F.col(path)
    name = tx.stem(p)
    return files.select(
        path,
        F.when(F.contains(p, F.lit("/")), F.split_part(p, F.lit("/"), F.lit(1))).otherwise(names.UNCLASSIFIED).alias("product_type"),
        name.alias("product_name"), tx.short_code(name).alias("product_code"), tx.version_label(F.col(mtime)).alias("version"),
    )


def new_documents(files: DataFrame, known: DataFrame, path: str, sha: str, mtime: str) -> DataFrame:
    """Files whose content hash is not known yet."""
    fresh = files.join(known.select(sha).distinct(), sha, "left_anti")
    name = tx.stem(F.col(path))
    return fresh.select(
        path, sha, tx.short_code(name).alias("product_code"), name.alias("product_name"),
        tx.product_type(tx.file_name(F.col(path))).alias("product_type"), tx.version_label(F.col(mtime)).alias("version"),
    )
