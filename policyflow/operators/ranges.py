"""Code range join: every table row whose FROM..TO holds the code.

The join runs on the distinct codes and is an equi join. Numbers are put on a grid (10, 1,000 or 1,000,000 wide; the
whole letter for wider ranges), a range is entered in the few cells it meets, a code once per grid. Ranges over several
letters are entered under each first letter they meet. The exact test follows as residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import codes, text as tx

_CELLS = [10.0, 1000.0, 1000000.0]
_FIT = 8
#: Tasks per core that codes are dealt to. Few codes can stand for very many rows, so their bytes say nothing about the work.
_TASKS = 8


def find_range_columns(columns: list[str]) -> dict[str, str] | None:
    """FROM, TO and code column by name parts; None when one of them is missing."""
    tests = {
        "from": lambda c: "FROM" in c.upper() or "시작" in c,
        "to": lambda c: "TO" in c.upper() or "종료" in c,
        "code": lambda c: "코드" in c or "CODE" in c.upper() or "분류번호" in c,
    }
    found = {k: next((c for c in columns if test(c)), None) for k, test in tests.items()}
    return found if all(found.values()) else None


def find_code_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if "코드" in c or "CODE" in c.upper() or "분류번호" in c]


def _letter(text: Column) -> Column:
    """0 below A, 1..26 for A..Z, 27 above: grows with the text."""
    at = F.ascii(F.substring(text, 1, 1))
    return F.coalesce(F.greatest(F.lit(0), F.least(at - 64, F.lit(27))), F.lit(0))


def _level(low: Column, high: Column) -> Column:
    chain = F
    for i, cell in enumerate(_CELLS):
        chain = chain.when(high - low <= cell * _FIT, F.lit(i))
    return chain.otherwise(F.lit(len(_CELLS)))


def _cell(value: Column, level: Column) -> Column:
    chain = F
    for i, cell in enumerate(_CELLS):
        chain = chain.when(level == i, F.floor(value / cell))
    return F.coalesce(chain.otherwise(F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def _spread(df: DataFrame) -> DataFrame:
    """The rows dealt out by ``probe`` to a number of tasks that Spark does not lower when the rows are few bytes."""
    return df.repartition(_TASKS * df.sparkSession.sparkContext.defaultParallelism, "probe")


def _rules(table: DataFrame, low: str, high: str, code: str, whole: bool) -> DataFrame:
    f = F.upper(tx.strip(F.col(low).cast("string")))
    t = F.coalesce(tx.non_blank(F.upper(tx.strip(F.col(high).cast("string")))), f)
    value = tx.strip(F.col(code).cast("string"))
    rules = table.select(f.alias("from"), t.alias("to"), value.alias("code"))
    rules = rules.filter((F.col("from") != "") & (F.col("code") != ""))
    return rules.select(
        "from", "to", "code",
        codes.alpha(F.col("from")).alias("fa"), codes.number(F.col("from"), whole).alias("fx"),
        codes.alpha(F.col("to")).alias("ta"), codes.number(F.col("to"), whole).alias("tx"),
    )


def matches(
    wanted: DataFrame, table: DataFrame, low: str, high: str, code: str, mode: str = "reference", whole: bool = False
) -> DataFrame:
    """(``probe``, ``code``, ``from``, ``to``) for every distinct value of the single column of ``wanted``, as written.

    Values are made distinct before they are trimmed and parsed, so that work is done once per code, not per row.
    """
    if mode not in ("reference", "ordered"):
        raise ValueError(f"unknown mode {mode!r}")
    points = _spread(wanted.toDF("probe").distinct())
    parsed = F.upper(tx.strip(F.col("probe")))
    points = points.select("probe", codes.alpha(parsed).alias("a"), codes.number(parsed, whole).alias("x"))
    rules = _rules(table, low, high, code, whole)
    out = ["probe", "code", "from", "to"]

    # 1. letters of FROM: a numeric interval
    top = F.col("tx")
    if mode == "ordered":
        top = F.when(F.col("ta") > F.col("fa"), F.lit(float("inf"))).when(F.col("ta") < F.col("fa"), F.lit(-1.0)).otherwise(top)
    pieces = rules.select("code", "from", "to", F.col("fa").alias("ra"), F.col("fx").alias("lo"), top.alias("hi"))
    if mode == "ordered":
        # 2. letters of TO when they differ: up to its number
        tail = rules.filter("ta > fa").select(
            "code", "from", "to", F.col("ta").alias("ra"), F.lit(0.0).alias("lo"), F.col("tx").alias("hi")
        )
        pieces = pieces.unionByName(tail)
    pieces = pieces.filter("lo <= hi").withColumn("level", _level(F.col("lo"), F.col("hi")))
    first, last = _cell(F.col("lo"), F.col("level")), _cell(F.col("hi"), F.col("level"))
    pieces = pieces.withColumn("cell", F.explode(F.sequence(first, last)))
    gridded = points.withColumn("plevel", F.explode(F.sequence(F.lit(0), F.lit(len(_CELLS)))))
    gridded = gridded.withColumn("pcell", _cell(F.col("x"), F.col("plevel")))
    same = gridded.join(
        pieces,
        (F.col("a") == F.col("ra")) & (F.col("plevel") == F.col("level")) & (F.col("pcell") == F.col("cell"))
        & F.col("x").between(F.col("lo"), F.col("hi")),
    ).select(*out)

    # 3. letters after those of FROM
    wide = rules.filter("ta > fa").withColumn("letter", F.explode(F.sequence(_letter(F.col("fa")), _letter(F.col("ta")))))
    below = F.col("a") <= F.col("ta") if mode == "reference" else F.col("a") < F.col("ta")
    other = points.withColumn("pletter", _letter(F.col("a"))).join(
        wide, (F.col("pletter") == F.col("letter")) & (F.col("a") > F.col("fa")) & below
    ).select(*out)
    return same.unionByName(other)


def map_codes(
    df: DataFrame, on: str, table: DataFrame, low: str, high: str, code: str,
    mode: str = "reference", whole: bool = False, how: str = "inner",
) -> DataFrame:
    """Input rows with each matching ``code``, ``from``, ``to`` and ``match_type``."""
    # each match becomes a row for every input row with its code
    found = _spread(matches(df.select(on), table, low, high, code, mode, whole))
    joined = df.join(found, F.col(on) == F.col("probe"), how).drop("probe")
    return joined.withColumn("match_type", F.when(F.col("code").isNotNull(), F.lit("range")))


def map_to_table(df: DataFrame, on: str, table: DataFrame, pos: str, mode: str = "reference") -> DataFrame:
    """Range join when the table has FROM, TO and code columns by name, else equality with any cell."""
    from .lookups import any_column_match

    found = find_range_columns([c for c in table.columns if c != pos])
    if found is None:
        return any_column_match(df, table, on, pos)
    return map_codes(df, on, table, found["from"], found["to"], found["code"], mode)
