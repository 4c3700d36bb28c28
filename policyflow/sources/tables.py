"""Delimited files, header-less grids, key/value sheets, JSON metadata and file listings."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F

from ..functions import text as tx

# Encodings and separators, in the order they are tried.
ENCODINGS = ["UTF-8", "UTF-16", "UTF-16LE", "MS949", "EUC-KR"]
SEPARATORS = ["\t", ","]
REPLACEMENT = "\ufffd"
# The two bytes of a character outside ASCII in either Korean charset, each byte as the character of its number.
PAIRS = {"MS949": r"[\x81-\xfe][\x41-\x5a\x61-\x7a\x81-\xfe]", "EUC-KR": r"[\xa1-\xfe][\xa1-\xfe]"}


def csv_reader(spark: SparkSession, sep: str = ",", encoding: str = "UTF-8", header: bool = True, multi_line: bool = True) -> DataFrameReader:
    """Reader of CSV records: doubled quotes, blanks kept, an unquoted empty cell is null; a quoted cell may hold line breaks.

    With ``multi_line`` a file is one split. UTF-16 needs it; ``needs_whole_files`` tells whether others do.
    """
    reader = spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
    reader = reader.option("multiLine", multi_line or encoding.startswith("UTF-16")).option("quote", '"').option("escape", '"')
    reader = reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return reader.option("emptyValue", "").option("nullValue", "\ufdd0").option("maxCharsPerColumn", -1)


def told(spark: SparkSession, path: str) -> dict[str, bool]:
    """What one pass over the lines of the files tells, in splits: which encodings all of them fit, whether they hold zero bytes, and whether a record may go on
    over a line break (a line with an odd number of quotes, or a carriage return inside)."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("b"))
    line = F.decode("b", "ISO-8859-1")  # a character for each byte
    fits = {e: ~F.regexp_replace(F.col("line"), pair, "").rlike(r"[\x80-\xff]") for e, pair in PAIRS.items()}
    tests = {
        "UTF-8": F.bool_and(F.is_valid_utf8(F.col("b").cast("string"))), **{e: F.bool_and(test) for e, test in fits.items()},
        "zeros": F.bool_or(F.contains(F.col("line"), F.lit("\x00"))),
        "goes_on": F.bool_or(((F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2 == 1) | F.col("line").rlike(r"\r(?!$)")),
    }
    row = raw.withColumn("line", line).agg(*[c.alias(n) for n, c in tests.items()]).first()
    return {n: bool(row[n]) if row[n] is not None else n in ENCODINGS for n in tests}


def needs_whole_files(spark: SparkSession, path: str, encoding: str = "UTF-8") -> bool:
    """Whether the files must be read whole, as a record may go on over a line break; else they are read in splits."""
    return encoding.startswith("UTF-16") or told(spark, path)["goes_on"]


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", header: bool = True, multi_line: bool | None = None
) -> DataFrame:
    """All columns as text, empty cells as ''. Files are read in splits where a pass over their lines finds that no record goes on over a line break; ``multi_line`` says so without it."""
    whole = needs_whole_files(spark, path, encoding) if multi_line is None else multi_line
    return csv_reader(spark, sep, encoding, header, whole).csv(path).na.fill("")


def decodes(spark: SparkSession, path: str, encoding: str, lines: dict[str, bool] | None = None) -> bool:
    """Whether all of the files decode. ``lines``: what ``told`` says of them. UTF-16 lines cannot be told apart before decoding, so their cells are looked at, and only where there are
    zero bytes, as every line break has one.
    """
    lines = lines or told(spark, path)
    if not encoding.startswith("UTF-16"):
        return lines[encoding]
    if not lines["zeros"]:
        return False
    try:
        cells = read_csv(spark, path, "\ufdd0", encoding, header=False, multi_line=True)
        broken = cells.filter(tx.any_of([F.contains(F.col(c), F.lit(REPLACEMENT)) for c in cells.columns]))
        return broken.isEmpty()
    except PySparkException as e:
        if "MALFORMED_CHARACTER_CODING" in str(e):
            return False
        raise


def read_csv_guessing(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """First encoding that decodes all of the files and first separator that gives more than one column and at least one row.

    The Korean charsets need ``spark.sql.legacy.javaCharsets``, as ``session.build_session`` sets it. One pass over the lines tells the encodings, and whether the files can be read in splits.
    """
    if spark.conf.get("spark.sql.legacy.javaCharsets") != "true":
        raise ValueError("set spark.sql.legacy.javaCharsets to true, or use build_session")
    lines = told(spark, path)
    whole = lines["goes_on"] if multi_line is None else multi_line
    for encoding in ENCODINGS:
        if not decodes(spark, path, encoding, lines):
            continue
        for sep in SEPARATORS:
            df = read_csv(spark, path, sep, encoding, multi_line=whole or encoding.startswith("UTF-16"))
            if len(df.columns) > 1 and not df.isEmpty():
                return df
    raise ValueError(f"no encoding and separator fit {path}")


def numbered_file(df: DataFrame, out: str = "row_no") -> DataFrame:
    """Adds a position that grows with file order (not consecutive over several splits)."""
    return df.withColumn(out, F.monotonically_increasing_id())


def headed_lines(lines: DataFrame, file: str, pos: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines of CSV files to (headers, rows): one row per file with ``header``, and the other lines with their ``fields``.

    The first line of a file is its header; a byte order mark and blank lines are dropped.
    """
    filled = lines.filter(F.trim(value) != "")
    heads = filled.groupBy(file).agg(F.min_by(value, pos).alias("__head"), F.min(pos).alias("__first"))
    header = F.transform(tx.csv_fields(F.ltrim(F.replace("__head", F.lit("\ufeff"), F.lit("")))), tx.strip)
    heads = heads.select(file, "__first", header.alias("header"))
    rows = filled.join(heads, file).filter(F.col(pos) > F.col("__first"))
    return heads.drop("__first"), rows.withColumn("fields", tx.csv_fields(F.col(value))).drop("__first", value)


def named_fields(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by name from ``header`` and ``fields``, null when the file has no such column."""
    def pick(name):
        at = F.array_position("header", name).cast("int")
        return F.when(at > 0, F.try_element_at("fields", at)).alias(name)

    keep = [c for c in rows.columns if c not in ("header", "fields")]
    return rows.select(*keep, *[pick(c) for c in columns])


def read_grid(spark: SparkSession, path: str, columns: int, row_no: str = "row_no") -> DataFrame:
    """Header-less sheet: the stored row number and text columns c0..cn."""
    schema = ", ".join([f"{row_no} long", *[f"c{i} string" for i in range(columns)]])
    return spark.read.schema(schema).option("header", False).option("emptyValue", "").csv(path)


def sheet_name(available: list[str], product_code: str | None) -> str | None:
    """'Main_<code>', else the first 'Main_*'."""
    own = f"Main_{product_code}"
    return own if own in available else next((s for s in available if s.startswith("Main_")), None)


def promote_header(
    grid: DataFrame, header_row: int, row_no: str = "row_no", repeated: list[str] = (), fallback_row: int | None = None,
    expect: str | None = None,
) -> DataFrame:
    """Header row to column names (stripped, line breaks removed), rows below it as data.

    The second occurrence of a name in ``repeated`` gets a '2'. With ``expect`` the fallback row is used when the header
    row does not hold that name. One header row is read by the driver.
    """
    cells = [c for c in grid.columns if c != row_no]

    def names_at(no):
        row = grid.filter(F.col(row_no) == no).select(*cells).first()
        return ["" if v is None else str(v).replace("\n", "").replace("\r", "").strip() for v in (row or [])]

    found = names_at(header_row)
    if expect is not None and expect not in found and fallback_row is not None:
        header_row, found = fallback_row, names_at(fallback_row)
    seen: dict[str, int] = {}
    final = []
    for i, name in enumerate(found):
        seen[name] = seen.get(name, 0) + 1
        if name in repeated and seen[name] == 2:
            name = f"{name}2"
        elif name == "" or seen[name] > 1:
            name = f"{name}_{i}"
        final.append(name)
    body = grid.filter(F.col(row_no) > header_row)
    return body.select(row_no, *[F.col(c).alias(n) for c, n in zip(cells, final)])


def resolve(columns: list[str], exact: list[str], parts: list[str] = (), first: bool = False) -> str | None:
    """Column by exact name, then by contained part, then the first one if allowed."""
    for name in exact:
        if name in columns:
            return name
    hit = next((c for c in columns if any(p in c for p in parts)), None)
    return hit or (columns[0] if first and columns else None)


def rename_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Old name -> new name, only when the new name is not there yet."""
    for old, new in aliases.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumn(new, F.col(f"`{old}`"))
    return df


def drop_empty(df: DataFrame, blank_is_null: bool = True) -> DataFrame:
    """Without the rows and the columns that hold nothing. One aggregate row is read by the driver."""
    cell = (lambda c: tx.non_blank(F.col(f"`{c}`").cast("string"))) if blank_is_null else (lambda c: F.col(f"`{c}`"))
    counts = df.agg(*[F.count(cell(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    keep = [c for i, c in enumerate(df.columns) if counts[f"n{i}"] > 0]
    if not keep:
        return df.limit(0)
    return df.filter(F.coalesce(*[cell(c).cast("string") for c in keep]).isNotNull()).select(*[F.col(f"`{c}`") for c in keep])


def key_values(sheet: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """Property rows as (key, value), the last of equal keys winning, blank keys left out."""
    rows = sheet.filter(tx.strip(F.col(key)) != "")
    return rows.groupBy(tx.strip(F.col(key)).alias("key")).agg(F.max_by(F.col(value), F.col(pos)).alias("value"))


def coverage_rows(sheet: DataFrame, row_no: str, first_row: int, ignore: list[str]) -> DataFrame:
    """Rows from ``first_row`` with any value other than null, '' and '0' outside the ignored columns."""
    cells = [F.col(f"`{c}`").cast("string") for c in sheet.columns if c not in (row_no, *ignore)]
    filled = F.exists(F.array(*cells), lambda x: F.coalesce(~tx.strip(x).isin("", "0"), F.lit(False)))
    return sheet.filter((F.col(row_no) >= first_row) & filled)


def grid_cells(grid: DataFrame, row_no: str = "row_no", columns: list[str] | None = None) -> DataFrame:
    """(r, c, cell) of the non-null cells."""
    columns = columns or [c for c in grid.columns if c != row_no]
    cells = grid.select(F.col(row_no).alias("r"), F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in columns])).alias("c", "cell"))
    return cells.filter("cell is not null")


def label_values(cells: DataFrame, wanted: dict[str, tuple[str, int, int]]) -> DataFrame:
    """(name, value) for each name -> (label, rows down, columns right); of several label cells the last counts."""
    offsets = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(label).alias("label"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc"))
        for n, (label, dr, dc) in wanted.items()
    ])
    hits = cells.select("r", "c", F.explode(F.filter(offsets, lambda o: o["label"] == tx.strip(F.col("cell")))).alias("o"))
    at = hits.groupBy(F.col("o.name").alias("name")).agg(
        F.max_by(F.struct((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")), F.struct("r", "c")).alias("at")
    ).select("name", "at.r", "at.c")
    return at.join(cells, ["r", "c"], "left").select("name", F.coalesce(tx.strip(F.col("cell")), F.lit("")).alias("value"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False, content: bool = False) -> DataFrame:
    """(path, name, mtime, length) of the files of a folder, temporary files ('~…') left out."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    files = reader.load(folder)
    name = tx.file_name(F.col("path"))
    columns = ["path", name.alias("name"), F.col("modificationTime").alias("mtime"), "length"]
    if content:
        columns.append(tx.checksum(F.col("content")).alias("sha"))
    return files.select(*columns).filter(~F.startswith(F.col("name"), F.lit("~")))


def relative_path(path: Column, folder: str) -> Column:
    """Path below the folder."""
    root = folder.rstrip("/").split("/")[-1]
    return F.regexp_extract(path, f"/{root}/(.*)$", 1)


META_SCHEMA = "product_code string, product_name string, product_type string, version string, stored_at string"


def read_meta(spark: SparkSession, folder: str, pattern: str = "*.json", multi_line: bool = False) -> DataFrame:
    """All metadata objects below a folder, broken ones skipped, newest first."""
    reader = spark.read.schema(META_SCHEMA).option("mode", "DROPMALFORMED").option("multiLine", multi_line)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(folder).orderBy(F.desc("stored_at"), "product_code")


def reshape_mapping(lines: DataFrame, value: str, pos: str, header_pos: int = 0) -> DataFrame:
    """Tab lines with at least five parts to the six mapping columns; blank lines and the header line are skipped.

    Input order: representative code, representative name, coverage code, coverage name, category.
    """
    p = F.split(tx.strip(F.col(value)), "\t")
    rows = lines.filter((F.col(pos) != header_pos) & (F.size(p) >= 5))
    part = lambda i: tx.strip(p[i])
    return rows.select(
        pos, part(0).alias("rep_code"), part(2).alias("coverage_code"), part(1).alias("rep_name"),
        part(3).alias("coverage_name"), part(4).alias("category"), F.lit("").alias("check"),
    )
