"""The library from SQL: scalar functions, a table function over model responses, and a view for every registered query.

``register(spark)`` adds the functions to a session, ``views(spark, folder)`` the driver tables and the named queries (``pf_j5`` and so on). Scalar functions are SQL functions, which
Catalyst puts into the plan of the statement that calls them; they say what the column expressions in ``functions`` say.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import names
from .functions import codes
from .functions.text import BLANKS
from .operators.responses import FENCE
from .session import ship

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cases(subject: str, pairs: Iterable[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({subject}), {_text(word)}) THEN {_text(label)}" for word, label in pairs) + f" ELSE {_text(default)} END"


def scalar_functions() -> dict[str, str]:
    """Name with parameters and result type, and the SQL that it returns."""
    code, number = _text(codes.CODE), "coalesce(try_cast(regexp_extract(upper(code), {0}, 2) AS DOUBLE), 0.0D)".format(_text(codes.CODE))
    return {
        "pf_code_alpha(code STRING) RETURNS STRING": f"coalesce(CASE WHEN upper(code) RLIKE {code} THEN regexp_extract(upper(code), {code}, 1) ELSE upper(code) END, '')",
        "pf_code_number(code STRING) RETURNS DOUBLE": number,
        "pf_code_in_range(code STRING, low STRING, high STRING) RETURNS BOOLEAN":
            "CASE WHEN pf_code_alpha(code) = pf_code_alpha(low) THEN pf_code_number(code) BETWEEN pf_code_number(low) AND pf_code_number(high)"
            " ELSE pf_code_alpha(low) <= pf_code_alpha(code) AND pf_code_alpha(code) <= pf_code_alpha(high) END",
        "pf_same_code(a STRING, b STRING) RETURNS BOOLEAN": "lower(replace(coalesce(a, ''), ' ', '')) = lower(replace(coalesce(b, ''), ' ', ''))",
        "pf_short_code(name STRING) RETURNS STRING": "upper(substring(md5(name), 1, 8))",
        "pf_version_label(ts TIMESTAMP) RETURNS STRING": "date_format(ts, '\\'v\\'yyMM')",
        "pf_product_type(name STRING) RETURNS STRING": _cases("name", names.TYPE_KEYWORDS, names.UNCLASSIFIED),
        "pf_base_category(name STRING) RETURNS STRING": _cases("name", [(w, w) for w in names.BASE_CATEGORIES], names.OTHER_CATEGORY),
        "pf_score_label(score DOUBLE) RETURNS STRING": "CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END",
        "pf_period_text(days INT) RETURNS STRING":
            "CASE WHEN days = 0 THEN '' WHEN days >= 30 AND days < 365 AND days % 30 = 0 THEN concat(CAST(days DIV 30 AS STRING), '개월')"
            " WHEN days >= 365 AND days % 365 = 0 THEN concat(CAST(days DIV 365 AS STRING), '년') ELSE concat(CAST(days AS STRING), '일') END",
        "pf_suffix(code STRING, n INT) RETURNS STRING": "right(code, n)",
    }


class _NoJson(ValueError):
    pass


def _object(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise _NoJson
    return dict(pairs)


def _constant(word: str):
    raise _NoJson


class _Number(str):
    """A number as Spark shows it."""


def _double(text: str) -> _Number:
    value = float(text)
    if value == 0 or 1e-3 <= abs(value) < 1e7:
        return _Number(repr(value))
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    shown = "".join(map(str, digits))
    return _Number(f"{'-' * sign}{shown[0]}.{shown[1:] or '0'}E{exponent + len(shown) - 1}")


def _json(text: str):
    """The value of a text that is strict JSON."""
    return json.loads(text, object_pairs_hook=_object, parse_constant=_constant, parse_float=_double, parse_int=_Number)


def _shown(value, inside: bool = False) -> str | None:
    """A value as text; what stands inside a list or an object as JSON."""
    if isinstance(value, _Number) or value is None and not inside or isinstance(value, str) and not inside:
        return value
    if isinstance(value, list):
        return "[" + ",".join(_shown(v, True) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_shown(v, True)}" for k, v in value.items()) + "}"
    return json.dumps(value, ensure_ascii=False)


def recovered(raw: str | None, fields: list[str]) -> Iterator[list[str | None]]:
    """The objects of a response: of its array, or those that parse alone where the array is broken. An item that is no object has no fields."""
    body = re.sub(FENCE, "", raw or "").strip(BLANKS)
    if "[" not in body or "]" not in body:
        return
    piece = re.search(r"(?s)\[.*\]", body)
    found = None
    try:
        found = _json(piece.group()) if piece else None
    except ValueError:
        pass
    if found is None:
        found = []
        for text in re.findall(r"\{[^{}]*\}", body):
            try:
                found.append(_json(text))
            except ValueError:
                continue
    for item in found:
        yield [_shown(item.get(f)) if isinstance(item, dict) else None for f in fields]


@udtf(useArrow=True)
class ResponseItems:
    """Rows of model responses: ``pf_response_items(TABLE(responses) PARTITION BY id ORDER BY part, key => 'id', text => 'raw', fields => 'a,b')``.

    One row per object with the key, its number within the partition and the named fields as text. Objects are numbered on over the responses of a partition; with ``totals => true`` every partition ends with a row that has
    the number of its objects and no fields. A response is worked on by itself: no partition is held."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument, fields: AnalyzeArgument, totals: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is TABLE(...)")
        given = {f.name: f.dataType for f in rows.dataType.fields}
        for argument, name in ((key, "key"), (text, "text"), (fields, "fields")):
            if argument.value is None:
                raise ValueError(f"{name} is a constant")
        if key.value not in given or text.value not in given:
            raise ValueError(f"the table has no column {key.value} or {text.value}")
        schema = StructType().add(key.value, given[key.value]).add("obj_no", IntegerType())
        for field in fields.value.split(","):
            schema = schema.add(field.strip(), StringType())
        return AnalyzeResult(schema=schema)

    def __init__(self):
        self.number, self.last = 0, None

    def eval(self, rows: Row, key: str, text: str, fields: str, totals: bool = False):
        wanted = [f.strip() for f in fields.split(",")]
        if totals:
            self.last = rows[key], len(wanted)
        for values in recovered(rows[text], wanted):
            yield (rows[key], self.number, *values)
            self.number += 1

    def terminate(self):
        if self.last is not None:
            yield (self.last[0], self.number, *[None] * self.last[1])


def register(spark: SparkSession) -> None:
    """Adds the scalar functions and the table function ``pf_response_items`` to the session."""
    ship(spark)
    for head, body in scalar_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("pf_response_items", ResponseItems.asDeterministic())


def views(spark: SparkSession, folder: str, queries: Iterable[str] = ()) -> list[str]:
    """Temporary views of the tables of a folder and of registered queries (``pf_<query>``); returns their names.

    A query's view is the frame that its DataFrame form gives, so filters and columns of a statement reach its scans."""
    from .plans import QUERIES

    out = []
    for name in TABLES:
        spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").createOrReplaceTempView(name)
        out.append(name)
    for name in queries:
        QUERIES[name](spark, folder).createOrReplaceTempView(f"pf_{name}")
        out.append(f"pf_{name}")
    return out


def run(spark: SparkSession, folder: str, statement: str) -> DataFrame:
    """A statement over the tables, the functions, and the views of the registered queries that it names."""
    from .plans import QUERIES

    register(spark)
    named = sorted({m for m in re.findall(r"\bpf_(\w+)", statement) if m in QUERIES})
    views(spark, folder, named)
    return spark.sql(statement)
