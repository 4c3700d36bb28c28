"""What plans must keep: how often a table is read, what is sorted, and work that follows the matches."""

import os
import random
import re

import pytest

from policyflow.operators import assembly, containment
from policyflow.plans import QUERIES

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
here = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def table_scans(spark, df):
    """Names of the given tables that a frame's plan reads, once per scan; tables that the query itself has written are left out."""
    columns = {tuple(spark.read.parquet(f"{SF}/{n}").columns): n for n in os.listdir(SF)}
    read = [tuple(re.sub(r"#\d+L?", "", r).split(",")) for r in re.findall(r"Relation \[([^\]]*)\]", plan(df))]
    return [columns[r] for r in read if r in columns]


@here
@pytest.mark.parametrize("name,most", [("w2", 2), ("w8", 2), ("q1", 2), ("q1_all", 1), ("q1_rows", 3), ("q3", 3), ("w3", 2), ("w6", 2), ("w7", 2), ("w4", 6)])
def test_scans(spark, name, most):
    assert 0 < len(table_scans(spark, QUERIES[name](spark, SF))) + (name == "w2") <= most


@here
@pytest.mark.parametrize("name", ["a2", "j14"])
def test_structure_reads_tables_twice_at_most(spark, name):
    names = table_scans(spark, QUERIES[name](spark, SF))
    assert all(names.count(n) <= 2 for n in names), names


@here
@pytest.mark.parametrize("name", ["w3", "w6", "w7"])
def test_second_scan_is_narrow(spark, name):
    schemas = sorted(len(s.split(",")) for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, SF), "executedPlan")))
    assert schemas and schemas[0] <= 4


@here
@pytest.mark.parametrize("name,wide", [("g11", "body"), ("g12", "body"), ("w5", "user_id"), ("w1", "props")])
def test_wide_rows_are_not_sorted_by_aggregates(spark, name, wide):
    text = plan(QUERIES[name](spark, SF), "executedPlan")
    assert not [line for line in text.split("\n") if "SortAggregate" in line and wide in line]


def test_matching_follows_the_answers(spark):
    """Answers that all stand in all items: the rows formed are at most items times answers, and the first answer wins."""
    items = spark.createDataFrame([(f"benefit {'x' * (i % 40)} {i}", f"template {i}") for i in range(500)], "benefit_name string, template_name string")

    def rows(n):
        answers = spark.createDataFrame([("benefit", "template"[: 2 + k % 6] if k else "nothing", f"c{k}", k) for k in range(n)], "benefit_name string, template_name string, inferred_code string, pos long")
        return containment.match_responses(items, answers, "benefit_name", "template_name", ["inferred_code"], "pos")

    for n in (10, 400):
        got = rows(n).select("inferred_code", "matched").distinct().collect()
        # the pair that stands first matches, and its last answer gives the value
        assert [tuple(r) for r in got] == [(f"c{max(k for k in range(1, n) if k % 6 == 1)}", True)]


def test_section_ends_without_a_loop(spark):
    """Many markers that hold the comment's own text, and blank comments: the number of jobs does not follow the data."""
    draw = random.Random(2)
    tracker = spark.sparkContext.statusTracker()

    def run(markers):
        texts = [f"별표 {'가' * k}" for k in range(markers)] + ["", "가", "별표", "x"]
        data = [(d, p, p * 10, draw.choice(texts)) for d in range(3) for p in range(150)]
        df = spark.createDataFrame(data, "doc long, pos long, start long, text string")
        spark.sparkContext.setJobGroup(f"ends{markers}", "section ends")
        out = {(r["doc"], r["pos"]): r["section_end"] for r in assembly.section_ends(df, "doc", "pos", "start", "text", width=32).collect()}
        jobs = len(tracker.getJobIdsForGroup(f"ends{markers}"))
        spark.sparkContext.setJobGroup("", "")
        for d, p, _, t in data:
            later = [s for e, q, s, u in sorted(data) if e == d and q > p and "별표" in u and t not in u]
            assert out[d, p] == (later[0] if later else None), (d, p, t)
        return jobs

    assert abs(run(2) - run(40)) <= 3


@here
def test_rendering_of_repeated_clauses(spark):
    """Two clauses of one id and text render alike; there is one rendering path."""
    from policyflow.operators.assembly import phrase_index, phrase_table, render_clauses
    from policyflow.plans.tagging import phrase_rows, tagged
    from pyspark.sql import functions as F

    rows = tagged(spark, SF, F.concat(F.lit("{단체1}"), "p_name"))
    index = phrase_index(phrase_table(phrase_rows(spark, SF), "pos"))
    twice = rows.unionAll(rows)
    assert render_clauses(twice, index, "text", "ctx").count() == 2 * rows.count()
