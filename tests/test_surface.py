"""SQL functions, the table function, views of queries, and states that merge."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from policyflow import sql
from policyflow.functions import codes, numbers, text as tx
from policyflow.operators import responses, sketches

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_scalar_functions_say_what_the_expressions_say(spark):
    sql.register(spark)
    given = ["C34", "c34.1", "D05", "", None, "abc", "34", "치아보험 무배당", "it's a \\ test", "실손 의료비", " C 34 ", "상해 질병"]
    df = spark.createDataFrame([(a, b, n, s, dt.datetime(2024, 3, n % 28 + 1)) for n, (a, b) in enumerate(zip(given, given[::-1]))
                                for s in (None, 0.59, 0.6, 0.85)], "a string, b string, n int, s double, t timestamp").withColumn("days", F.col("n") * F.lit(73).cast("int"))
    a, b = F.col("a"), F.col("b")
    pairs = {
        "pf_code_alpha(a)": codes.alpha(F.upper(a)), "pf_code_number(a)": codes.number(F.upper(a)), "pf_code_in_range(a, 'C00', 'D04')": codes.in_range(a, F.lit("C00"), F.lit("D04")),
        "pf_same_code(a, b)": codes.same_code(a, b), "pf_short_code(a)": tx.short_code(a), "pf_version_label(t)": tx.version_label(F.col("t")), "pf_product_type(a)": tx.product_type(a),
        "pf_base_category(a)": tx.base_category(a), "pf_score_label(s)": numbers.score_label(F.col("s")), "pf_period_text(days)": numbers.period_text(F.col("days")),
    }
    for call, column in pairs.items():
        both = df.select(F.expr(call).alias("sql"), column.alias("own"))
        assert both.filter(~F.col("sql").eqNullSafe(F.col("own"))).collect() == [], call
    assert [r[0] for r in spark.sql("SELECT pf_suffix('ABCDEFGHIJ', 7)").collect()] == ["DEFGHIJ"]


TEXTS = [
    '[{"a": "x", "b": 1.50}]', '```json\n[{"a": "x"}, {"b": true}]\n```', 'so: [{"a": "x"}, {"a": broken}, {"b": "y"},]', "no array", "", None, "[]", '[null, {"a": null}]', '[{"a": 1e5, "b": -1.0E-7}, {"a": 12345678.9, "b": 100000000000000000000}]', '[{"a": [1.0, 2.50, null, "t"], "b": {"c": 0.10, "d": false}}]',
    '[{"a": {"n": [1, 2]}, "b": "q\\"uote"}]', '[{"a": NaN}, {"b": "ok"}]', '{"a": "outside"} [', "]" + '{"a": "1"}[', '[{"a": "한글"}] tail ]', "　[{\"a\": \" pad \"}] ", '[{"a": "x", "a": "y"}, {"b": "z"}]',
]


def test_table_function_equals_the_expressions(spark):
    sql.register(spark)
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "id long, raw string").repartition(3)
    frame.createOrReplaceTempView("pf_texts")
    got = spark.sql("SELECT * FROM pf_response_items(TABLE(pf_texts) PARTITION BY id, key => 'id', text => 'raw', fields => 'a, b')")
    assert got.columns == ["id", "obj_no", "a", "b"]
    assert rows_of(got) == rows_of(responses.response_rows(frame, "raw", ["a", "b"]))
    lateral = spark.sql("SELECT t.id, r.obj_no FROM (SELECT DISTINCT id FROM pf_texts WHERE id < 2) t, LATERAL pf_response_items(TABLE(SELECT * FROM pf_texts) PARTITION BY id, key => 'id', text => 'raw', fields => 'a') r WHERE r.id = t.id")
    assert rows_of(lateral) == [(0, 0), (1, 0), (1, 1)]


def test_table_function_over_a_large_partition(spark):
    """Objects are numbered on over the responses of a partition, in their order; totals close each partition."""
    sql.register(spark)
    frame = spark.createDataFrame([("hot", n, f'[{{"a": "{n}"}}, {{"a": "{n}"}}]') for n in range(1500)] + [(None, 1, '[{"a": "n"}]'), ("empty", 1, "-")], "k string, part int, raw string")
    frame.repartition(4).createOrReplaceTempView("pf_parts")
    got = spark.sql("SELECT * FROM pf_response_items(TABLE(pf_parts) PARTITION BY k ORDER BY part, key => 'k', text => 'raw', fields => 'a', totals => true)").collect()
    hot = sorted((r["obj_no"], r["a"]) for r in got if r["k"] == "hot" and r["a"] is not None)
    assert hot == [(n, str(n // 2)) for n in range(3000)]
    assert {(r["k"], r["obj_no"]) for r in got if r["a"] is None} == {("hot", 3000), (None, 1), ("empty", 0)}
    spark.createDataFrame([], "k string, part int, raw string").createOrReplaceTempView("pf_none")
    assert spark.sql("SELECT * FROM pf_response_items(TABLE(pf_none) PARTITION BY k, key => 'k', text => 'raw', fields => 'a')").collect() == []
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM pf_response_items(TABLE(pf_parts) PARTITION BY k, key => 'x', text => 'raw', fields => 'a')").collect()


def test_views_give_the_rows_of_their_queries(spark):
    from policyflow.plans import QUERIES

    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    chosen = ["j2", "j5", "a2", "w1", "w6", "x1", "k2", "v2", "asof", "sessions", "cube"]
    made = sql.views(spark, SF, chosen)
    assert made[-len(chosen):] == [f"pf_{c}" for c in chosen]
    for name in chosen:
        assert rows_of(spark.sql(f"SELECT * FROM pf_{name}")) == rows_of(QUERIES[name](spark, SF)), name
    top = sql.run(spark, SF, "SELECT event_type, count(*) AS n FROM pf_w1 GROUP BY event_type")
    assert sum(r["n"] for r in top.collect()) == QUERIES["w1"](spark, SF).count()


def test_merged_states(spark):
    """States of days merge to what the rows of all days give, within the bounds of the sketches."""
    rnd = random.Random(6)
    data = [(d, "hot" if rnd.random() < 0.6 else rnd.choice(["a", None]), rnd.randrange(6000), rnd.choice([None, rnd.gauss(0, 1)])) for d in range(1, 11) for _ in range(4000)]
    data += [(None, "a", 1, 1.0), (3, "nulls", None, None)]
    df = spark.createDataFrame(data, "d int, k string, u long, v double").repartition(6)
    states = sketches.daily_states(df, F.col("d"), ["k"], {"users": "u"}, {"spread": "v"}).cache()
    assert states.count() == 10 * 3 + 1
    for first, last in ((1, 10), (4, 6), (7, 7)):
        got = sketches.read_states(sketches.merged(states, ["k"], ["users"], ["spread"], F.col("day").between(first, last)), ["users"], {"spread": [0.1, 0.5, 0.9]})
        for r in got.collect():
            own = [(u, v) for d, k, u, v in data if d is not None and first <= d <= last and k == r["k"]]
            users, values = {u for u, _ in own if u is not None}, [v for _, v in own if v is not None]
            assert r["n"] == len(own) and abs(r["users"] - len(users)) <= 3 * 0.0065 * len(users) + 0.5
            if not values:
                assert r["spread"] is None
                continue
            for rank, value in zip((0.1, 0.5, 0.9), r["spread"]):
                assert abs(sum(v <= value for v in values) / len(values) - rank) <= 0.03
    # merging in two steps is merging
    halves = [sketches.merged(states, ["k"], ["users"], ["spread"], c) for c in (F.col("day") <= 5, F.col("day") > 5)]
    twice = sketches.read_states(sketches.merged(halves[0].unionByName(halves[1]), ["k"], ["users"], ["spread"]), ["users"], {"spread": [0.5]})
    once = sketches.read_states(sketches.merged(states, ["k"], ["users"], ["spread"]), ["users"], {"spread": [0.5]})
    assert {(r["k"], r["n"]): r["users"] for r in twice.collect()}.keys() == {(r["k"], r["n"]): r["users"] for r in once.collect()}.keys()
    assert sketches.merged(states.filter("false"), ["k"], ["users"], ["spread"]).isEmpty()
    states.unpersist()
