"""Operators against brute force and laws they must keep."""

import random

from pyspark.sql import Window, functions as F

from policyflow.functions import codes, tags
from policyflow.operators import assembly, containment, merge, ordered, ranges, sections, structures, vote


def keyed(spark, n=3000, hot=0.4, seed=1):
    rnd = random.Random(seed)
    data = [
        ("hot" if rnd.random() < hot else (None if rnd.random() < 0.1 else f"k{rnd.randrange(20)}"), i * 3 + rnd.randrange(3), rnd.choice([None, 1, 2, 3, 4]))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "k string, pos long, v int").repartition(6)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_blocks_equal_plain_windows(spark):
    df = keyed(spark).cache()
    w = Window.partitionBy("k").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    for width in (7, 64, 1 << 20):
        same(ordered.number_in_order(df, ["k"], "pos", "o", width), df.withColumn("o", F.row_number().over(w)))
        same(
            ordered.running_before(df, ["k"], "pos", F.col("v"), "o", width),
            df.withColumn("o", F.coalesce(F.sum("v").over(before), F.lit(0))),
        )
        same(ordered.last_filled(df, ["k"], "pos", F.col("v"), "o", width), df.withColumn("o", F.last("v", True).over(w)))
        same(
            ordered.next_filled(df, ["k"], "pos", F.col("v"), "o", width),
            df.withColumn("o", F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing))),
        )
    same(ordered.number_sorted(df, ["k"], ["v", "pos"], "o"), df.withColumn("o", F.row_number().over(Window.partitionBy("k").orderBy("v", "pos"))))
    same(ordered.number_in_order(df, [], "pos", "o", 100), df.withColumn("o", F.row_number().over(Window.orderBy("pos"))))


def test_batches_of_a_keyed_list(spark):
    df = keyed(spark, 500).filter("k is not null")
    out = ordered.batches(df, "pos", 5, ["k"], width=16)
    sizes = out.groupBy("k", "batch_no", "batch_total").count().collect()
    assert all(r["count"] == 5 or r["batch_no"] == r["batch_total"] for r in sizes) and sum(r["count"] for r in sizes) == df.count()


def test_range_join_is_the_brute_force(spark):
    rnd = random.Random(2)
    letters = ["A", "B", "C", "AB", "Z", "암", "_"]

    def code():
        number = rnd.choice([rnd.randrange(100), rnd.randrange(5000), rnd.randrange(10**9)])
        return rnd.choice(letters) + str(number) + rnd.choice(["", ".5", "x"])

    points = spark.createDataFrame([(code(),) for _ in range(300)], "c string").distinct().cache()
    rules = []
    for _ in range(120):
        low, high = code(), code()
        if rnd.random() < 0.5:  # a range within one letter
            n = rnd.randrange(1000)
            low, high = f"C{n}", f"C{n + rnd.choice([0, 5, 500, 90000])}"
        rules.append((low, None if rnd.random() < 0.1 else high, f"r{len(rules)}"))
    table = spark.createDataFrame(rules, "f string, t string, r string").cache()
    for mode in ("reference", "ordered"):
        for whole in (False, True):
            brute = points.crossJoin(table).filter(codes.in_range(F.col("c"), F.col("f"), F.coalesce("t", "f"), mode, whole)).select("c", "r")
            same(ranges.map_codes(points, "c", table, "f", "t", "r", mode, whole).select("c", F.col("code").alias("r")), brute)


def test_matching_is_the_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("ab암") for _ in range(rnd.randrange(0, 5)))
    items = [(i, word(), word()) for i in range(150)]
    answers = [(i, word(), word(), f"c{i}") for i in range(60)]
    table = {}
    for _, b, t, c in answers:
        table[(b, t)] = c

    def find(b, t):
        if (b, t) in table:
            return table[(b, t)]
        return next((c for (rb, rt), c in table.items() if (rb in b or b in rb) and (rt in t or t in rt)), "")

    out = containment.match_responses(
        spark.createDataFrame(items, "id long, b string, t string"), spark.createDataFrame(answers, "pos long, b string, t string, code string"),
        "b", "t", ["code"], "pos",
    )
    assert {r["id"]: r["code"] for r in out.collect()} == {i: find(b, t) for i, b, t in items}


def test_containment_of_long_names(spark):
    """Names of 2,000 characters give pieces in proportion to their length; names with one beginning meet by their rarest piece."""
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcd ") for _ in range(n))
    long = [text(2000) for _ in range(20)] + ["same beginning of all " + text(30) for _ in range(50)] + ["ab", "", "x" * 400]
    short = [x[k : k + n] for x in long[:20] for k, n in ((0, 9), (700, 300), (5, 1))] + ["same beginning of all " + x[22:30] for x in long[20:70]] + ["", "x" * 50, "zz", text(8)]
    frame = lambda names: spark.createDataFrame([("g", n) for n in names], "k string, name string")
    got = sorted(tuple(r) for r in containment.inside(frame(short), frame(long), ["k"]).select("short", "long").collect())
    assert got == sorted({(s, x) for s in short for x in long if s and s in x})
    cells = frame(long).select(F.size(containment._pieces("name", F.lit(containment.SEED))).alias("n")).filter("n > 0")
    assert cells.agg(F.max("n")).first()[0] <= 2000


def test_section_ends_are_the_brute_force(spark):
    rnd = random.Random(4)
    texts = ["별표", "상해 별표", "질병 상해 별표", "제도성 특별약관", "말", "상해관련 특별약관"]
    data = [(f"d{rnd.randrange(3)}", i, i * 10, rnd.choice(texts)) for i in range(200)]
    markers = ["관련 특별약관", "제도성 특별약관", "별표"]

    def end(doc, pos, text):
        later = (r for r in data if r[0] == doc and r[1] > pos and any(m in r[3] for m in markers) and text not in r[3])
        return next((r[2] for r in later), None)

    df = spark.createDataFrame(data, "doc string, pos long, start long, text string")
    out = assembly.section_ends(df, "doc", "pos", "start", "text", width=16)
    got = {r["pos"]: r["section_end"] for r in out.collect()}
    assert got == {p: end(d, p, t) for d, p, _, t in data}


def test_section_ends_of_a_crowded_document(spark):
    """10,000 comments, half of them markers of many sections, in one document: what is joined are pieces and answers, not comments by markers."""
    rnd = random.Random(12)
    rows = []
    for i in range(10_000):
        section = i // 40
        rows.append(("d", i, i * 10, rnd.choice([f"{section} 관련 특별약관", f"갑{section % 7} 별표"]) if i % 2 else rnd.choice([f"{section} 관련 특별약관", "별표", f"{section}", "text"])))
    df = spark.createDataFrame(rows, "doc string, pos long, start long, text string").repartition(4)
    got = {r["pos"]: r["section_end"] for r in assembly.section_ends(df, "doc", "pos", "start", "text", width=512).collect()}
    markers = [(p, s, t) for _, p, s, t in rows if "관련 특별약관" in t or "별표" in t]
    for _, pos, _, text in rows[::97]:
        assert got[pos] == next((s for p, s, t in markers if p > pos and text not in t), None)
    plan = assembly.section_ends(df, "doc", "pos", "start", "text", width=512)._jdf.queryExecution().optimizedPlan().toString()
    assert "__piece" in plan and "Cartesian" not in plan


def test_rendering_keeps_plain_texts(spark):
    ctx = F.struct(
        *[F.lit(1).alias(c) for c in ("exempt", "reduce", "confirm", "parent", "reserve", "extend", "team", "renew", "no_renew", "independent")],
        F.lit(True).alias("once"), F.lit(False).alias("twice"), F.array(F.lit("n")).alias("names"), F.array(F.array(F.lit(30))).alias("periods"),
        F.array(F.lit("c")).alias("codes"), F.create_map(F.lit("c"), F.array(F.array(F.lit(5.0)))).alias("rates"),
    )
    df = spark.createDataFrame([("plain text",), ("brace { only",), ("{감액있음1-1}x{감액있음1-2}",)], "t string").withColumn("ctx", ctx)
    once = df.select("ctx", tags.render(F.col("t"), F.col("ctx"), F.create_map().cast("map<string,string>")).alias("t"))
    twice = once.select(tags.render(F.col("t"), F.col("ctx"), F.create_map().cast("map<string,string>")).alias("t"))
    assert [r["t"] for r in once.collect()] == ["plain text", "brace { only", "x"] == [r["t"] for r in twice.collect()]


def test_merge_twice_changes_nothing(spark):
    schema = "product_code string, benefit_code string, sub_benefit_code string, diagnosis_code string"
    old = spark.createDataFrame([("p", f"b{i}", "s", f"v{i % 3}") for i in range(20)], schema)
    new = spark.createDataFrame([("p", f"b{i}", "s", f"v{i % 4}") for i in range(10, 30)], schema)
    after = merge.merged(old, new)
    assert {r["change_type"] for r in merge.classify(after, new, fields=["diagnosis_code"]).collect()} == {"skip"}
    same(merge.merged(after, new), after)
    assert after.count() == 30


def test_pieces_restore_the_text(spark):
    text = "앞 별표[질병관련1] x 별표 2 y 무배당 암 특약 약관 " + "z" * 50 + " 제2관 수술 특약 끝"
    df = spark.createDataFrame([(text,)], "t string")
    for pattern, word in ((sections.APPENDIX, "별표"), (sections.BENEFIT, "특약")):
        assert df.select(F.array_join(sections._pieces(F.col("t"), pattern, word), "")).first()[0] == text


def test_vote_is_symmetric_for_equal_answers(spark):
    schema = "n int, pos int, inferred_code string, confidence string, source string, ref_page string, ref_sentence string"
    data = [(i, i, code, conf, "s", "1", "r") for i, (code, conf) in enumerate((c, f) for c in ("A", "B b", "") for f in ("high", "medium", "low", "odd"))]
    a = spark.createDataFrame(data, schema)
    b = spark.createDataFrame([(r[0], r[1], r[2].lower().replace(" ", ""), *r[3:]) for r in data], schema)
    left = vote.vote_batch(a.drop("pos"), b, ["n"], "pos").select("n", "score", "label", "agreement")
    right = vote.vote_batch(b.drop("pos"), a, ["n"], "pos").select("n", "score", "label", "agreement")
    same(left, right)


def test_wanted_lists_hold_only_what_is_asked(spark):
    subs = spark.createDataFrame([(1, i, f"v{i}") for i in range(1, 1000)], "id long, no int, value string")
    wanted = spark.createDataFrame([(1, 5), (1, 5), (1, 2000)], "id long, no int")
    out = structures.wanted_lists(subs, wanted, ["id"], "value", "list")
    got = out.select(structures.entry(F.col("list"), F.lit(5)), structures.entry(F.col("list"), F.lit(6)), F.size("list")).first()
    assert tuple(got) == ("v5", None, 1)


def test_rows_of_few_codes_come_from_many_tasks(spark):
    """A few codes with very many rows: their matches are few bytes, yet no task makes most of the rows."""
    points = spark.range(8000).select(F.col("id"), F.concat(F.lit("A"), F.lpad((F.col("id") % 80).cast("string"), 2, "0")).alias("c"))
    table = spark.range(50).select(F.lit("A00").alias("f"), F.lit("A99").alias("t"), F.col("id").cast("string").alias("r"))
    for mode in ("reference", "ordered"):
        out = ranges.map_codes(points, "c", table, "f", "t", "r", mode)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 8000 * 50 and len(sizes) > 8 and max(sizes) < sum(sizes) / 4
