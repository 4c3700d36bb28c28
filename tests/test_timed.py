"""Joins along time, sessions, ranks, moving frames, grouping sets and intersection against plain Python: nulls, ties, empty tables, a hot key."""

import collections
import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from policyflow.operators import ordered, ranked, timed

BASE = dt.datetime(2024, 1, 1)


@pytest.fixture
def spread(spark):
    """Ranges stay as many as there are shuffle partitions."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, before)


def at(minutes):
    return None if minutes is None else BASE + dt.timedelta(minutes=minutes)


def rows(n, seed, hot=0.4):
    """(k, minute, id, v): a hot key, null keys and times, ties."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < hot else rnd.choice([None, "a", "b", "c"])
        out.append((key, None if rnd.random() < 0.05 else rnd.randrange(400), i, rnd.choice([None, 1, 2, 3])))
    return out


def frame(spark, data):
    return spark.createDataFrame([(k, at(m), i, v) for k, m, i, v in data], "k string, t timestamp, id long, v int").repartition(5)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_a_hot_key_lies_in_many_ranges(spread):
    blocks = ordered.in_ranges(frame(spread, rows(2000, 1, 0.9)), ["k"], ["t", "id"])
    assert blocks.filter("k = 'hot'").select("__block").distinct().count() >= 5


@pytest.mark.parametrize("tolerance", [None, 0, 30 * 60])
def test_asof(spread, tolerance):
    left, right = rows(300, 2), rows(200, 3)
    left.append(left[0])
    want = []
    for k, m, i, v in left:
        found = [(m2, i2, v2) for k2, m2, i2, v2 in right if k is not None and k2 == k and None not in (m, m2) and m2 <= m]
        best = max(found, key=lambda x: x[:2], default=None)
        if best and tolerance is not None and (m - best[0]) * 60 > tolerance:
            best = None
        want.append((k, i, best and best[1], best and best[2]))
    out = timed.asof_join(frame(spread, left), frame(spread, right), [("k", "k")], "t", "t", "id", {"id": "other", "v": "value"}, tolerance)
    assert out.columns == ["k", "t", "id", "v", "other", "value"]
    assert got(out, "k", "id", "other", "value") == sorted(want, key=str)


def test_asof_without_rows(spark):
    some, none = frame(spark, rows(20, 4)), frame(spark, rows(20, 4)).filter("false")
    out = timed.asof_join(some, none, [("k", "k")], "t", "t", "id", {"id": "other"})
    assert out.count() == 20 and out.filter("other IS NOT NULL").isEmpty()
    assert timed.asof_join(none, some, [("k", "k")], "t", "t", "id", {"id": "other"}).isEmpty()


def test_overlap(spread):
    rnd = random.Random(5)

    def spans(n):
        out = []
        for i in range(n):
            a = rnd.randrange(-3000, 3000)
            b = a + rnd.choice([-5, 0, 1, 10, 100, 5000])
            out.append((rnd.choice(["hot", "hot", "a", None]), None if rnd.random() < 0.05 else a, None if rnd.random() < 0.05 else b, i))
        return out

    left, right = spans(150), spans(150)
    left.append(left[3])
    make = lambda data: spread.createDataFrame([(k, at(a), at(b), i) for k, a, b, i in data], "k string, a timestamp, b timestamp, id long")
    want = []
    for (k, a, b, i), (k2, c, d, j) in itertools.product(left, right):
        if k is not None and k == k2 and None not in (a, b, c, d) and a <= b and c <= d and a <= d and c <= b:
            want.append((i, j, (min(b, d) - max(a, c)) * 60.0))
    for unit in (60, 3600, 86_400):
        out = timed.overlap_join(make(left), make(right), [("k", "k")], ("a", "b"), ("a", "b"), {"id": "other"}, unit=unit)
        assert got(out, "id", "other", "overlap_seconds") == sorted(want, key=str)
    assert timed.overlap_join(make(left), make(right).filter("false"), [("k", "k")], ("a", "b"), ("a", "b"), {"id": "other"}).isEmpty()


def test_sessions(spread):
    data = rows(600, 6)
    want, numbers = [], collections.Counter()
    by_key = collections.defaultdict(list)
    for k, m, i, v in data:
        if m is not None:
            by_key[k].append((m, i))
    for k, own in by_key.items():
        last = None
        for m, i in sorted(own):
            numbers[k] += last is None or m - last >= 3
            want.append((k, i, numbers[k]))
            last = m
    out = timed.with_sessions(frame(spread, data), ["k"], "t", "id", 180)
    assert got(out, "k", "id", "session_no") == sorted(want, key=str)
    groups = timed.sessions(frame(spread, data), ["k"], "t", "id", 180, {"least": F.min("id")})
    least = collections.defaultdict(list)
    for k, i, s in want:
        least[k, s].append(i)
    assert got(groups, "k", "session_no", "n_rows", "least") == sorted(((k, s, len(x), min(x)) for (k, s), x in least.items()), key=str)
    assert timed.with_sessions(frame(spread, data).filter("false"), ["k"], "t", "id", 180).isEmpty()


def test_ranks(spread):
    data = rows(400, 7)
    want = []
    for k in {r[0] for r in data}:
        own = sorted(((-1 if v is None else v, i) for k2, _, i, v in data if k2 == k))
        values = sorted({v for v, _ in own})
        for n, (v, i) in enumerate(own):
            rank, last = sum(x < v for x, _ in own) + 1, sum(x <= v for x, _ in own)
            size, larger = divmod(len(own), 7)
            tile = n // (size + 1) + 1 if n < larger * (size + 1) else larger + (n - larger * (size + 1)) // max(size, 1) + 1
            want.append((k, i, rank, values.index(v) + 1, (rank - 1) / (len(own) - 1) if len(own) > 1 else 0.0, last / len(own), tile))
    out = ranked.ranks(frame(spread, data), ["k"], "v", "id", 7)
    assert got(out, "k", "id", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile") == sorted(want, key=str)
    few = ranked.ranks(frame(spread, data[:3]), [], "v", "id", 7)
    assert sorted(r["ntile"] for r in few.collect()) == [1, 2, 3]
    assert ranked.ranks(frame(spread, data).filter("false"), ["k"], "v", "id").isEmpty()


def test_moving_rows(spread):
    data = rows(500, 8)
    sums = {"total": F.sum("v"), "least": F.min("id"), "n": F.count(F.lit(1))}
    want = []
    for k in {r[0] for r in data}:
        own = sorted(((-1 if m is None else m, i, v) for k2, m, i, v in data if k2 == k))
        for n, (_, i, _) in enumerate(own):
            part = own[max(0, n - 9) : n + 1]
            values = [v for *_, v in part if v is not None]
            want.append((k, i, sum(values) if values else None, min(x for _, x, _ in part), len(part)))
    for width in (10, 13, 1 << 18):
        out = ranked.moving_rows(frame(spread, data), ["k"], ["t", "id"], 10, sums, width)
        assert got(out, "k", "id", "total", "least", "n") == sorted(want, key=str)
    assert got(ranked.moving_rows(frame(spread, data), ["k"], ["t", "id"], 1, {"n": F.count(F.lit(1))}, 4), "n") == [(1,)] * 500
    assert ranked.moving_rows(frame(spread, data).filter("false"), ["k"], ["t", "id"], 10, sums).isEmpty()


def test_moving_time(spread):
    data = rows(500, 9)
    want = []
    for k, m, i, _ in data:
        part = [(j, v) for k2, m2, j, v in data if k2 == k and (m2 is None if m is None else m2 is not None and m - 25 <= m2 <= m)]
        values = [v for _, v in part if v is not None]
        want.append((k, i, sum(values) if values else None, min(j for j, _ in part), len(part)))
    sums = {"total": F.sum("v"), "least": F.min("id"), "n": F.count(F.lit(1))}
    for frames in (1, 2, 50):
        out = ranked.moving_time(frame(spread, data), ["k"], "t", 25 * 60, sums, frames)
        assert got(out, "k", "id", "total", "least", "n") == sorted(want, key=str)
    assert ranked.moving_time(frame(spread, data).filter("false"), ["k"], "t", 60, sums).isEmpty()


def test_grouping_sets(spread):
    rnd = random.Random(10)
    data = [(rnd.choice(["x", "y", None]), rnd.choice([1, 2, None]), rnd.choice([None, *range(8)]), rnd.randrange(100)) for _ in range(400)]
    df = spread.createDataFrame(data, "a string, b int, u long, v long")
    want = []
    for mask in range(4):
        groups = collections.defaultdict(list)
        for a, b, u, v in data:
            groups[None if mask & 2 else a, None if mask & 1 else b].append((u, v))
        want += [(a, b, mask, sum(v for _, v in x), len({u for u, _ in x} - {None})) for (a, b), x in groups.items()]
    out = ranked.cube(df, ["a", "b"], {"total": F.col("v")}, {"users": "u"})
    assert got(out, "a", "b", "grouping_id", "total", "users") == sorted(want, key=str)
    some = ranked.cube(df, ["a", "b"], {"total": F.col("v")}, {"users": "u"}, [["b"], []])
    assert got(some, "a", "b", "grouping_id", "total", "users") == sorted((w for w in want if w[2] in (2, 3)), key=str)
    # what is expanded are groups, not rows
    plan = ranked.cube(df, ["a", "b"], {"total": F.col("v")}, {})._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Expand") < plan.rindex("HashAggregate")


def test_intersect(spread):
    rnd = random.Random(11)
    side = lambda n: [(rnd.choice(["hot", "hot", "a", "b", None]), rnd.choice([1, 2, None])) for _ in range(n)]
    left, right = side(100), side(60) + [("only here", 1)]
    make = lambda data: spread.createDataFrame([(*x, "other") for x in data], "k string, v int, clash string")
    both = collections.Counter(left) & collections.Counter(right)
    assert got(ranked.intersect(make(left), make(right), ["k", "v"]), "k", "v") == sorted(both, key=str)
    assert got(ranked.intersect(make(left), make(right), ["k", "v"], every=True), "k", "v") == sorted(both.elements(), key=str)
    assert ranked.intersect(make(left), make(right).filter("false"), ["k", "v"]).isEmpty()
