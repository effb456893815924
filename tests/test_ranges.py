import random

from pyspark.sql import functions as F

from tidelane.operators import intervals as iv

SPANS = "key string, id int, s double, e double, v string"


def spans(rng, n, at=1000.0, longest=(0.5, 3, 400, 1e6)):
    return [(rng.choice("abc"), i, x, x + rng.choice([0, 1, rng.random()]) * rng.choice(longest), f"v{i % 7}") for i in range(n) for x in [float(rng.choice([rng.uniform(-at, at), rng.randrange(-20, 20)]))]]


def test_a_long_interval_is_one_row(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 1e6, "x"), ("a", 2, 5.0, 5.5, "x"), ("a", 3, 7.0, 9.0, "x")], SPANS)
    got = sorted(tuple(r) for r in iv.held(df, "s", "e", 1.0).select("id", "_level", "_bucket").collect())
    assert [r[0] for r in got] == [1, 2, 3] and got[0][1] >= 20 and got[1] == (2, 0, 5) and got[2][1] in (1, 2)


def test_range_joins_equal_plain_ones(spark):
    rng = random.Random(1)
    a, b = spans(rng, 150), spans(rng, 120)
    odd = [("a", 900, 5.0, 2.0, "odd"), (None, 901, 0.0, 9.0, "null")]
    left, right = spark.createDataFrame([*a, *odd], SPANS), spark.createDataFrame([*b, ("b", 902, 9.0, 1.0, "odd")], SPANS)
    other = right.select("key", F.col("id").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    everything = [*a, odd[0]], [*b, ("b", 902, 9.0, 1.0, "odd")]
    for width in (0.3, 50.0):
        got = iv.overlapping(left, other, "key", width, ("s", "e"), ("s2", "e2"), "other").select("id", "other").collect()
        want = [(x[1], y[1]) for x in everything[0] for y in everything[1] if x[0] == y[0] and x[2] < y[3] and x[3] > y[2]]
        assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100
        got = iv.contained(left, other, "key", width, ("s", "e"), ("s2", "e2"), "other").select("id", "other").collect()
        want = [(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] >= y[2] and x[3] <= y[3]]
        assert sorted(r for r in map(tuple, got) if r[0] != 900) == sorted(want) and len(want) > 100
        points = left.select("id", "key", "s")
        got = {r.id: r.v for r in iv.point_in_interval(points, right.select("key", "id", F.col("s").alias("s2"), F.col("e").alias("e2"), "v").withColumnRenamed("id", "t"), "key", "s", "s2", "e2", width, ["t"], ["v"]).collect()}
        first = lambda x: min(((y[1], y[4]) for y in b if x[0] == y[0] and y[2] <= x[2] <= y[3]), default=(0, None))[1]
        assert got == {x[1]: first(x) for x in [*a, *odd]} and sum(v is not None for v in got.values()) > 50


def test_ends_count_at_great_times(spark):
    rows = [("a", i, 1.7e12 + i * 7919, 1.7e12 + i * 7919 + 2**k, "x") for i, k in enumerate([0, 1, 5, 10, 20, 30] * 20)]
    df = spark.createDataFrame(rows, SPANS)
    ends = df.select("id", "key", F.col("e").alias("at"))
    got = iv.point_in_interval(ends, df.select("key", F.col("id").alias("t"), "s", "e"), "key", "at", "s", "e", 1.0, ["t"], ["t"]).collect()
    want = {r[1]: min(y[1] for y in rows if y[2] <= r[3] <= y[3]) for r in rows}
    assert {r.id: r.t for r in got} == want


def test_as_of_equals_plain_lookup(spark):
    rng = random.Random(2)
    states = [(rng.choice(["a", "a", "b"]), rng.randrange(0, 300), f"s{i}", rng.choice([None, rng.randrange(0, 400)])) for i in range(150)] + [("a", None, "never", 5), (None, 3, "x", 9)]
    points = [(i, rng.choice(["a", "a", "b", "c", None]), rng.choice([None, rng.randrange(-10, 320)])) for i in range(300)]
    s, p = spark.createDataFrame(states, "key string, since int, mood string, until int"), spark.createDataFrame(points, "id int, key string, at int")

    def last(key, at, bounded):
        own = [(t, v, u if u is not None else -1) for k, t, v, u in states if k == key and k is not None and t is not None and at is not None and t <= at]
        t, v, u = max(own, default=(None, None, None))
        return v if v is not None and (not bounded or u >= at) else "neutral"

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            for until in (None, "until"):
                got = {r.id: r.mood for r in iv.as_of(p, s, "key", "at", "since", "mood", "neutral", until=until).collect()}
                want = {i: last(k, at, until) for i, k, at in points}
                if until is None:  # states of one time differ in value only
                    want = {i: max(((t, v) for k2, t, v, _ in states if k2 == k and k is not None and at is not None and t is not None and t <= at), default=(0, "neutral"))[1] for i, k, at in points}
                assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
