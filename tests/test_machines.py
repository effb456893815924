"""Streams in order of event time equal their batch forms over restarts, and say which late rows they drop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidelane.operators import stateful
from tidelane.streaming import events as st
from tidelane.streaming import machines as m

ZERO = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(autouse=True)
def state_store(spark):
    before = spark.conf.get(m.STATE_STORE[0])
    spark.conf.set(*m.STATE_STORE)
    yield
    spark.conf.set(m.STATE_STORE[0], before)


def events(rows):
    """(event_id, seconds, user_id, event_type, value)"""
    return [(i, ZERO.replace(tzinfo=None) + dt.timedelta(seconds=s), u, kind, float(v), None) for i, s, u, kind, v in rows]


def put(spark, folder, name, rows):
    spark.createDataFrame(events(rows), st.EVENTS).coalesce(1).write.parquet(f"{folder}/{name}")


def run(df, tmp_path, name):
    """The rows of a query that starts from its checkpoint, sees what there is, and ends."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return [tuple(r) for r in df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/{name}-out").collect()]


def source(spark, folder):
    raw = spark.readStream.schema(st.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def some_rows(seed, n=240, users=5, late=300):
    """Rows that come up to ``late`` seconds out of order, and a last one long after."""
    rng = random.Random(seed)
    rows = [(i, rng.randrange(0, 20_000), rng.randrange(users), rng.choice(["error", "error", "view"]), rng.choice([0.5, 1.0, 2.0])) for i in range(n)]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, late))
    return rows, (9_999, 90_000, 77, "view", 0.0)


def parts(spark, folder, rows, last, n=6):
    cut = [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]
    return [*cut, [last], [(last[0] + 1, last[1] + 1, last[2], last[3], last[4])]]


@pytest.mark.parametrize("keep", [None, 600.0])
def test_machines_equal_batch_over_a_restart(spark, tmp_path, keep):
    rows, last = some_rows(1)
    folder = f"{tmp_path}/in"
    failing, cost = F.col("event_type") == "error", F.col("value")
    kinds = {
        "alerts": lambda e: m.held_alerts(e, failing, 500.0, keep=keep),
        "breaker": lambda e: m.circuit_breaker(e, ~failing, failures=3, recovery=400.0, successes=2, keep=keep),
        "budget": lambda e: m.budget_guard(e, cost, cap=6.0, keep=keep),
    }
    todo = parts(spark, folder, rows, last)
    for i, part in enumerate(todo[:4]):
        put(spark, folder, f"p{i}", part)
    for name, make in kinds.items():
        run(make(source(spark, folder)), tmp_path, name)
    for i, part in enumerate(todo[4:]):
        put(spark, folder, f"q{i}", part)
    got = {name: run(make(source(spark, folder)), tmp_path, name) for name, make in kinds.items()}

    by_user = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        by_user.setdefault(r[2], []).append(r)
    start = ZERO.timestamp()
    want = {name: [] for name in kinds}
    for user, own in by_user.items():
        spells = [[]]
        for a in own:  # silence cuts a key's rows in pieces that know nothing of each other
            if keep is not None and spells[-1] and a[1] - spells[-1][-1][1] >= keep:
                spells.append([])
            spells[-1].append(a)
        for piece in spells:
            breaker, budget, since = stateful.Breaker(3, 400.0, 2), stateful.Budget(6.0, False), None
            b, c = breaker.first, budget.first
            for i, s, _, kind, v in piece:
                b, told = breaker.step(b, start + s, kind != "error")
                want["breaker"].append((user, i, *told))
                c, told = budget.step(c, start + s, v)
                want["budget"].append((user, i, *told))
            for i, (_, s, _, kind, _) in enumerate(piece):
                since = (s if since is None else since) if kind == "error" else None
                ends = piece[i + 1][1] if i + 1 < len(piece) else None
                if since is not None and (ends is None or piece[i + 1][3] != "error") and (ends is None or ends - since >= 500):
                    forgotten = keep is not None and ends is None and s + keep < since + 500
                    want["alerts"] += [] if forgotten else [(user, start + since, start + since + 500)]
    for name in kinds:
        assert sorted(r for r in got[name] if r[0] != 77) == sorted(want[name]) and len(want[name]) > 5, name
    if keep is None:
        batch = spark.createDataFrame([(u, i, start + s, kind == "error", v) for i, s, u, kind, v in rows], "user_id long, event_id long, at double, bad boolean, cost double")
        timed = stateful.timed_alerts(batch, ["user_id"], "at", "bad", 500.0, tie="event_id").collect()
        assert sorted(map(tuple, timed)) == sorted(want["alerts"])
        guard = stateful.budget_guard(batch, ["user_id"], "at", "cost", 6.0, tie="event_id").collect()
        assert sorted(map(tuple, guard)) == sorted(want["budget"])


def test_an_alert_fires_though_no_row_of_its_key_comes(spark, tmp_path):
    folder = f"{tmp_path}/in"
    put(spark, folder, "a", [(1, 100, 1, "error", 1)])
    put(spark, folder, "b", [(2, 5_000, 2, "view", 1)])
    put(spark, folder, "c", [(3, 5_001, 2, "view", 1)])
    got = run(m.held_alerts(source(spark, folder), F.col("event_type") == "error", 300.0), tmp_path, "x")
    start = ZERO.timestamp()
    assert got == [(1, start + 100, start + 400)]


def test_joined_streams_drop_what_is_too_late(spark, tmp_path):
    left, right = f"{tmp_path}/left", f"{tmp_path}/right"
    put(spark, left, "a", [(1, 1_000, 1, "error", 0), (2, 5_000, 1, "error", 0)])
    put(spark, right, "a", [(11, 1_100, 1, "view", 0), (12, 5_050, 1, "view", 0), (13, 5_050, 2, "view", 0)])
    run(st.near_events(source(spark, left), source(spark, right), 300), tmp_path, "near")
    # both watermarks stand at 5,000 - 600 by now: 3 and 14 are within it, 4 and 15 are too late
    put(spark, left, "b", [(3, 4_500, 1, "error", 0), (4, 1_200, 1, "error", 0)])
    put(spark, right, "b", [(14, 4_600, 1, "view", 0), (15, 1_050, 1, "view", 0), (16, 9_000, 1, "view", 0)])
    got = run(st.near_events(source(spark, left), source(spark, right), 300), tmp_path, "near")
    assert sorted((r[1], r[3]) for r in got) == [(1, 11), (2, 12), (3, 14)]


def test_windows_and_inserts_drop_what_is_too_late(spark, tmp_path):
    folder = f"{tmp_path}/in"
    put(spark, folder, "a", [(1, 100, 1, "view", 1), (2, 8_000, 1, "view", 1), (2, 8_000, 1, "view", 1)])
    windows = lambda: st.windowed_counts(source(spark, folder)).select(F.unix_seconds("window.start").alias("s"), "event_type", "n")
    inserts = lambda: st.insert_if_absent(source(spark, folder), ["event_id"]).select("event_id", "value")
    sessions = lambda: st.sessions(source(spark, folder), "1 hour").select("user_id", "n")
    run(windows(), tmp_path, "w"), run(inserts(), tmp_path, "i"), run(sessions(), tmp_path, "s")
    # the watermark is at 7,400: 3 is late for the first hour and for its session, 4 isn't late; 2 comes again
    put(spark, folder, "b", [(3, 200, 1, "view", 1), (4, 7_500, 1, "view", 1), (2, 8_000, 1, "view", 9)])
    put(spark, folder, "c", [(5, 50_000, 1, "view", 1)])
    put(spark, folder, "d", [(6, 50_001, 1, "view", 1)])
    start = int(ZERO.timestamp())
    assert sorted(run(windows(), tmp_path, "w")) == [(start, "view", 1), (start + 7_200, "view", 4)]
    assert sorted(run(inserts(), tmp_path, "i")) == [(1, 1.0), (2, 1.0), (4, 1.0), (5, 1.0), (6, 1.0)]
    assert sorted(run(sessions(), tmp_path, "s")) == [(1, 1), (1, 4)]
