import os

import pytest
from pyspark.sql import functions as F

from tidelane.operators import stateful
from tidelane.streaming import events as st

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet(f"{SF}/events.parquet").coalesce(1).sortWithinPartitions("ts").write.mode("overwrite").parquet(out)
    return out


def run(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows_equal_batch(spark, folder, tmp_path):
    got = run(st.windowed_counts(st.read_events(spark, folder)), "complete", tmp_path, "w1")
    batch = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    key = lambda r: (r["window"]["start"], r["event_type"], r["n"], round(r["total"], 6))
    assert sorted(map(key, got.collect())) == sorted(map(key, batch.collect()))


def test_cooldown_and_bucket_equal_batch(spark, folder, tmp_path):
    timed = spark.read.parquet(folder).select(F.col("user_id"), F.col("event_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.lit(1.0).alias("cost"))
    got = run(st.cooldown(st.read_events(spark, folder), 86400.0), "append", tmp_path, "c1")
    want = stateful.cooldown(timed, ["user_id"], "at", 86400.0, tie="event_id")
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in want.collect())
    got = run(st.token_bucket(st.read_events(spark, folder), 3.0, 1e-5), "append", tmp_path, "b1")
    want = stateful.token_bucket(timed, ["user_id"], "at", "cost", 3.0, 1e-5, tie="event_id")
    assert sorted((r["event_id"], r["allowed"]) for r in got.collect()) == sorted((r["event_id"], r["allowed"]) for r in want.collect())


@pytest.mark.parametrize("compact", [2, 32])
def test_totals_are_upserted(spark, folder, tmp_path, compact):
    out, many = f"{tmp_path}/totals", f"{tmp_path}/many"
    spark.read.parquet(folder).repartitionByRange(9, "ts").write.parquet(many)
    totals = st.running_totals(st.read_events(spark, many, 1))
    q = totals.writeStream.outputMode("update").foreachBatch(st.upsert_sink(out, "user_id", compact)).option("checkpointLocation", f"{tmp_path}/k").trigger(availableNow=True).start()
    q.awaitTermination(240)
    # of bases at 1, 3, 5 and 7, the last two stay, and the versions behind the first of them
    assert st._versions(out, "version") == ([6, 7, 8] if compact == 2 else list(range(9))) and st._versions(out, "base") == ([5, 7] if compact == 2 else [])
    os.makedirs(f"{out}/base=8")  # one that is being written is none
    got = {r["user_id"]: r["n"] for r in st.read_upserts(spark, out, "user_id", totals.schema).collect()}
    assert got == {r["user_id"]: r["count"] for r in spark.read.parquet(folder).groupBy("user_id").count().collect()}
    st.upsert_sink(out, "user_id", compact)(spark.createDataFrame([(1, -1.0, 0)], totals.schema), 9)
    again = {r["user_id"]: r["total"] for r in st.read_upserts(spark, out, "user_id", totals.schema).collect()}
    assert again[1] == -1.0 and set(again) == set(got) | {1}


def test_sessions_equal_batch(spark, folder, tmp_path):
    got = run(st.sessions(st.read_events(spark, folder)), "append", tmp_path, "s1").collect()
    batch = st.sessions(spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    key = lambda r: (r["session_window"]["start"], r["session_window"]["end"], r["user_id"], r["n"])
    assert set(map(key, got)) <= set(map(key, batch)) and len(got) > 0.9 * len(batch)
