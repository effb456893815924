import glob
import hashlib
import json
import os
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidelane.functions import text
from tidelane.operators import aggregates, stored
from tidelane.operators import intervals as iv
from tidelane.plans import catalog
from tidelane.sources import catalogue, files

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
def test_table_sizes_are_those_of_files(spark, tmp_path):
    many = f"{tmp_path}/many"
    spark.range(10_000).repartition(3).write.parquet(many)
    paths = {"events": f"{SF}/events.parquet", "many": many}
    parts = glob.glob(f"{many}/*.parquet")
    want = {"events": (1, os.path.getsize(paths["events"]), pq.read_metadata(paths["events"]).num_rows), "many": (3, sum(map(os.path.getsize, parts)), 10_000)}
    got = catalogue.table_sizes(spark, paths).collect()
    assert {r.name: (r.files, r.bytes, r.row_count) for r in got} == want
    assert [r.place for r in got] == [1, 2] and got[0].bytes >= got[1].bytes
    assert {r.file.rsplit("/", 1)[1]: r.bytes for r in catalogue.table_files(spark, paths).where("name = 'many'").collect()} == {os.path.basename(p): os.path.getsize(p) for p in parts}
    sizes = catalog.queries()["s13_table_sizes"](spark, SF).collect()
    assert {r.name: r.bytes for r in sizes} == {os.path.basename(p)[:-8]: os.path.getsize(p) for p in glob.glob(f"{SF}/*.parquet")}


def test_stored_functions_in_sql_texts(spark):
    jobs = spark.createDataFrame([(1, "completed", 70, 1.0, 5.0), (2, "queued", None, 1.0, 5.0), (3, "queued", 5, 1.0, 5.0)], "id long, status string, progress int, run_seconds double, budget_limit double")
    segments = spark.createDataFrame([(i, 1, True, 0, 1) for i in range(4)] + [(9, 3, True, 0, 1)], "id long, job_id long, enhanced boolean, start_ms long, end_ms long")
    costs = spark.createDataFrame([(1, 0.5), (1, 1.5)], "job_id long, amount double")
    checkpoints = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01'), (2, TIMESTAMP '2024-02-01'), (3, NULL) AS t(id, expires_at)")
    stored.define(spark, jobs, segments, costs, checkpoints, "mine")
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "id long").repartition(2)
    got = spark.sql("SELECT id, mine_job_progress(id) AS p, mine_cost_efficiency(id) AS e FROM {asked} WHERE mine_job_progress(id) < 99", asked=asked)
    # four segments times two costs, over each cost four times
    assert {tuple(r) for r in got.collect()} == {(1, 70, 1.0), (2, 0, 0.0), (3, 5, 1.0), (4, 0, 0.0), (None, 0, 0.0)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert spark.sql("SELECT mine_expired_checkpoints(TIMESTAMP '2024-01-15') AS n").first().n == 1
    assert sorted(r.id for r in spark.sql("SELECT id FROM mine_live_checkpoints(TIMESTAMP '2024-01-15')").collect()) == [2, 3]


def test_sketches_are_near_the_exact_quantiles_however_they_are_merged(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("key"), F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.lit(200_000))).alias("ts"), F.when(F.col("id") % 7 != 0, F.pow(F.rand(3), 3) * 100).alias("v"))
    df = df.unionByName(spark.sql("SELECT 9L AS key, TIMESTAMP '2024-01-01' AS ts, 4.0D AS v"))
    asked = {"p5": 0.05, "p50": 0.5, "p99": 0.99}
    hours = aggregates.quantile_sketches(df, ["key"], "ts", "v")
    assert hours.where("key < 9").select("hour").distinct().count() >= 55
    found = aggregates.merged_quantiles(hours, ["key"], asked)
    rows = aggregates.quantile_errors(df, ["key"], "v", found, asked).collect()
    exact = {r.key: r for r in df.groupBy("key").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most")).collect()}
    assert {r.key for r in rows} == {0, 1, 2, 9}
    for r in rows:
        assert (r.n, r.least, r.most) == (exact[r.key].n, exact[r.key].least, exact[r.key].most) and abs(r.mean - exact[r.key].mean) < 1e-9
        assert max(r.p5_error, r.p50_error, r.p99_error) <= 2 * aggregates.SKETCH_ERROR
    (one,) = [r for r in rows if r.key == 9]
    assert (one.p5, one.p50, one.p99) == (4.0, 4.0, 4.0)
    part = aggregates.merged_quantiles(hours, ["key"], asked, since="2023-11-15 00:00:00", until="2023-11-16 00:00:00").where("key = 0").first()
    own = df.where("key = 0 AND v IS NOT NULL AND ts >= '2023-11-15' AND ts < '2023-11-16'")
    assert part.n == own.count()


def test_merged_intervals_carry_features(spark):
    rows = [("a", 1, 0, 10, 1.0, "x", {"f": 1, "g": 1}), ("a", 2, 5, 20, 2.0, "y", {"f": 2}), ("a", 3, 15, 18, 0.0, "x", None), ("a", 4, 30, 40, 5.0, "x", None), ("a", 5, 40, 50, 5.0, "x", {"h": None})]
    df = spark.createDataFrame(rows, "key string, id int, start_ms int, end_ms int, value double, kind string, features map<string,int>")
    got = [tuple(r) for r in iv.merge_typed(df, "key", features="features").orderBy("start_ms").collect()]
    assert got == [("a", 0, 20, 2.0, "mixed", {"f": 2, "g": 1}), ("a", 30, 40, 5.0, "x", {}), ("a", 40, 50, 5.0, "x", {"h": None})]


def test_subtitles_as_json(spark):
    words = spark.createDataFrame([(1, 0, "well", 1.0, 1.5, 0.5), (1, 1, "met", 1.5, 2.0, 0.7), (1, 2, "by", 4.0, 4.25, 0.9), (2, 0, "no", 0.0, 0.5, 1.0)], "key int, pos int, word string, start double, end double, confidence double")
    lines = spark.createDataFrame([(1, 1, 1.0, 2.0, "well met"), (1, 2, 4.0, 4.25, "by")], "key int, line int, start double, end double, text string")
    got = {r.key: json.loads(r.content) for r in files.to_subtitle_json(lines, words, ["key"], "concat('clip-', key)").collect()}
    assert got[1] == {
        "clip_info": {"slug": "clip-1", "start_ms": 1000, "end_ms": 4250, "duration_ms": 3250, "word_count": 3, "average_confidence": pytest.approx(0.7)},
        "subtitles": [
            {"index": 1, "start_ms": 0, "end_ms": 1000, "text": "well met", "confidence": pytest.approx(0.6), "words": [{"word": "well", "start": 1.0, "end": 1.5, "confidence": 0.5}, {"word": "met", "start": 1.5, "end": 2.0, "confidence": 0.7}]},
            {"index": 2, "start_ms": 3000, "end_ms": 3250, "text": "by", "confidence": 0.9, "words": [{"word": "by", "start": 4.0, "end": 4.25, "confidence": 0.9}]},
        ],
    }
    assert got[2]["subtitles"] == [] and got[2]["clip_info"]["word_count"] == 1


@needs_tables
def test_subtitle_json_holds_every_word(spark):
    from tidelane.plans import text_queries

    got = [json.loads(r.content) for r in catalog.queries()["s8_subtitle_json"](spark, SF).collect()]
    words = sorted(r.word for r in text_queries._stream(spark, SF).collect())
    assert sorted(w["word"] for c in got for x in c["subtitles"] for w in x["words"]) == words
    assert all(x["index"] == i + 1 for c in got for i, x in enumerate(c["subtitles"])) and sum(c["clip_info"]["word_count"] for c in got) == len(words)


def test_named_uuids(spark):
    got = [r[0] for r in spark.createDataFrame([("job:1",), ("",), ("é",), (None,)], "n string").select(text.named_uuid(F.col("n"))).collect()]
    want = [str(uuid.UUID(bytes=hashlib.md5(n.encode()).digest(), version=3)) for n in ("job:1", "", "é")]
    assert got[:3] == want and got[3] is None
