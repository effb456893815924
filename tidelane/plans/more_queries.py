"""Further scalar functions, rules, maintenance and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelane.functions import lexicons as lex
from tidelane.functions import scoring, text
from tidelane.operators import intervals as iv
from tidelane.operators import ranking
from tidelane.operators import relational as rel
from tidelane.plans.registry import query
from tidelane.plans.relational_queries import AS_OF, _d
from tidelane.plans.timeline_queries import _SERIES, _series
from tidelane.sources.tables import cte, source, table


@query("f7_content_keys", "SELECT doc_id, sha256(text) AS key, md5(text) AS short_key FROM documents")
def content_keys(s, d):
    return source(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"), F.md5(F.col("text").cast("binary")).alias("short_key"))


@query("f9_epoch_seconds", "SELECT event_id, round(epoch_us(ts) / 1e6, 6) AS seconds, round((epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(ts)) / 1e6, 6) AS age FROM events")
def epoch_seconds(s, d):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return source(s, d, "events").select("event_id", F.round(t / 1e6, 6).alias("seconds"), F.round((F.unix_micros(F.lit(AS_OF).cast("timestamp")) - t) / 1e6, 6).alias("age"))


@query("f11_linear_levels", "SELECT event_id, round(CASE WHEN 10 - value > -60 THEN greatest(0.0, least(1.0, pow(10, (10 - value) / 20))) ELSE 0 END, 8) AS level FROM events")
def linear_levels(s, d):
    return source(s, d, "events").select("event_id", F.round(text.decibels_to_linear(10 - F.col("value")), 8).alias("level"))


@query("f17_interpolated_arcs", "SELECT event_id, round(CASE WHEN x <= 0 THEN 0 WHEN x <= 20 THEN x * 0.015 WHEN x <= 40 THEN 0.3 + (x - 20) * -0.045 WHEN x <= 60 THEN -0.6 + (x - 40) * -0.01 WHEN x <= 80 THEN -0.8 + (x - 60) * 0.065 WHEN x <= 100 THEN 0.5 + (x - 80) * 0.025 ELSE 1.0 END, 8) AS target FROM (SELECT event_id, value AS x FROM events)")
def interpolated_arcs(s, d):
    return source(s, d, "events").select("event_id", F.round(text.interpolate(F.col("value"), [0, 20, 40, 60, 80, 100], lex.ARCS["cinderella"]), 8).alias("target"))


@query("f12_truncation", "SELECT event_id, trunc(value * 1000 / 7)::INTEGER AS ms, (c // 80 + CASE WHEN c % 80 > 40 OR (c % 80 = 40 AND c // 80 % 2 = 1) THEN 1 ELSE 0 END) / 10.0::DOUBLE AS halves FROM (SELECT *, round(value * 100)::BIGINT AS c FROM events)")
def truncation(s, d):
    return source(s, d, "events").select("event_id", (F.col("value") * 1000 / 7).cast("int").alias("ms"), F.bround(F.col("value") / 8, 1).alias("halves"))


@query("f13_json_roundtrip", "SELECT event_id, CAST(props->>'$.k' AS INTEGER) + 1 AS next, '{\"k\":' || (CAST(props->>'$.k' AS INTEGER) + 1) || '}' AS props FROM events")
def json_roundtrip(s, d):
    k = F.from_json("props", "k int")["k"] + 1
    return source(s, d, "events").select("event_id", k.alias("next"), F.to_json(F.struct(k.alias("k"))).alias("props"))


@query("f14_map_merge", "SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def map_merge(s, d):
    g = source(s, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    m = g.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return m.select("user_id", F.try_element_at("m", F.lit("purchase")).alias("purchase"), F.size("m").cast("long").alias("kinds"))


@query("w9_positions", cte("span") + "SELECT id, round((row_number() OVER (PARTITION BY key ORDER BY start_ms, id) - 1) / greatest(count(*) OVER (PARTITION BY key) - 1, 1), 8) AS position FROM span")
def positions(s, d):
    return _d(scoring.position_ratio(table(s, d, "span"), ["key"], ["start_ms", "id"]).select("id", "position"), "position", digits=8)


@query("w14_counted_levels", "SELECT user_id, level, count(*) AS n FROM (SELECT user_id, CASE WHEN value >= 90 THEN 'critical' WHEN value >= 80 THEN 'high' WHEN value >= 70 THEN 'moderate' ELSE 'low' END AS level, lag(CASE WHEN value >= 90 THEN 'critical' WHEN value >= 80 THEN 'high' WHEN value >= 70 THEN 'moderate' ELSE 'low' END) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE level IS DISTINCT FROM before GROUP BY 1, 2")
def counted_levels(s, d):
    e = source(s, d, "events").select("user_id", "ts", scoring.pressure(F.col("value")).alias("level"))
    return iv.state_changes(e, "user_id", ["ts"], "level").groupBy("user_id", "level").agg(F.count(F.lit(1)).alias("n"))


@query("j9_words_in_clips", cte("span") + ", c AS (SELECT id AS clip, key, start_ms AS s, end_ms + 1800000 AS e FROM span WHERE kind = 'purchase') SELECT clip, count(*) AS words FROM c JOIN span w ON w.key = c.key AND w.kind <> 'purchase' AND w.start_ms BETWEEN s AND e GROUP BY 1")
def words_in_clips(s, d):
    x = table(s, d, "span")
    clips = x.where("kind = 'purchase'").select("key", F.col("id").alias("outer_id"), F.col("start_ms").alias("s"), (F.col("end_ms") + 1800000).alias("e"))
    return iv.contained(x.where("kind <> 'purchase'"), clips, "key", 1800000, ("start_ms", "start_ms"), ("s", "e")).groupBy(F.col("outer_id").alias("clip")).agg(F.count(F.lit(1)).alias("words"))


@query("j17_single_scan_compare", "SELECT event_type, round(avg(value) FILTER (user_id % 2 = 0), 6) AS control, round(avg(value) FILTER (user_id % 2 = 1), 6) AS experimental FROM events GROUP BY 1")
def single_scan_compare(s, d):
    side = lambda r: F.round(F.avg(F.when(F.col("user_id") % 2 == r, F.col("value"))), 6)
    return source(s, d, "events").groupBy("event_type").agg(side(0).alias("control"), side(1).alias("experimental"))


@query("j22_overlap_text", cte("span") + ", w AS (SELECT id AS outer_id, key, start_ms - 7200000 AS s, start_ms + 7200000 AS e FROM span WHERE kind = 'signup') SELECT outer_id, string_agg(kind, ' ' ORDER BY start_ms, id) AS text FROM w JOIN span x ON x.key = w.key AND x.start_ms < e AND x.end_ms > s GROUP BY 1")
def overlap_text(s, d):
    x = table(s, d, "span")
    windows = x.where("kind = 'signup'").select("key", F.col("id").alias("outer_id"), (F.col("start_ms") - 7200000).alias("s"), (F.col("start_ms") + 7200000).alias("e"))
    pairs = iv.overlapping(x, windows, "key", 7200000, ("start_ms", "end_ms"), ("s", "e"), "outer_id")
    return pairs.groupBy("outer_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "id", "kind"))), lambda r: r["kind"]), " ").alias("text"))


_PATTERN = "CASE WHEN sd > 0.15 THEN 'volatile' WHEN m > 0.7 THEN 'peak' WHEN m < 0.3 THEN 'low' WHEN sl > 0.02 THEN 'building' WHEN sl < -0.02 THEN 'drop' ELSE 'plateau' END"


@query("r25_significance", cte("span") + _SERIES + f""", g AS (SELECT key, i // 5 AS win, avg(value) AS m, stddev_pop(value) AS sd, regr_slope(value, i) AS sl FROM s GROUP BY 1, 2), l AS (SELECT *, max(win) OVER (PARTITION BY key) AS last FROM g), p AS (SELECT *, {_PATTERN} AS pattern FROM l WHERE win < last)
SELECT key, win, round(least(1.0, CASE pattern WHEN 'peak' THEN 0.9 WHEN 'building' THEN 0.8 WHEN 'volatile' THEN 0.7 WHEN 'drop' THEN 0.6 WHEN 'plateau' THEN 0.4 ELSE 0.2 END + least(0.3, m * 0.3)), 6) AS significance FROM p""")
def significance(s, d):
    w = iv.fixed_windows(_series(s, d), "key", 5)
    return w.select("key", "win", F.round(scoring.significance(F.col("pattern"), F.col("mean"), F.lit("")), 6).alias("significance"))


@query("j21_engagement_peaks", cte("span") + _SERIES + """, g AS (SELECT key, i // 5 AS win, avg(value) AS e FROM s GROUP BY 1, 2), x AS (SELECT s.key, s.id, s.i, s.value * 0.4 + coalesce(g.e, 0.5) * 0.3 + 0.15 AS c FROM s LEFT JOIN g ON s.key = g.key AND s.i // 5 = g.win), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(c, 9) DESC, id) AS r FROM x WHERE c > 0.5)
SELECT key, id, round(c, 6) AS engagement FROM r WHERE r <= 8""")
def engagement_peaks(s, d):
    series = _series(s, d).withColumn("win", F.floor(F.col("i") / 5))
    windows = series.groupBy("key", "win").agg(F.avg("value").alias("e"))
    x = series.join(windows, ["key", "win"], "left").withColumn("c", F.col("value") * 0.4 + F.coalesce("e", F.lit(0.5)) * 0.3 + 0.15).where("c > 0.5")
    return ranking.top_per_key(x, ["key"], [F.round("c", 9).desc(), F.col("id")], 8).select("key", "id", F.round("c", 6).alias("engagement"))


@query("o18_hook_first", cte("span") + "SELECT id, row_number() OVER (PARTITION BY key ORDER BY kind <> 'view', value DESC, id)::INTEGER AS place FROM span")
def hook_first(s, d):
    w = Window.partitionBy("key").orderBy(F.col("kind") != "view", F.col("value").desc(), "id")
    return table(s, d, "span").select("id", F.row_number().over(w).alias("place"))


@query("o19_mode_cut", cte("span") + "SELECT key, id, value + 0.5 * (k % 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value + 0.5 * (k % 3) DESC, id) AS r FROM span) WHERE r <= 8")
def mode_cut(s, d):
    x = table(s, d, "span").withColumn("score", F.col("value") + 0.5 * (F.col("k") % 3))
    return ranking.top_per_key(x, ["key"], [F.col("score").desc(), F.col("id")], 8).select("key", "id", "score")


@query("r2_energy_lookup", cte("span") + "SELECT id, [0.1, 0.3, 0.5, 0.7, 0.9][least(trunc(k / 100.0 * 5)::INT, 4) + 1]::DOUBLE AS energy FROM span")
def energy_lookup(s, d):
    series = F.array(*[F.lit(x) for x in (0.1, 0.3, 0.5, 0.7, 0.9)])
    return table(s, d, "span").select("id", scoring.energy_at(series, F.col("k").cast("double"), F.lit(100.0)).alias("energy"))


@query("r27_merged_labels", "SELECT doc_id, list_sort(list_distinct([lang, source, lang])) AS labels, coalesce(nullif(trim(left(text, 12)), ''), 'untitled') AS title FROM documents")
def merged_labels(s, d):
    title = F.coalesce(F.nullif(F.trim(F.substring("text", 1, 12)), F.lit("")), F.lit("untitled"))
    return source(s, d, "documents").select("doc_id", F.array_sort(F.array_distinct(F.array("lang", "source", "lang"))).alias("labels"), title.alias("title"))


@query("r28_recommendations", "SELECT user_id, list_filter([CASE WHEN h < 25 THEN 'raise cache' END, CASE WHEN n > 70 THEN 'add connections' END, CASE WHEN b > 5 THEN 'check locks' END], lambda x: x IS NOT NULL) AS advice FROM (SELECT user_id, count(*) FILTER (event_type = 'view') * 100.0 / count(*) AS h, count(*) AS n, count(*) FILTER (event_type = 'error' AND value > 80) AS b FROM events GROUP BY 1)")
def recommendations(s, d):
    a = source(s, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "view") * 100.0 / F.count(F.lit(1))).alias("h"), F.count(F.lit(1)).alias("n"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 80)).alias("b"))
    return a.select("user_id", F.array_compact(F.array(F.when(F.col("h") < 25, "raise cache"), F.when(F.col("n") > 70, "add connections"), F.when(F.col("b") > 5, "check locks"))).alias("advice"))


@query("u3_remaining", "SELECT user_id, list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(k, x))) AS missing FROM (SELECT user_id, list(DISTINCT event_type) AS k FROM events WHERE value > 150 GROUP BY 1)")
def remaining(s, d):
    k = source(s, d, "events").where("value > 150").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return k.select("user_id", F.array_except(F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"])), "k").alias("missing"))


@query("d4_status_update", cte("job") + "SELECT id, CASE WHEN status = 'processing' THEN 'completed' ELSE status END AS status, CASE WHEN status = 'processing' THEN 1 WHEN status = 'completed' THEN run_seconds END AS run_seconds FROM job")
def status_update(s, d):
    jobs = table(s, d, "job")
    return rel.update(jobs, {"run_seconds": F.lit(1).cast("bigint"), "status": "completed"}, {"status": "processing"}).select("id", "status", F.col("run_seconds"))


@query("d10_key_lookup", "SELECT c_custkey FROM customer WHERE sha256(c_name) = sha256('Customer#000000007') AND c_acctbal > -100000")
def key_lookup(s, d):
    return source(s, d, "customer").where((F.sha2("c_name", 256) == F.sha2(F.lit("Customer#000000007"), 256)) & (F.col("c_acctbal") > -100000)).select("c_custkey")


@query("d8_progress", cte("job") + "SELECT id, coalesce(CASE status WHEN 'completed' THEN 100 WHEN 'processing' THEN 50 END, 0) AS progress FROM job")
def progress(s, d):
    p = F.when(F.col("status") == "completed", 100).when(F.col("status") == "processing", 50)
    return table(s, d, "job").select("id", F.coalesce(p, F.lit(0)).alias("progress"))


@query("s13_largest_groups", "SELECT l_returnflag || l_linestatus AS name, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def largest_groups(s, d):
    return source(s, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name").limit(5)
