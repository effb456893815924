"""Queries over intervals, sequences and ordered selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelane.functions import scoring
from tidelane.functions.text import cosine, srt_time
from tidelane.operators import intervals as iv
from tidelane.operators import ranking, stateful, vectors
from tidelane.plans.registry import query
from tidelane.plans.relational_queries import _d
from tidelane.sources.tables import cte, source, table

_ISLANDS = """, r AS (SELECT *, max(end_ms) OVER (PARTITION BY key ORDER BY start_ms, end_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM span)"""


@query("i1_merge_bounds", cte("span") + _ISLANDS + """, g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY start_ms, end_ms, id) AS i FROM r)
SELECT key, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM g GROUP BY key, i""")
def merge_bounds(s, d):
    return iv.merge_bounds(table(s, d, "span"), "key")


@query("i17_merge_typed", cte("span") + _ISLANDS + """, g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY start_ms, end_ms, id) AS i FROM r)
SELECT key, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(value) AS value, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'mixed' END AS kind FROM g GROUP BY key, i""")
def merge_typed(s, d):
    return iv.merge_typed(table(s, d, "span"), "key")


@query("i16_sessions", cte("span") + """, g AS (SELECT *, CASE WHEN start_ms - lag(start_ms) OVER w <= 7200000 THEN 0 ELSE 1 END AS n FROM span WINDOW w AS (PARTITION BY key ORDER BY start_ms)), h AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY start_ms) AS i FROM g)
SELECT key, min(start_ms) AS "start", max(start_ms) AS "end", count(*) AS n FROM h GROUP BY key, i HAVING max(start_ms) - min(start_ms) >= 60000""")
def sessions(s, d):
    return iv.sessions(table(s, d, "span"), "key", "start_ms", 7200000, 60000)


@query("i15_threshold_runs", cte("span") + """, q AS (SELECT key, quantile_cont(value, 0.75) AS t FROM span GROUP BY 1), f AS (SELECT s.*, s.value > q.t AS hot FROM span s JOIN q USING (key)),
e AS (SELECT *, hot <> coalesce(lag(hot) OVER (PARTITION BY key ORDER BY start_ms), false) AS edge FROM f), c AS (SELECT *, lead(start_ms) OVER (PARTITION BY key ORDER BY start_ms) AS stop FROM e WHERE edge)
SELECT key, start_ms AS "start", stop AS "end", 0.8::DOUBLE AS score FROM c WHERE hot AND stop IS NOT NULL AND stop - start_ms >= 3600000""")
def threshold_runs(s, d):
    return iv.threshold_runs(table(s, d, "span"), "key", "start_ms", "value", 0.75, 3600000, 0.8)


@query("w5_runs", cte("span") + """, c AS (SELECT *, CASE WHEN kind = lag(kind) OVER w THEN 0 ELSE 1 END AS n FROM span WINDOW w AS (PARTITION BY key ORDER BY start_ms, id)), g AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY start_ms, id) AS run FROM c)
SELECT key, run::BIGINT AS run, min(kind) AS kind, count(*) AS n, min(start_ms) AS start_ms, max(start_ms) AS last_ms FROM g GROUP BY key, run""")
def runs(s, d):
    r = iv.changes(table(s, d, "span"), "key", ["start_ms", "id"], "kind")
    return r.groupBy("key", "run").agg(F.min("kind").alias("kind"), F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("start_ms"), F.max("start_ms").alias("last_ms"))


_WORDS = """, w AS (SELECT key, start_ms AS pos, kind AS word, start_ms / 1000.0 AS s, end_ms / 1000.0 AS e, value AS confidence FROM span)"""


def _words(s, d):
    return table(s, d, "span").select("key", F.col("start_ms").alias("pos"), F.col("kind").alias("word"), (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), F.col("value").alias("confidence"), F.col("kind").alias("speaker"))


@query("w4_drop_repeated_words", cte("span") + _WORDS + """, c AS (SELECT *, CASE WHEN word = lag(word) OVER o THEN 0 ELSE 1 END AS n FROM w WINDOW o AS (PARTITION BY key ORDER BY pos)), g AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY pos) AS run FROM c)
SELECT key, min(word) AS word, round(min(s), 3) AS "start", round(max_by(e, pos), 3) AS "end", max(confidence) AS confidence FROM g GROUP BY key, run""")
def drop_repeated_words(s, d):
    return _d(iv.drop_repeated_words(_words(s, d), "key", ["pos"]), "start", "end", digits=3)


@query("w18_state_changes", cte("span") + "SELECT id, kind, previous FROM (SELECT id, kind, lag(kind) OVER (PARTITION BY key ORDER BY start_ms, id) AS previous FROM span) WHERE kind IS DISTINCT FROM previous")
def state_changes(s, d):
    return iv.state_changes(table(s, d, "span"), "key", ["start_ms", "id"], "kind").select("id", "kind", "previous")


@query("w3_gaps", cte("span") + "SELECT id, lead(start_ms) OVER (PARTITION BY key ORDER BY start_ms, end_ms, id) - end_ms AS gap FROM span")
def gaps(s, d):
    return iv.gaps_to_next(table(s, d, "span"), "key", "start_ms", "end_ms").select("id", "gap")


@query("w2_peaks", cte("span") + "SELECT id, value FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM span WINDOW w AS (PARTITION BY key ORDER BY start_ms)) WHERE value > a AND value > b AND value > 50")
def peaks(s, d):
    return iv.peaks(table(s, d, "span"), "key", ["start_ms"], "value", 50).select("id", "value")


@query("w16_pad_transitions", cte("span") + _WORDS + """SELECT key, pos, round(CASE WHEN lag(e) OVER o IS NULL THEN s ELSE greatest(s - 0.05, lag(e) OVER o - 0.1) END, 3) AS "start", round(CASE WHEN lead(s) OVER o IS NULL THEN e ELSE least(e + 0.05, lead(s) OVER o + 0.1) END, 3) AS "end"
  FROM w WINDOW o AS (PARTITION BY key ORDER BY s, e)""")
def pad_transitions(s, d):
    return _d(iv.pad_transitions(_words(s, d), "key").select("key", "pos", "start", "end"), "start", "end", digits=3)


@query("i18_merge_same_speaker", cte("span") + _WORDS + """, c AS (SELECT *, CASE WHEN word = lag(word) OVER o AND s - lag(e) OVER o < 600 THEN 0 ELSE 1 END AS n FROM w WINDOW o AS (PARTITION BY key ORDER BY s, e)), g AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY s, e) AS r FROM c)
SELECT key, min(word) AS speaker, round(min(s), 3) AS "start", round(max_by(e, pos), 3) AS "end" FROM g GROUP BY key, r HAVING max_by(e, pos) - min(s) >= 10""")
def merge_same_speaker(s, d):
    return _d(iv.merge_same_speaker(_words(s, d), "key", 600, 10), "start", "end", digits=3)


@query("w6_row_history", cte("span") + "SELECT id, round(avg(value) OVER (PARTITION BY key ORDER BY start_ms, id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 8) AS mean FROM span")
def row_history(s, d):
    w = Window.partitionBy("key").orderBy("start_ms", "id").rowsBetween(-59, 0)
    return table(s, d, "span").select("id", F.round(F.avg("value").over(w), 8).alias("mean"))


_SERIES = ", s AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY start_ms) - 1 AS i, least(value / 100, 1.0) AS value, k / 50.0 - 1 AS v, id FROM span)"


def _series(s, d):
    i = F.row_number().over(Window.partitionBy("key").orderBy("start_ms")) - 1
    return table(s, d, "span").select("key", i.alias("i"), F.least(F.col("value") / 100, F.lit(1.0)).alias("value"), (F.col("k") / 50.0 - 1).alias("v"), "id")


@query("w11_fixed_windows", cte("span") + _SERIES + """, g AS (SELECT key, i // 5 AS win, avg(value) AS m, stddev_pop(value) AS sd, regr_slope(value, i) AS sl FROM s GROUP BY 1, 2), l AS (SELECT *, max(win) OVER (PARTITION BY key) AS last FROM g)
SELECT key, win, round(m, 6) AS mean, round(sd, 6) AS std, round(sl, 6) AS slope, CASE WHEN sd > 0.15 THEN 'volatile' WHEN m > 0.7 THEN 'peak' WHEN m < 0.3 THEN 'low' WHEN sl > 0.02 THEN 'building' WHEN sl < -0.02 THEN 'drop' ELSE 'plateau' END AS pattern FROM l WHERE win < last""")
def fixed_windows(s, d):
    return _d(iv.fixed_windows(_series(s, d), "key", 5), "mean", "std", "slope", digits=6)


@query("w12_trend", cte("span") + _SERIES + "SELECT key, round(regr_slope(value, i), 8) AS slope FROM s GROUP BY 1")
def trend(s, d):
    return _series(s, d).groupBy("key").agg(F.round(F.regr_slope("value", "i"), 8).alias("slope"))


@query("w13_third_trend", cte("span") + _SERIES + """, n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM s), a AS (SELECT key, sum(value) FILTER (i < n // 3) / max(n // 3) AS b, sum(value) FILTER (i >= n - ceil(n / 3)) / max(n // 3) AS e FROM n WHERE n >= 3 GROUP BY 1)
SELECT key, round(e - b, 6) AS change, CASE WHEN e - b > 0.1 THEN 'rising' WHEN e - b < -0.1 THEN 'falling' ELSE 'stable' END AS trend FROM a""")
def third_trend(s, d):
    n = _series(s, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n >= 3")
    third = F.floor(F.col("n") / 3)
    a = n.groupBy("key").agg((F.sum(F.when(F.col("i") >= F.col("n") - F.ceil(F.col("n") / 3), F.col("value"))) / F.max(third) - F.sum(F.when(F.col("i") < third, F.col("value"))) / F.max(third)).alias("c"))
    return a.select("key", F.round("c", 6).alias("change"), F.when(F.col("c") > 0.1, "rising").when(F.col("c") < -0.1, "falling").otherwise("stable").alias("trend"))


@query("w17_sliding_arcs", cte("span") + _SERIES + """, g AS (SELECT *, round(regr_slope(value, i) OVER f, 12) AS a, round(regr_slope(v, i) OVER f, 12) AS b, count(*) OVER f AS n, max(value) OVER f - min(value) OVER f AS ir, max(v) OVER f - min(v) OVER f AS vr, avg(value) OVER f AS ia FROM s WINDOW f AS (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
c AS (SELECT *, CASE WHEN a > 0.1 AND b > 0.1 THEN 'rising_positive' WHEN a > 0.1 AND b < -0.1 THEN 'rising_negative' WHEN a < -0.1 AND b > 0.1 THEN 'resolving_positive' WHEN a < -0.1 AND b < -0.1 THEN 'declining' WHEN ir > 0.4 THEN 'volatile' END AS arc FROM g WHERE n = 5)
SELECT id, arc, round(least(1.0, ir * 0.4 + vr * 0.3 + ia * 0.3), 6) AS impact FROM c WHERE arc IS NOT NULL""")
def sliding_arcs(s, d):
    return _d(iv.sliding_arcs(_series(s, d), "key", ["i"], "value", "v").select("id", "arc", "impact"), "impact", digits=6)


@query("w10_hopping_energy", "SELECT t AS start_s, round(sqrt(avg(value * value)), 6) AS rms FROM (SELECT value, unnest([epoch_us(ts) // 1000000 // 1800 * 1800, epoch_us(ts) // 1000000 // 1800 * 1800 - 1800]) AS t FROM events) GROUP BY 1")
def hopping_energy(s, d):
    e = source(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms")).select(F.unix_seconds("window.start").alias("start_s"), "rms")


# --- range joins: purchases are the outer intervals of a key ---


@query("j4_point_in_interval", cte("span") + """, p AS (SELECT id, key, start_ms FROM span WHERE kind <> 'purchase'), t AS (SELECT id AS tid, key, start_ms AS s, end_ms + 3600000 AS e FROM span WHERE kind = 'purchase')
SELECT p.id, coalesce(min(t.tid), -1) AS turn FROM p LEFT JOIN t ON p.key = t.key AND p.start_ms BETWEEN t.s AND t.e GROUP BY p.id""")
def point_in_interval(s, d):
    x = table(s, d, "span")
    turns = x.where("kind = 'purchase'").select("key", F.col("id").alias("turn"), F.col("start_ms").alias("s"), (F.col("end_ms") + 3600000).alias("e"))
    out = iv.point_in_interval(x.where("kind <> 'purchase'").select("id", "key", "start_ms"), turns, "key", "start_ms", "s", "e", 3600000, ["turn"], ["turn"])
    return out.select("id", F.coalesce("turn", F.lit(-1)).alias("turn"))


@query("j18_emotion_at", cte("span") + """, p AS (SELECT id, key, start_ms FROM span WHERE kind <> 'error'), t AS (SELECT key, start_ms AS s, max('feeling ' || k % 5) AS emotion, max(struct_pack(v := 'feeling ' || k % 5, e := end_ms + 36000000)).e AS e FROM span WHERE kind = 'error' GROUP BY 1, 2)
SELECT p.id, CASE WHEN p.start_ms <= t.e THEN t.emotion ELSE 'neutral' END AS emotion FROM p ASOF LEFT JOIN t ON p.key = t.key AND p.start_ms >= t.s""")
def emotion_at(s, d):
    x = table(s, d, "span")
    states = x.where("kind = 'error'").select("key", F.col("start_ms").alias("since"), (F.col("end_ms") + 36000000).alias("until"), F.concat(F.lit("feeling "), (F.col("k") % 5).cast("string")).alias("emotion"))
    points = x.where("kind <> 'error'").select("id", "key", "start_ms")
    return iv.as_of(points, states, "key", "start_ms", "since", "emotion", "neutral", until="until").select("id", "emotion")


@query("j5_midpoint_in_interval", cte("span") + """, p AS (SELECT id, key, (start_ms + end_ms) / 2.0 AS m FROM span WHERE kind = 'view'), t AS (SELECT id AS tid, key, start_ms AS s, end_ms + 3600000 AS e FROM span WHERE kind = 'click')
SELECT id, coalesce(speaker, 'UNKNOWN') AS speaker FROM (SELECT p.id, 'S' || t.tid AS speaker, row_number() OVER (PARTITION BY p.id ORDER BY t.s, t.tid) AS r FROM p LEFT JOIN t ON p.key = t.key AND p.m BETWEEN t.s AND t.e) WHERE r = 1""")
def midpoint_in_interval(s, d):
    x = table(s, d, "span")
    turns = x.where("kind = 'click'").select("key", F.concat(F.lit("S"), F.col("id").cast("string")).alias("speaker"), F.col("id").alias("tid"), F.col("start_ms").alias("s"), (F.col("end_ms") + 3600000).alias("e"))
    points = x.where("kind = 'view'").select("id", "key", ((F.col("start_ms") + F.col("end_ms")) / 2.0).alias("m"))
    return iv.point_in_interval(points, turns, "key", "m", "s", "e", 3600000, ["s", "tid"], ["speaker"]).select("id", F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker"))


_OUTER = ", o AS (SELECT id AS outer_id, key, start_ms - 36000000 AS s, end_ms + 36000000 AS e FROM span WHERE kind = 'purchase'), n AS (SELECT * FROM span WHERE kind IN ('view', 'click'))"


def _contained(s, d):
    x = table(s, d, "span")
    outer = x.where("kind = 'purchase'").select("key", F.col("id").alias("outer_id"), (F.col("start_ms") - 36000000).alias("s"), (F.col("end_ms") + 36000000).alias("e"))
    return iv.contained(x.where("kind IN ('view', 'click')"), outer, "key", 36000000, ("start_ms", "end_ms"), ("s", "e"))


@query("j6_contained_text", cte("span") + _OUTER + "SELECT outer_id, string_agg(kind || k, ' ' ORDER BY start_ms, id) AS text, count(*) AS n FROM n JOIN o ON n.key = o.key AND n.start_ms >= o.s AND n.end_ms <= o.e GROUP BY 1")
def contained_text(s, d):
    part = F.struct("start_ms", "id", F.concat("kind", F.col("k").cast("string")).alias("w"))
    return _contained(s, d).groupBy("outer_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["w"]), " ").alias("text"), F.count(F.lit(1)).alias("n"))


@query("j7_contained_kinds", cte("span") + _OUTER + "SELECT outer_id, list_sort(list(DISTINCT kind)) AS kinds FROM n JOIN o ON n.key = o.key AND n.start_ms >= o.s AND n.end_ms <= o.e GROUP BY 1")
def contained_kinds(s, d):
    return _contained(s, d).groupBy("outer_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


@query("j8_band_join", cte("span") + "SELECT a.id, count(*) AS near FROM span a JOIN span b ON a.key = b.key AND a.kind = 'error' AND b.kind <> 'error' AND abs(a.start_ms - b.start_ms) < 1800000 GROUP BY 1")
def band_join(s, d):
    x = table(s, d, "span")
    pairs = iv.within(x.where("kind = 'error'"), x.where("kind <> 'error'").withColumnRenamed("id", "other"), "key", "start_ms", "start_ms", 1800000, ["other"])
    return pairs.groupBy("id").agg(F.count(F.lit(1)).alias("near"))


@query("j10_overlap_anti", cte("span") + "SELECT id, value + 2.0 AS score FROM span l WHERE kind = 'view' AND NOT EXISTS (SELECT 1 FROM span r WHERE r.key = l.key AND r.kind = 'click' AND l.start_ms < r.end_ms AND l.end_ms > r.start_ms)")
def overlap_anti(s, d):
    x = table(s, d, "span")
    return iv.overlap_anti(x.where("kind = 'view'"), x.where("kind = 'click'"), "key", 600000).select("id", (F.col("value") + 2.0).alias("score"))


@query("j11_overlap_lengths", cte("span") + "SELECT a.id, b.id AS other, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS overlap_ms FROM span a JOIN span b ON a.key = b.key AND a.kind = 'view' AND b.kind = 'signup' AND a.start_ms < b.end_ms AND a.end_ms > b.start_ms")
def overlap_lengths(s, d):
    x = table(s, d, "span")
    right = x.where("kind = 'signup'").select("key", F.col("id").alias("other"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    pairs = iv.overlapping(x.where("kind = 'view'"), right, "key", 600000, ("start_ms", "end_ms"), ("s", "e"), "other")
    return pairs.join(right.select("other", "s", "e"), "other").select("id", "other", iv.overlap_length("start_ms", "end_ms", "s", "e").alias("overlap_ms"))


@query("j12_positional_join", cte("span") + ", s AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY start_ms, id) - 1 AS pos, start_ms, end_ms FROM span), b AS (SELECT id, key, unnest([k, k + 1, k * 2]) AS pos FROM span WHERE kind = 'signup') SELECT b.id, min(s.start_ms) AS start_ms, max(s.end_ms) AS end_ms, count(*) AS n FROM b JOIN s ON b.key = s.key AND b.pos = s.pos GROUP BY 1")
def positional_join(s, d):
    x = table(s, d, "span")
    at = x.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("start_ms", "id")) - 1).alias("pos"), "start_ms", "end_ms")
    beats = x.where("kind = 'signup'").select("id", "key", F.explode(F.array(F.col("k"), F.col("k") + 1, F.col("k") * 2)).alias("pos"))
    return beats.join(at, ["key", "pos"]).groupBy("id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"))


@query("j15_nearest_vector", """WITH c AS (SELECT label, embedding AS e FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r = 1),
s AS (SELECT v.vec_id, c.label AS speaker, list_cosine_similarity(v.embedding::DOUBLE[], c.e::DOUBLE[]) AS score FROM embeddings v, c) SELECT vec_id, speaker, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, speaker) AS r FROM s WHERE score > 0.2) WHERE r = 1""")
def nearest_vector(s, d):
    v = source(s, d, "embeddings")
    known = ranking.top_per_key(v, ["label"], [F.col("vec_id")], 1).withColumnRenamed("label", "speaker")  # a vector a speaker
    return vectors.nearest(v, known, "vec_id", "embedding", "speaker", 0.2).withColumn("score", F.round("score", 6))


@query("f16_neighbour_cosine", "WITH n AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT vec_id, round(list_cosine_similarity(a::DOUBLE[], b::DOUBLE[]), 6) AS score FROM n WHERE b IS NOT NULL")
def neighbour_cosine(s, d):
    v = source(s, d, "embeddings").withColumn("b", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("b IS NOT NULL")
    return v.select("vec_id", F.round(cosine("embedding", "b"), 6).alias("score"))


@query("j19_rank_merge", "WITH a AS (SELECT user_id, count(*) / 100.0 AS l FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, count(*) / 2.0 AS r FROM events WHERE event_type = 'purchase' AND value > 150 GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, round(least(coalesce(l, 0) * 0.7 + coalesce(r, 0) * 0.3, 1.0), 6) AS importance FROM a FULL JOIN b ON a.user_id = b.user_id")
def rank_merge(s, d):
    e = source(s, d, "events")
    a = e.where("event_type = 'view'").groupBy("user_id").agg((F.count(F.lit(1)) / 100.0).alias("l"))
    b = e.where("event_type = 'purchase' AND value > 150").groupBy("user_id").agg((F.count(F.lit(1)) / 2.0).alias("r"))
    zero = F.lit(0.0)
    return a.join(b, "user_id", "full").select("user_id", F.round(F.least(F.coalesce("l", zero) * 0.7 + F.coalesce("r", zero) * 0.3, F.lit(1.0)), 6).alias("importance"))


# --- selections ---

_PLAN = cte("span")


@query("o2_top_k", _PLAN + "SELECT key, id, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value DESC, id) AS r FROM span) WHERE r <= 8")
def top_k(s, d):
    return ranking.top_per_key(table(s, d, "span"), ["key"], [F.col("value").desc(), F.col("id")], 8).select("key", "id", "value")


@query("o3_top_then_time", _PLAN + "SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY start_ms, id)::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value DESC, id) AS r FROM span) WHERE r <= 6")
def top_then_time(s, d):
    return ranking.take_then_time(table(s, d, "span"), ["key"], "value", "start_ms", "id", 6).select("key", "id", "place")


@query("o4_quality_first", _PLAN + "SELECT id, row_number() OVER (PARTITION BY key ORDER BY value DESC, id)::INTEGER AS place FROM span")
def quality_first(s, d):
    return ranking.strategy_order(table(s, d, "span"), ["key"], "quality_first", score="value").select("id", "place")


_BEAT = "CASE kind WHEN 'view' THEN 'hook' WHEN 'click' THEN 'development' WHEN 'signup' THEN 'climax' WHEN 'purchase' THEN 'resolution' END"


def _beats(s, d):
    return table(s, d, "span").withColumn("beat_type", F.expr(_BEAT))


@query("o5_narrative_flow", _PLAN + f"SELECT id, row_number() OVER (PARTITION BY key ORDER BY CASE {_BEAT} WHEN 'hook' THEN 1 WHEN 'development' THEN 2 WHEN 'climax' THEN 3 WHEN 'resolution' THEN 4 ELSE 5 END, start_ms, value DESC, id)::INTEGER AS place FROM span")
def narrative_flow(s, d):
    return ranking.strategy_order(_beats(s, d), ["key"], "narrative_flow", score="value").select("id", "place")


@query("o6_balanced", _PLAN + ", m AS (SELECT *, max(end_ms - 1704067200000) OVER (PARTITION BY key) AS last FROM span) SELECT id, row_number() OVER (PARTITION BY key ORDER BY value * 0.8 + (1.0 - (start_ms - 1704067200000) / last * 0.2) * 0.2 DESC, id)::INTEGER AS place FROM m")
def balanced(s, d):
    x = table(s, d, "span").withColumns({"start_ms": F.col("start_ms") - 1704067200000, "end_ms": F.col("end_ms") - 1704067200000})
    return ranking.strategy_order(x, ["key"], "premium_quality", score="value").select("id", "place")


@query("o7_balanced_beats", _PLAN + f", n AS (SELECT *, {_BEAT} AS b, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key, {_BEAT} ORDER BY value DESC, start_ms, id) AS r FROM span), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start_ms, id) AS p FROM n WHERE n <= 6 OR r <= 2) SELECT key, id, b AS beat_type FROM f WHERE n <= 6 OR p <= 6")
def balanced_beats(s, d):
    return ranking.balanced_beats(_beats(s, d), ["key"], confidence="value").select("key", "id", "beat_type")


@query("o8_diversified", _PLAN + ", g AS (SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY value DESC, id) > 1 AS later FROM span), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY later, value DESC, id) AS r FROM g) SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY start_ms, id)::INTEGER AS place FROM r WHERE r <= 7")
def diversified(s, d):
    return ranking.diversified(table(s, d, "span"), ["key"], "kind", "value", "start_ms", "id", 7).select("key", "id", "place")


@query("o11_duration_budget", _PLAN + "SELECT key, id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value DESC, id) AS r FROM span) WHERE r <= 6")
def duration_budget(s, d):
    return ranking.duration_budget(table(s, d, "span"), ["key"], "value", "id", 20.0).select("key", "id")


@query("o12_edit_plans", _PLAN + """, b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value DESC, id) AS r FROM span)
SELECT key, '{"version":"1.0","actions":[' || string_agg('{"type":"cut","start_ms":' || (k * 1000) || ',"end_ms":' || (k * 1000 + 5000) || ',"score":' || (value)::VARCHAR || '}', ',' ORDER BY value DESC, id) || ']}' AS plan FROM b WHERE r <= 5 GROUP BY key""")
def edit_plans(s, d):
    x = table(s, d, "span").select("key", "id", "value", F.col("k").cast("double").alias("start"), (F.col("k") + 5.0).alias("end"))
    return ranking.plan_json(x, ["key"], score="value")


@query("o20_round_robin", _PLAN + "SELECT id, ['bottom', 'top', 'middle'][(row_number() OVER (PARTITION BY key ORDER BY start_ms, id) - 1) % 3 + 1] AS position FROM span")
def round_robin(s, d):
    i = F.row_number().over(Window.partitionBy("key").orderBy("start_ms", "id")) - 1
    return table(s, d, "span").select("id", F.get(F.array(F.lit("bottom"), F.lit("top"), F.lit("middle")), i % 3).alias("position"))


@query("o9_greedy_apart")
def greedy_apart(s, d):
    return ranking.greedy_apart(table(s, d, "span"), ["key"], "value", "start_ms", "end_ms", "id", seconds=36000000, most=8)


@query("o17_greedy_gap")
def greedy_gap(s, d):
    return ranking.greedy_gap(table(s, d, "span"), ["key"], "value", "start_ms", "id", 86400000, 10)


@query("o14_interleave")
def interleave(s, d):
    return ranking.interleave(_beats(s, d).withColumn("is_beat", F.col("value") > 120), ["key"])


@query("o16_match_arc")
def match_arc(s, d):
    x = table(s, d, "span").withColumn("emotion", F.col("k") / 50.0 - 1)
    return ranking.match_arc(x, ["key"], "emotion", ["start_ms", "id"])


# --- event time ---


@query("t1_counter_rate", cte("span") + """, s AS (SELECT key, start_ms // 1000 AS t, k, lag(k) OVER (PARTITION BY key ORDER BY start_ms) AS p FROM span), x AS (SELECT key, t // 86400 AS bucket, CASE WHEN p IS NULL THEN 0 WHEN k < p THEN k ELSE k - p END AS d FROM s)
SELECT key, bucket, round(sum(d) / 86400.0, 10) AS rate FROM x GROUP BY 1, 2""")
def counter_rate(s, d):
    x = table(s, d, "span").select("key", (F.col("start_ms") / 1000.0).alias("t"), "k")
    return _d(stateful.counter_rate(x, ["key"], "t", "k", 86400), "rate", digits=10)


@query("t2_held_alerts", cte("span") + """, a AS (SELECT *, value > 15 AND NOT coalesce(lag(value > 15) OVER (PARTITION BY key ORDER BY start_ms), false) AS n FROM span), g AS (SELECT *, sum(n::INT) OVER (PARTITION BY key ORDER BY start_ms) AS sp FROM a), f AS (SELECT *, min(start_ms) OVER (PARTITION BY key, sp) AS since FROM g WHERE value > 15)
SELECT key, since, min(start_ms) FILTER (start_ms - since >= 21600000) AS fired_at, max(start_ms) AS last_at FROM f GROUP BY key, since HAVING min(start_ms) FILTER (start_ms - since >= 21600000) IS NOT NULL""")
def held_alerts(s, d):
    return stateful.held_alerts(table(s, d, "span").withColumn("hot", F.col("value") > 15), ["key"], "start_ms", "hot", 21600000)


@query("t4_alerts", cte("span") + """, s AS (SELECT id, CASE WHEN k > 95 THEN 'OPEN' ELSE 'CLOSED' END AS state, value / 100 AS success_rate, k AS queue_size, 100 AS capacity, value AS cost_per_minute, 100.0 AS cost_limit, k % 10 AS available_tokens FROM span)
SELECT id, alert, severity FROM (SELECT id, unnest(list_filter([CASE WHEN state = 'OPEN' THEN {'alert': 'circuit_breaker_open', 'severity': 'critical'} END, CASE WHEN success_rate < 0.5 THEN {'alert': 'high_failure_rate', 'severity': 'high'} END, CASE WHEN queue_size / capacity > 0.8 THEN {'alert': 'queue_backup', 'severity': 'medium'} END,
  CASE WHEN cost_per_minute > 150 THEN {'alert': 'cost_spike', 'severity': 'high'} END, CASE WHEN available_tokens < 2 THEN {'alert': 'low_tokens', 'severity': 'low'} END], lambda x: x IS NOT NULL), recursive := true) FROM s)""")
def alert_rules(s, d):
    x = table(s, d, "span").select("id", F.when(F.col("k") > 95, "OPEN").otherwise("CLOSED").alias("state"), (F.col("value") / 100).alias("success_rate"), F.col("k").alias("queue_size"), F.lit(100).alias("capacity"), F.col("value").alias("cost_per_minute"), F.lit(100.0).alias("cost_limit"), (F.col("k") % 10).alias("available_tokens"))
    return stateful.alerts(x).select("id", "alert", "severity")


@query("t8_queue_order", cte("span") + ", f AS (SELECT * FROM span WHERE 1706572800000 - start_ms <= 86400000) SELECT id, row_number() OVER (PARTITION BY key ORDER BY kind, start_ms, id)::INTEGER AS place FROM f")
def queue_order(s, d):
    return stateful.queue_order(table(s, d, "span"), ["key"], "kind", "start_ms", 1706572800000, 86400000).select("id", "place")


@query("t11_engagement", "SELECT variant, count(*) AS total_events, count(*) FILTER (event_type = 'ping') AS pings, count(*) FILTER (event_type = 'completion') AS completions, count(DISTINCT job_id) AS jobs FROM (SELECT user_id AS job_id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS variant, CASE WHEN event_type = 'purchase' THEN 'completion' WHEN event_type = 'error' THEN 'other' ELSE 'ping' END AS event_type FROM events) GROUP BY 1")
def engagement(s, d):
    kind = F.when(F.col("event_type") == "purchase", "completion").when(F.col("event_type") == "error", "other").otherwise("ping")
    return stateful.engagement(source(s, d, "events").select(F.col("user_id").alias("job_id"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("variant"), kind.alias("event_type")))


def _timed(s, d):
    return table(s, d, "span").select("key", "id", (F.col("start_ms") / 1000.0).alias("at"), (F.col("value") / 10).alias("amount"), (F.col("kind") != "error").alias("ok"), (F.col("k") > 35).alias("fine"))


@query("t5_token_bucket")
def token_bucket(s, d):
    return stateful.token_bucket(_timed(s, d), ["key"], "at", "amount", 20.0, 0.0003, burst=5.0)


@query("t6_circuit_breaker")
def circuit_breaker(s, d):
    return stateful.circuit_breaker(_timed(s, d), ["key"], "at", "fine", failures=3, recovery=7200.0)


@query("t3_cooldown")
def cooldown(s, d):
    return stateful.cooldown(_timed(s, d).where("NOT ok"), ["key"], "at", 172800.0)


@query("t10_budget_guard")
def budget_guard(s, d):
    return stateful.budget_guard(_timed(s, d), ["key"], "at", "amount", cap=100.0)


@query("t7_adaptive_interval")
def adaptive_interval(s, d):
    return stateful.adaptive_interval(_timed(s, d), ["key"], "at", "ok")


@query("f15_srt_times", cte("span") + "SELECT id, printf('%02d:%02d:%02d,%03d', (start_ms % 86400000) // 3600000, (start_ms % 3600000) // 60000, (start_ms % 60000) // 1000, start_ms % 1000) AS at FROM span")
def srt_times(s, d):
    return table(s, d, "span").select("id", srt_time(F.col("start_ms") % 86400000).alias("at"))


@query("r11_track_score", cte("span") + "SELECT id, round(least(k / 100.0 * CASE WHEN kind = 'view' THEN 1.2 ELSE 1 END * CASE WHEN value BETWEEN 10 AND 20 THEN 1.1 ELSE 1 END * CASE WHEN value < 5 THEN 0.8 WHEN value > 30 THEN 0.9 ELSE 1 END, 1.0), 6) AS score FROM span")
def track_score(s, d):
    kind = F.when(F.col("kind") == "view", "face").otherwise("other")
    return table(s, d, "span").select("id", F.round(scoring.track_score(F.col("k") / 100.0, kind, F.col("value")), 6).alias("score"))


@query("r13_visual_interest", cte("span") + "SELECT id, round(least((k % 6) / 3.0, 1.0) * 0.4 + least(value / 100, 1.0) * 0.3 + 1.0 - abs(k * 2.5 - 128) / 128 * 0.2 + CASE WHEN k % 6 > 0 THEN 0.1 ELSE 0 END, 10) AS interest, round((1.0 - abs(k * 2.5 - 128) / 128 + least(value / 80, 1.0)) / 2, 10) AS composition FROM span")
def visual_interest(s, d):
    faces, light, contrast = F.col("k") % 6, F.col("k") * 2.5, F.col("value")
    return table(s, d, "span").select("id", F.round(scoring.visual_interest(faces, F.lit(0), light, contrast), 10).alias("interest"), F.round(scoring.composition(light, contrast), 10).alias("composition"))


@query("i27_uniform_samples", "WITH v AS (SELECT o_orderkey AS id, o_totalprice / 100 AS d FROM orders), n AS (SELECT *, least(5, greatest(3, floor(d / 60)))::INT AS n FROM v), x AS (SELECT *, least(20.0, d / (n * 2)) AS len, unnest(range(1, n + 1)) AS sample FROM n), y AS (SELECT *, greatest(0, d / (n + 1) * sample - len / 2) AS s FROM x) SELECT id, sample::INT AS sample, round(s, 9) AS \"start\", round(least(s + len, d), 9) AS \"end\" FROM y")
def uniform_samples(s, d):
    v = source(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100).alias("duration"))
    return _d(iv.uniform_samples(v).select("id", "sample", "start", "end"), "start", "end", digits=9)


@query("i25_chunk_offsets", cte("span") + "SELECT id, round(value + k * 600, 4) AS at FROM span")
def chunk_offsets(s, d):
    return _d(iv.offset_chunks(table(s, d, "span").select("id", "k", F.col("value").alias("at")), "k", 600, "at").select("id", "at"), "at")


@query("i23_energy_round_robin", cte("span") + "SELECT id, printf('SPEAKER_%02d', (row_number() OVER (PARTITION BY key ORDER BY value, id) - 1) % 3) AS speaker FROM span")
def energy_round_robin(s, d):
    i = F.row_number().over(Window.partitionBy("key").orderBy("value", "id")) - 1
    return table(s, d, "span").select("id", F.format_string("SPEAKER_%02d", i % 3).alias("speaker"))


@query("i26_change_points", cte("span") + "SELECT id, greatest(0, start_ms - 2000) AS start_ms, start_ms + 10000 AS end_ms FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY key ORDER BY start_ms)) > 60 AS c FROM span) WHERE c")
def change_points(s, d):
    w = Window.partitionBy("key").orderBy("start_ms")
    x = table(s, d, "span").withColumn("c", F.abs(F.col("value") - F.lag("value").over(w)) > 60).where("c")
    return x.select("id", F.greatest(F.lit(0), F.col("start_ms") - 2000).alias("start_ms"), (F.col("start_ms") + 10000).alias("end_ms"))
