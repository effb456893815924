"""Queries over subtitles, plans, tracks and speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelane.operators import highlights as hl
from tidelane.operators import tracks
from tidelane.plans import text_queries as tq
from tidelane.plans.registry import query
from tidelane.plans.timeline_queries import _words
from tidelane.sources import files
from tidelane.sources.tables import cte, source, table


def _subtitles(s, d):
    lines = hl.subtitle_lines(tq._stream(s, d).withColumn("clip_start", F.lit(0.0)), ["conv_id"])
    return files.to_srt(lines, ["conv_id"])


@query("s8_subtitle_texts")
def subtitle_texts(s, d):
    return _subtitles(s, d)


@query("s7_parsed_subtitles")
def parsed_subtitles(s, d):
    return files.parse_srt(_subtitles(s, d), ["conv_id"], "content")


@query("r17_subtitle_issues")
def subtitle_issues(s, d):
    """Subtitles of which some lines end before they begin, and some after the next begins."""
    lines = hl.subtitle_lines(tq._stream(s, d).withColumn("clip_start", F.lit(0.0)), ["conv_id"])
    wrong = F.when(F.col("line") % 4 == 1, F.col("start") - 0.25).when(F.col("line") % 4 == 2, F.col("end") + 30).otherwise(F.col("end"))
    faulty = files.to_srt(lines.withColumn("end", F.greatest(wrong, F.lit(0.0))), ["conv_id"])
    return files.subtitle_issues(files.parse_srt(faulty, ["conv_id"], "content"), ["conv_id"])


@query("s6_plan_errors", cte("span") + """SELECT id, list_filter([CASE WHEN k % 7 = 0 THEN 'missing render' END, CASE WHEN k % 7 = 0 THEN 'missing render.format' END, CASE WHEN k % 7 = 0 THEN 'missing render.codec' END, CASE WHEN k % 7 = 0 THEN 'missing render.crf' END, CASE WHEN k % 10 = 0 THEN 'action type' END,
  CASE WHEN k < 5 THEN 'negative time' END, CASE WHEN k > 90 THEN 'score range' END], lambda x: x IS NOT NULL) AS plan_errors FROM span""")
def plan_errors(s, d):
    k = F.col("k")
    kind = F.when(k % 10 == 0, "fade").otherwise("cut")
    render = F.when(k % 7 == 0, "").otherwise(',"render":{"format":"mp4","codec":"h264","crf":20}')
    plan = F.format_string('{"version":"1","source":"x","actions":[{"type":"%s","start_ms":%d,"end_ms":9,"score":%.3f}]%s}', kind, k - 5, k / 90.0, render)
    return files.parse_plans(table(s, d, "span").select("id", plan.alias("raw")), "raw").select("id", "plan_errors")


@query("s10_log_levels", "SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'svc' || user_id % 4 AS logger, count(*) AS n FROM events GROUP BY 1, 2")
def log_levels(s, d):
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.concat_ws(" | ", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss,SSS"), level, F.concat(F.lit("svc"), (F.col("user_id") % 4).cast("string")), F.col("props"))
    logs = files.parse_logs(source(s, d, "events").select(line.alias("value")))
    return logs.where("ts IS NOT NULL").groupBy("level", "logger").agg(F.count(F.lit(1)).alias("n"))


def _segments(s, d):
    return _words(s, d).select("key", F.col("pos").alias("id"), "speaker", "start", "end", "confidence")


@query("i19_merge_short")
def merge_short(s, d):
    return tracks.merge_short(_segments(s, d), ["key"], 30.0, 3600.0)


@query("w15_smooth_speakers")
def smooth_speakers(s, d):
    return tracks.smooth_speakers(_segments(s, d), ["key"], 3600.0)


def _boxes(s, d):
    return table(s, d, "span").select("key", "id", F.floor(F.col("start_ms") / 3600000).cast("long").alias("frame"), (F.col("k") * 3).alias("x"), (F.col("k") % 20).alias("y"), F.lit(60).alias("w"), F.lit(60).alias("h"))


@query("w14_smooth_crops")
def smooth_crops(s, d):
    return tracks.smooth_crops(_boxes(s, d).drop("frame").withColumnRenamed("id", "frame"), ["key"])


@query("j16_tracked_boxes")
def tracked_boxes(s, d):
    return tracks.track_boxes(_boxes(s, d), ["key"])


@query("i28_bridged_clips")
def bridged_clips(s, d):
    clips = table(s, d, "span").select("key", "id", "start_ms", "end_ms", F.when(F.col("kind") == "error", "climax").otherwise("development").alias("role"), (-F.col("k") * 100000 + F.col("id")).alias("place"))
    return tracks.bridge_gaps(clips, ["key"], "place")


@query("i22_two_speakers")
def two_speakers(s, d):
    x = table(s, d, "span").select("key", "id", "value", F.col("k").cast("double").alias("k"))
    return tracks.two_speakers(x, ["key"], ["value", "k"])


@query("i30_sentence_chunks")
def sentence_chunks(s, d):
    return tracks.pack_sentences(source(s, d, "documents"), ["doc_id"], "text", 500)


@query("i8_once_each", cte("span") + """, w AS (SELECT key, kind AS word, round(start_ms / 1000.0, 3) AS s, round(end_ms / 1000.0, 3) AS e, value AS confidence, row_number() OVER (PARTITION BY key, kind ORDER BY value DESC, start_ms) AS r FROM span) SELECT key, word, s AS "start", e AS "end", confidence FROM w WHERE r = 1""")
def once_each(s, d):
    w = tracks.once_each(_words(s, d), ["key"])
    return w.withColumns({"start": F.round("start", 3), "end": F.round("end", 3)})


@query("i29_ten_second_buckets", "WITH w AS (SELECT user_id AS key, epoch_us(ts) // 36000000000 AS b, epoch_us(ts) AS t, event_type FROM events) SELECT key, b AS bucket, string_agg(event_type, ' ' ORDER BY t) AS text FROM w GROUP BY 1, 2")
def ten_second_buckets(s, d):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = source(s, d, "events").select(F.col("user_id").alias("key"), F.floor(t / 36000000000).alias("bucket"), F.struct(t.alias("t"), "event_type").alias("w"))
    return e.groupBy("key", "bucket").agg(F.array_join(F.transform(F.sort_array(F.collect_list("w")), lambda x: x["event_type"]), " ").alias("text"))
