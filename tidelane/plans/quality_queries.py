"""Queries of gates, speakers and story structure, and of operators that other queries use in passing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelane.functions import lexicons as lex
from tidelane.functions import scoring
from tidelane.functions.text import well_formed
from tidelane.operators import highlights as hl
from tidelane.operators import intervals as iv
from tidelane.operators import narrative, quality, speakers, tracks
from tidelane.operators import relational as rel
from tidelane.plans.registry import query
from tidelane.plans.relational_queries import AS_OF, _d
from tidelane.plans.text_queries import _cases, _CLEAN, _scored, _stream, _words_sql
from tidelane.sources import files
from tidelane.sources.tables import cte, source, table
from tidelane.storage import scratch


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- gates ---

_MEDIA = [
    "o_orderkey AS id", "o_totalprice / 20 - 100 AS duration", "CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1920 WHEN 2 THEN 3840 WHEN 3 THEN 7680 ELSE 1280 END AS width", "CASE o_orderkey % 4 WHEN 0 THEN 1080 WHEN 1 THEN 2160 WHEN 2 THEN 4320 ELSE 720 END AS height",
    "o_orderkey % 7 * 25 - 25 AS fps", "CASE o_orderkey % 4 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' WHEN 2 THEN 'prores' ELSE 'vp9' END AS codec", "CASE WHEN o_orderkey % 11 = 0 THEN 'bt2020nc' ELSE 'bt709' END AS color_space", "CASE WHEN o_orderkey % 13 = 0 THEN 'smpte2084' END AS color_transfer",
    "o_orderkey % 3 <> 0 AS has_audio", "CASE o_orderkey % 2 WHEN 0 THEN 'aac' ELSE 'ac3' END AS audio_codec",
]


@query("p14_metadata_errors", f"""WITH m AS (SELECT {', '.join(_MEDIA)} FROM orders) SELECT id, list_filter([CASE WHEN duration <= 0 THEN 'Invalid duration' WHEN duration > 7200 THEN 'Video duration exceeds 2 hours limit' END,
  CASE WHEN width = 0 OR height = 0 THEN 'Invalid resolution' WHEN width > 3840 OR height > 2160 THEN 'Resolution exceeds 4K limit' END, CASE WHEN fps <= 0 THEN 'Invalid frame rate' WHEN fps > 120 THEN 'Frame rate exceeds 120fps limit' END,
  CASE WHEN codec NOT IN ({_listed(quality.VIDEO_CODECS)}) THEN 'Unsupported video codec: ' || codec END, CASE WHEN color_space IN ({_listed(quality.HDR_SPACES)}) OR coalesce(color_transfer IN ({_listed(quality.HDR_TRANSFERS)}), false) THEN 'HDR input not supported' END,
  CASE WHEN has_audio AND audio_codec NOT IN ({_listed(quality.AUDIO_CODECS)}) THEN 'Unsupported audio codec: ' || audio_codec END], lambda x: x IS NOT NULL) AS errors FROM m""")
def metadata_errors(s, d):
    return source(s, d, "orders").selectExpr(*_MEDIA).select("id", quality.metadata_errors().alias("errors"))


#: Highlights of conversations: some empty, some with repeated words, of odd lengths, and with few levels of energy.
_HIGHLIGHT = ["conv_id", "turn", "CASE WHEN turn % 6 = 5 THEN '' WHEN turn % 4 = 1 THEN concat('Then then, ', text) ELSE text END AS text", "turn * 10000 AS start_ms", "turn * 10000 + (length(text) % 40 - 2) * 1000 AS end_ms", "CASE WHEN turn % 7 <> 6 THEN CAST(length(text) % (1 + conv_id % 3) AS DOUBLE) / 10 END AS audio_energy"]
_ISSUES = f"""h AS (SELECT {', '.join(_HIGHLIGHT)} FROM conversations WHERE role = 'user'), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, {_words_sql()} AS w, (end_ms - start_ms) / 1000.0 AS sec FROM h),
k AS (SELECT *, list_transform(w, lambda x: {_CLEAN}) AS k FROM n), p AS (SELECT *, list_filter(range(1, len(w)), lambda j: k[j] = k[j + 1])[1] AS j FROM k),
own AS (SELECT conv_id, i::INTEGER AS place, unnest(list_filter([CASE WHEN text = '' THEN 'Highlight ' || i || ' has empty text' WHEN j IS NOT NULL THEN 'Highlight ' || i || ' contains duplicate words: ''' || w[j] || ' ' || w[j + 1] || '''' END,
  CASE WHEN start_ms >= end_ms THEN 'Highlight ' || i || ' has invalid timing: start ' || start_ms || ' >= end ' || end_ms END, CASE WHEN sec < 3 THEN 'Highlight ' || i || printf(' too short: %.1fs < 3.0s minimum', sec::DOUBLE) WHEN sec > 30 THEN 'Highlight ' || i || printf(' too long: %.1fs > 30.0s maximum', sec::DOUBLE) END], lambda x: x IS NOT NULL)) AS issue FROM p),
keys AS (SELECT DISTINCT conv_id FROM conversations), g AS (SELECT conv_id, count(*) AS n, count(audio_energy) AS e, count(DISTINCT printf('%.3f', audio_energy)) AS u, arg_min(audio_energy, turn) FILTER (audio_energy IS NOT NULL) AS f FROM h GROUP BY 1),
sets AS (SELECT conv_id, NULL::INTEGER AS place, unnest(list_filter([CASE WHEN n IS NULL THEN 'No highlights generated' WHEN n < 2 THEN printf('Insufficient highlights: %d < 2 minimum', n) END,
  CASE WHEN e > 0 AND u = 1 THEN 'All highlights have identical audio energy: ' || f WHEN e > 0 AND u < e * 0.7 THEN printf('Low audio energy diversity: %d/%d unique values', u, e) END], lambda x: x IS NOT NULL)) AS issue FROM keys LEFT JOIN g USING (conv_id)),
hi AS (SELECT * FROM own UNION ALL SELECT * FROM sets)"""


def _highlight_issues(s, d):
    c = source(s, d, "conversations")
    rows = c.where("role = 'user'").selectExpr(*_HIGHLIGHT)
    return quality.highlight_issues(rows, ["conv_id"], ["turn"], c)


@query("r17_highlight_issues", f"WITH {_ISSUES} SELECT * FROM hi")
def highlight_issues(s, d):
    return _highlight_issues(s, d)


_FILES = ["conv_id", "kind", "CASE kind WHEN 'video' THEN concat('v', conv_id, '.mp4') ELSE concat('s', conv_id, '.srt') END AS path", "CASE kind WHEN 'video' THEN CASE conv_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 1000 ELSE 5000000 END ELSE CASE conv_id % 3 WHEN 0 THEN 10 WHEN 1 THEN NULL ELSE 100 END END AS size"]


@query("r17_gate", f"""WITH {_ISSUES}, t AS (SELECT conv_id, sum(len({_words_sql()})) AS w, count(*) * 40 AS turns FROM conversations GROUP BY 1), ti AS (SELECT conv_id, unnest(list_filter([CASE WHEN w < 100 THEN printf('Insufficient transcription: %d words < 100 minimum', w::BIGINT) END, CASE WHEN turns > 200 THEN printf('Excessive speaker turns: %d > 200 (over-segmentation)', turns) END], lambda x: x IS NOT NULL)) AS issue FROM t),
f AS (SELECT {', '.join(_FILES)} FROM keys, (SELECT unnest(['video', 'subtitle']) AS kind)), fi AS (SELECT conv_id, CASE WHEN kind = 'video' AND size IS NULL THEN 'Missing output video: ' || path WHEN kind = 'video' AND size < 1048576 THEN printf('Output video suspiciously small: %d bytes', size) WHEN kind <> 'video' AND size IS NULL THEN 'Missing subtitle file: ' || path WHEN kind <> 'video' AND size < 50 THEN printf('Subtitle file suspiciously small: %s (%d bytes)', path, size) END AS issue FROM f),
a AS (SELECT conv_id, issue FROM hi UNION ALL SELECT conv_id, issue FROM ti UNION ALL SELECT conv_id, issue FROM fi WHERE issue IS NOT NULL UNION ALL SELECT conv_id, 'Timeline generation failed' FROM keys WHERE conv_id % 17 = 0),
c AS (SELECT conv_id, count(issue) AS issues, count(*) FILTER (regexp_matches(issue, '{'|'.join(quality.CRITICAL)}')) AS critical FROM keys LEFT JOIN a USING (conv_id) GROUP BY 1) SELECT *, CASE WHEN critical > 0 THEN 'failed' WHEN issues > 0 THEN 'flawed' ELSE 'valid' END AS outcome FROM c""")
def pipeline_gate(s, d):
    c = source(s, d, "conversations")
    t = c.groupBy("conv_id").agg(F.sum(F.size(F.filter(F.split("text", r"[ \t\n\r\f\x0b]+"), lambda x: x != ""))).alias("word_count"), (F.count(F.lit(1)) * 40).alias("speaker_turns"))
    keys = c.select("conv_id").distinct()
    f = keys.select("conv_id", F.explode(F.array(F.lit("video"), F.lit("subtitle"))).alias("kind")).selectExpr(*_FILES)
    failed = keys.where("conv_id % 17 = 0").select("conv_id", F.lit("Timeline generation failed").alias("issue"))
    issues = _highlight_issues(s, d).select("conv_id", "issue").unionByName(quality.transcript_issues(t, ["conv_id"])).unionByName(quality.file_issues(f, ["conv_id"])).unionByName(failed)
    return quality.gate(keys, issues, ["conv_id"])


@query("r17_cue_issues", cte("span") + """, c AS (SELECT *, lead(start_ms) OVER (PARTITION BY key ORDER BY start_ms, id) AS after, row_number() OVER (PARTITION BY key ORDER BY start_ms, id) AS cue FROM (SELECT key, id, start_ms, start_ms + (k - 10) * 100000 AS end_ms FROM span))
SELECT key, cue::INTEGER AS cue, unnest(list_filter([CASE WHEN start_ms >= end_ms THEN 'Invalid timing' END, CASE WHEN end_ms > after THEN 'Timing overlap' END], lambda x: x IS NOT NULL)) AS issue FROM c""")
def cue_issues(s, d):
    x = table(s, d, "span").select("key", "start_ms", (F.col("start_ms") + (F.col("k") - 10) * 100000).alias("end_ms"), F.row_number().over(Window.partitionBy("key").orderBy("start_ms", "id")).alias("cue"))
    return files.subtitle_issues(x, ["key"])


# --- speakers ---

_PHRASES = ["thank you for having me, great question", "welcome, today we talk of research and data", "the key is a story of health", "research shows that the market has growth", "how do you learn software", "you can do it, amazing and perfect", "a terrible problem of money", "plain words"]
_TALK = ["conv_id", "turn", "role AS speaker", f"concat(element_at(array({_listed(_PHRASES)}), CAST((conv_id * 3 + turn) % 8 AS INT) + 1), ' ', text) AS text", "turn * 30000 AS start_ms", "turn * 30000 + length(text) % 300 * 100 AS end_ms", "CAST((length(text) + conv_id) % 10 AS DOUBLE) / 10 AS energy_level"]
_TALK_SQL = "t AS (SELECT " + ", ".join(_TALK).replace("element_at(array(", "list_extract(list_value(") + " FROM conversations), l AS (SELECT *, lower(text) AS low FROM t)"


def _talk(s, d):
    return source(s, d, "conversations").selectExpr(*_TALK)


_TREND = "CASE WHEN n < 2 THEN 0 WHEN n < 3 THEN max_by(energy_level, i) - min_by(energy_level, i) ELSE sum(energy_level) FILTER (i >= n - ceil(n / 3)) / (n // 3) - sum(energy_level) FILTER (i < n // 3) / (n // 3) END"
_FLOWS = f"""c AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS x FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), u AS (SELECT *, sum(x) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c),
v AS (SELECT *, count(*) OVER (PARTITION BY conv_id, run) AS n, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS i, coalesce({_cases(lex.TOPICS)}[1], 'general') AS tp FROM u),
f AS (SELECT conv_id, run::BIGINT AS run, min(speaker) AS speaker, min_by(start_ms, i) AS start_ms, max_by(end_ms, i) AS end_ms, min_by(tp, i) AS topic, avg(energy_level) AS avg_energy, {_TREND} AS ch FROM v GROUP BY conv_id, run, n),
fl AS (SELECT conv_id, run, speaker, start_ms, end_ms, topic, round(avg_energy, 8) AS avg_energy, end_ms - start_ms AS duration, CASE WHEN ch > 0.1 THEN 'rising' WHEN ch < -0.1 THEN 'falling' ELSE 'stable' END AS energy_trend FROM f)"""


@query("r24_flows", f"WITH {_TALK_SQL}, {_FLOWS} SELECT *, CASE WHEN duration < 10000 THEN 'brief_exchange' WHEN duration > 60000 THEN CASE WHEN avg_energy > 0.7 THEN 'passionate_monologue' ELSE 'detailed_explanation' END WHEN energy_trend = 'rising' THEN 'building_excitement' WHEN energy_trend = 'falling' THEN 'conclusion' ELSE 'steady_discussion' END AS flow_type FROM fl")
def flows(s, d):
    return _d(speakers.flows(_talk(s, d), "conv_id", ["turn"]), "avg_energy", digits=8)


_ROLES = list(lex.ROLES)
_PROFILES = f"""m AS (SELECT *, {_cases(lex.TOPICS)} AS tps, {_cases(lex.ROLES)} AS rls, {" + ".join(f"contains(low, '{w}')::INT" for w in lex.SENTIMENT[0])} AS plus, {" + ".join(f"contains(low, '{w}')::INT" for w in lex.SENTIMENT[1])} AS minus, len({_words_sql()}) AS wc FROM l),
rc AS (SELECT conv_id, speaker, r, count(*) AS n, min(turn) AS first, list_position([{_listed(_ROLES)}], r) AS o FROM (SELECT *, unnest(rls) AS r FROM m) GROUP BY 1, 2, 3), top AS (SELECT conv_id, speaker, r AS usual FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY n DESC, first, o) AS k FROM rc) WHERE k = 1),
has AS (SELECT conv_id, speaker, list(r) AS rs FROM rc GROUP BY 1, 2), a AS (SELECT conv_id, speaker, sum(wc)::BIGINT AS total_words, sum(end_ms - start_ms)::BIGINT AS speaking_time, avg(energy_level) AS avg_energy, var_pop(energy_level) AS vr, count(*) AS n, list_filter([{_listed(list(lex.TOPICS))}], lambda x: list_contains(flatten(list(tps)), x)) AS topics, sum(plus) AS plus, sum(minus) AS minus, min(turn) AS f FROM m GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN sum(speaking_time) OVER (PARTITION BY conv_id) = 0 THEN 0 ELSE speaking_time / sum(speaking_time) OVER (PARTITION BY conv_id) END AS dominance, CASE WHEN n < 2 THEN 1.0 ELSE (greatest(0, 1 - vr) + greatest(0, 1 - len(topics) / 10)) / 2 END AS consistency FROM a),
e AS (SELECT b.*, CASE WHEN list_has_any(coalesce(rs, []), ['host', 'interviewer']) THEN CASE WHEN dominance > 0.4 THEN 'host' ELSE 'interviewer' END WHEN list_contains(rs, 'expert') AND total_words > 500 THEN 'expert' WHEN list_contains(rs, 'guest') THEN 'guest' ELSE coalesce(usual, CASE WHEN dominance > 0.6 THEN 'primary_speaker' WHEN speaking_time > 60000 THEN 'main_character' ELSE 'supporting_character' END) END AS role,
  CASE WHEN plus > minus * 1.5 THEN 'positive' WHEN minus > plus * 1.5 THEN 'negative' ELSE 'neutral' END AS sentiment, (dominance > 0.3 AND consistency > 0.6 AND speaking_time > 30000) OR dominance > 0.6 AS an FROM b LEFT JOIN top USING (conv_id, speaker) LEFT JOIN has USING (conv_id, speaker)),
pr AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY an DESC, dominance DESC, f) AS pl FROM e)"""


@query("r24_speaker_profiles", f"WITH {_TALK_SQL}, {_PROFILES} SELECT conv_id, speaker, total_words, speaking_time, round(avg_energy, 8) AS avg_energy, topics, sentiment, round(dominance, 8) AS dominance, round(consistency, 8) AS consistency, role, CASE WHEN an AND pl <= 3 THEN pl::INTEGER END AS anchor FROM pr")
def speaker_profiles(s, d):
    return _d(speakers.profiles(_talk(s, d), "conv_id", ["turn"]), "avg_energy", "dominance", "consistency", digits=8)


@query("r24_relations", f"""WITH {_TALK_SQL}, q AS (SELECT *, {_cases(lex.TOPICS)} AS tps, lead(speaker) OVER w AS ns, lead(start_ms) OVER w AS nst, lead(energy_level) OVER w AS ne FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT conv_id, least(speaker, ns) AS a, greatest(speaker, ns) AS b, count(*) AS interactions, round(avg(nst - end_ms), 6) AS mean_gap, round(avg(ne - energy_level), 6) AS mean_change, list_filter([{_listed(list(lex.TOPICS))}], lambda x: list_contains(flatten(list(tps)), x)) AS topics FROM q WHERE speaker <> ns GROUP BY 1, 2, 3)
SELECT *, CASE WHEN interactions < 2 THEN 'minimal' WHEN mean_gap < 1000 THEN CASE WHEN mean_change > 0.1 THEN 'dynamic_conversation' ELSE 'collaborative_discussion' END WHEN interactions > 5 THEN 'structured_interview' ELSE 'casual_exchange' END AS relation FROM a""")
def relations(s, d):
    return speakers.relations(_talk(s, d), "conv_id", ["turn"])


@query("r20_continuity", f"WITH {_TALK_SQL}, {_FLOWS}, {_PROFILES} SELECT conv_id, round((least(1.0, 2 / n) + c + least(1.0, fc / 10)) / 3, 8) AS continuity FROM (SELECT conv_id, count(*) AS n, avg(consistency) AS c FROM pr GROUP BY 1) JOIN (SELECT conv_id, count(*) FILTER (duration > 5000) AS fc FROM fl GROUP BY 1) USING (conv_id)")
def continuity(s, d):
    talk = _talk(s, d)
    return _d(speakers.continuity(speakers.profiles(talk, "conv_id", ["turn"]), speakers.flows(talk, "conv_id", ["turn"]), "conv_id"), "continuity", digits=8)


@query("i21_split_monologues")
def split_monologues(s, d):
    x = table(s, d, "span").select("key", "id", F.when(F.col("k") < 90, "SPEAKER_00").otherwise("SPEAKER_01").alias("speaker"), (F.col("start_ms") / 3600000.0).alias("start"), (F.col("start_ms") / 3600000.0 + F.col("k") / 10).alias("end"), F.col("value").alias("energy"))
    return tracks.split_monologues(x, ["key"])


# --- story ---


@query("r21_structure_scores", cte("span") + """, b AS (SELECT key, id, start_ms, value / 100 AS score, CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS o, k FROM span WHERE kind IN ('view', 'click', 'purchase')),
x AS (SELECT *, coalesce(lag(start_ms) OVER (PARTITION BY key ORDER BY o, CASE WHEN key % 2 = 0 THEN id ELSE k::BIGINT * 100000000 + id END) > start_ms, false) AS dn FROM b), a AS (SELECT key, bool_or(dn) AS dn, count(*) FILTER (o = 1) AS h, count(*) FILTER (o = 2) AS c, count(*) FILTER (o = 3) AS r, (coalesce(avg(score) FILTER (o = 1), 0) + coalesce(avg(score) FILTER (o = 2), 0) + coalesce(avg(score) FILTER (o = 3), 0)) / 3 AS q, ((count(*) FILTER (o = 1) > 0)::INT + (count(*) FILTER (o = 2) > 0)::INT + (count(*) FILTER (o = 3) > 0)::INT) / 3 AS sh FROM x GROUP BY 1)
SELECT key, round(sh * 0.4 + CASE WHEN dn THEN 0.7 ELSE 1.0 END * 0.3 + q * 0.3, 8) AS coherence, round(least(1.0, sh + CASE WHEN c >= 2 THEN 0.1 ELSE 0 END + CASE WHEN h > 0 AND r > 0 THEN 0.1 ELSE 0 END), 8) AS completeness FROM a""")
def structure_scores(s, d):
    kind = F.when(F.col("kind") == "view", "hook").when(F.col("kind") == "click", "climax").otherwise("resolution")
    x = table(s, d, "span").where("kind IN ('view', 'click', 'purchase')")
    place = F.when(F.col("key") % 2 == 0, F.col("id")).otherwise(F.col("k").cast("long") * 100000000 + F.col("id"))
    return _d(narrative.structure_scores(x.select("key", kind.alias("kind"), "start_ms", (F.col("value") / 100).alias("score"), place.alias("place")), "key", "place"), "coherence", "completeness", digits=8)


@query("j20_merged_titles", f"""WITH g AS (SELECT conv_id, turn AS id, turn * 10000 AS start_ms, text, (length(text) % 10)::DOUBLE AS score FROM conversations), h AS (SELECT conv_id, turn::INTEGER AS place, left(text, 12) AS title, list_distinct({_words_sql()}[1:4]) AS kw, CASE turn % 4 WHEN 0 THEN 'hook' WHEN 1 THEN 'climax' WHEN 2 THEN 'development' ELSE 'other' END AS role FROM conversations),
p AS (SELECT g.*, h.place AS p, h.title, h.role, len(list_filter(kw, lambda x: contains(lower(text), lower(x)))) + CASE WHEN contains(lower(text), lower(title)) THEN 3 ELSE 0 END AS hits FROM h JOIN g USING (conv_id)), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, p ORDER BY hits DESC, id) AS r FROM p WHERE hits > 0) WHERE r = 1),
e AS (SELECT conv_id, id, start_ms, score + CASE role WHEN 'hook' THEN 8 WHEN 'climax' THEN 6 WHEN 'development' THEN 4 ELSE 2 END AS score, title, role, p FROM m), k AS (SELECT conv_id, list_distinct(flatten(list(kw))) AS ks FROM h GROUP BY 1),
o AS (SELECT g.conv_id, g.id, g.start_ms, g.score + least(len(list_filter(ks, lambda x: contains(lower(text), lower(x)))) * 1.5, 4) AS score, NULL AS title, NULL AS role, NULL AS p FROM g JOIN k USING (conv_id) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.conv_id = g.conv_id AND m.start_ms = g.start_ms)), a AS (SELECT * FROM e UNION ALL SELECT * FROM o)
SELECT conv_id, id, start_ms, score, title, role, row_number() OVER (PARTITION BY conv_id ORDER BY NOT coalesce(role = 'hook', false), score DESC, p NULLS LAST, id)::INTEGER AS place FROM a""")
def merged_titles(s, d):
    c = source(s, d, "conversations")
    role = F.when(F.col("turn") % 4 == 0, "hook").when(F.col("turn") % 4 == 1, "climax").when(F.col("turn") % 4 == 2, "development").otherwise("other")
    words = F.filter(F.split("text", r"[ \t\n\r\f\x0b]+"), lambda x: x != "")
    titled = c.select("conv_id", F.col("turn").cast("int").alias("place"), F.substring("text", 1, 12).alias("title"), F.array_distinct(F.slice(words, 1, 4)).alias("keywords"), role.alias("role"))
    segments = c.select("conv_id", F.col("turn").alias("id"), (F.col("turn") * 10000).alias("start_ms"), "text", (F.length("text") % 10).cast("double").alias("score"))
    return narrative.merge_titled(segments, titled, "conv_id")


@query("i11_legacy_segments")
def legacy_segments(s, d):
    energy = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((F.col("conv_id") + i) % 10) / 10.0)
    return hl.legacy_segments(_stream(s, d), ["conv_id"], energy)


_SAID = "CASE kind WHEN 'view' THEN 'an amazing key question' WHEN 'click' THEN 'the first and best answer' WHEN 'signup' THEN 'wow, great show' ELSE 'nothing' END"


@query("r12_director_scores", cte("span") + f""", w AS (SELECT key, start_ms, {_SAID} AS t FROM span), c AS (SELECT id, key, start_ms, value, k, kind FROM span WHERE kind = 'error'), j AS (SELECT c.id, {", ".join(f"bool_or(contains(w.t, '{x}')) AS b{i}" for i, x in enumerate(lex.AUDIO_KEYWORDS))}, count(w.t) AS n FROM c LEFT JOIN w ON c.key = w.key AND abs(w.start_ms - c.start_ms) < 1800000 GROUP BY 1),
s AS (SELECT c.*, CASE WHEN n = 0 THEN 0.3 ELSE least(({" + ".join(f"b{i}::INT" for i in range(len(lex.AUDIO_KEYWORDS)))}) / 5, 1.0) END AS audio, (1.0 - abs(k * 2.5 - 128) / 128 + least(value / 80, 1.0)) / 2 AS composition, CASE WHEN k % 6 = 0 THEN 0.2 ELSE least((k % 6) / 3, 1.0) * 0.5 + least(value / 100, 1.0) * 0.5 END AS subject FROM c JOIN j USING (id))
SELECT id, round(audio, 8) AS audio, round(least(value / 100, 1.0) * 0.3 + audio * 0.3 + composition * 0.2 + subject * 0.2, 8) AS total FROM s""")
def director_scores(s, d):
    x = table(s, d, "span")
    scenes = x.where("kind = 'error'")
    said = x.select("key", F.col("id").alias("other"), "start_ms", F.expr(_SAID).alias("t"))
    near = iv.within(scenes.select("id", "key", "start_ms"), said, "key", "start_ms", "start_ms", 1800000, ["other", "t"])
    heard = near.groupBy("id").agg(F.least(sum((F.max(F.contains("t", F.lit(w)).cast("int")) for w in lex.AUDIO_KEYWORDS), F.lit(0)) / 5, F.lit(1.0)).alias("audio"))
    rows = scenes.join(heard, "id", "left").withColumn("audio", F.coalesce("audio", F.lit(0.3)))
    total = scoring.composite(F.least(F.col("value") / 100, F.lit(1.0)), F.col("audio"), scoring.composition(F.col("k") * 2.5, F.col("value")), scoring.subject(F.col("k") % 6, F.col("value") / 100))
    return _d(rows.select("id", "audio", total.alias("total")), "audio", "total", digits=8)


# --- maintenance and sources ---


@query("s3_bulk_append", cte("job") + "SELECT status, count(*) AS n FROM (SELECT status FROM job UNION ALL SELECT 'imported' FROM customer) GROUP BY 1")
def bulk_append(s, d):
    new = source(s, d, "customer").select((-F.col("c_custkey")).alias("id"), F.lit("imported").alias("status"))
    return table(s, d, "job").select("id", "status").unionByName(new).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("d1_insert_returning", "SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_name DESC) AS o_orderkey, c_name FROM customer")
def insert_returning(s, d):
    return rel.insert_returning(source(s, d, "orders"), source(s, d, "customer").select("c_name"), "o_orderkey", [F.col("c_name").desc()]).select("o_orderkey", "c_name")


@query("t12_restored", f"""WITH c AS (SELECT user_id AS job, event_type AS stage, props AS data, ts, value < 20 AS hot FROM events), l AS (SELECT job, stage, max_by(data, ts) AS data FROM c WHERE hot AND ts + INTERVAL '5 days' > TIMESTAMP '{AS_OF}' GROUP BY 1, 2), s AS (SELECT job, stage, max_by(data, ts) AS data FROM c GROUP BY 1, 2)
SELECT s.job, s.stage, coalesce(l.data, s.data) AS data, CASE WHEN l.job IS NULL THEN 2 ELSE 1 END::INTEGER AS tier FROM s LEFT JOIN l ON s.job = l.job AND s.stage = l.stage""")
def restored(s, d):
    c = source(s, d, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), F.col("props").alias("data"), F.col("ts").cast("timestamp").alias("written_at"), "value")
    first = c.where("value < 20").withColumn("expires_at", F.col("written_at") + F.expr("INTERVAL 5 DAYS"))
    return rel.restore(first, c, ["job", "stage"], AS_OF)[0]


@query("u5_set_operations", "(SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'error') EXCEPT (SELECT user_id FROM events WHERE value > 350 UNION SELECT user_id FROM events WHERE value < 0.02)")
def set_operations(s, d):
    ids = lambda where: source(s, d, "events").where(where).select("user_id")
    return ids("event_type = 'view'").intersect(ids("event_type = 'error'")).exceptAll(ids("value > 350").union(ids("value < 0.02")).distinct())


@query("s5_json_documents", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_nationkey AS nation FROM customer")
def json_documents(s, d):
    path = scratch(s, "documents-json")
    source(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")).alias("account")).write.json(path)
    return files.read_json(s, path, "id bigint, name string, account struct<balance:double,nation:bigint>", lines=True).select("id", "name", "account.balance", "account.nation")


@query("s11_counts_csv", "SELECT l_returnflag || l_linestatus || ', \"' || l_linenumber || '\"' AS file, count(*) AS commit_count FROM lineitem GROUP BY 1")
def counts_csv(s, d):
    path = scratch(s, "counts-csv")
    c = source(s, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus", F.lit(', "'), F.col("l_linenumber").cast("string"), F.lit('"')).alias("file")).agg(F.count(F.lit(1)).alias("commit_count"))
    files.write_counts(c, path, "file", "commit_count")
    return files.read_counts(s, path)


@query("s12_exposition", "WITH m AS (SELECT event_type AS name, user_id % 3 AS shard, count(*) AS n FROM events GROUP BY 1, 2) SELECT name, 1 AS place, name || '{shard=\"' || shard || '\"} ' || n AS line FROM m UNION ALL SELECT DISTINCT name, 0, '# TYPE ' || name || ' counter' FROM m")
def exposition(s, d):
    m = source(s, d, "events").groupBy(F.col("event_type").alias("name"), (F.col("user_id") % 3).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return files.exposition(m, "name", "n", ["shard"], "counter")


@query("p3_durations", cte("segment") + "SELECT id, end_ms - start_ms AS duration FROM segment")
def durations(s, d):
    return table(s, d, "segment").withColumn("duration", F.col("end_ms") - F.col("start_ms")).select("id", "duration")


@query("p11_duration_range", cte("segment") + "SELECT id FROM segment WHERE end_ms - start_ms BETWEEN 3000 AND 30000")
def duration_range(s, d):
    return table(s, d, "segment").where((F.col("end_ms") - F.col("start_ms")).between(3000, 30000)).select("id")


@query("p15_identifiers", "SELECT c_custkey, regexp_full_match(n, '[a-zA-Z][a-zA-Z0-9_]{0,63}') AS ok FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '_') WHEN 2 THEN c_custkey || 'x' ELSE repeat('a', (60 + c_custkey % 10)::INT) END AS n FROM customer)")
def identifiers(s, d):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.col("c_name")).when(k % 4 == 1, F.replace("c_name", F.lit("#"), F.lit("_"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit("x"))).otherwise(F.repeat(F.lit("a"), (60 + k % 10).cast("int")))
    return source(s, d, "customer").select("c_custkey", well_formed(name, "identifier").alias("ok"))


@query("i5_closed_gaps", cte("span") + """, o AS (SELECT *, lead(start_ms) OVER (PARTITION BY key ORDER BY id) AS after FROM span) SELECT id, CASE WHEN coalesce(after - end_ms > 0 AND after - end_ms < 3600000 AND value > 5, false) THEN after - 100 ELSE end_ms END AS end_ms, kind || CASE WHEN coalesce(after - end_ms > 0 AND after - end_ms < 3600000 AND value > 5, false) THEN '_extended' ELSE '' END AS source FROM o""")
def closed_gaps(s, d):
    x = table(s, d, "span").select("key", "id", F.col("id").alias("place"), "start_ms", "end_ms", F.col("value").alias("total"), F.col("kind").alias("source"))
    return hl.close_small_gaps(x, ["key"], gap=3600000).select("id", "end_ms", "source")


@query("i3_stale_totals")
def stale_totals(s, d):
    parts = sum((F.col(p) for p in ("base", "energy", "visual", "clarity", "narrative", "uniqueness")), F.lit(0.0))
    m = hl.merge_payload(_scored(s, d), ["conv_id"])
    return m.select("conv_id", "start_ms", "source", F.round("total", 9).alias("total"), F.round(parts, 9).alias("parts"), "bonus")


@query("o10_boxes_apart")
def boxes_apart(s, d):
    x = table(s, d, "span").select("key", "id", (F.col("k") * 9).alias("x"), (F.col("start_ms") % 500).alias("y"), (20 + F.col("value").cast("int") % 60).alias("w"), (10 + F.col("k") % 50).alias("h"))
    return tracks.boxes_apart(x, ["key"])


@query("p12_score_threshold", cte("span") + "SELECT id, value / 10 AS total_score FROM span WHERE value / 10 >= 4.0")
def score_threshold(s, d):
    return table(s, d, "span").select("id", (F.col("value") / 10).alias("total_score")).where("total_score >= 4.0")


@query("d7_views", cte("job", "cost") + "SELECT j.status, count(DISTINCT j.id) AS jobs, sum(c.amount)::DOUBLE AS cost FROM job j JOIN cost c ON j.id = c.job_id GROUP BY 1")
def views(s, d):
    for name in ("job", "cost"):
        table(s, d, name).createOrReplaceTempView(f"tidelane_{name}")
    return s.sql("SELECT j.status, count(DISTINCT j.id) AS jobs, CAST(sum(c.amount) AS DOUBLE) AS cost FROM tidelane_job j JOIN tidelane_cost c ON j.id = c.job_id GROUP BY 1")
