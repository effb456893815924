"""Queries over documents and conversations: text functions, rule scores and speakers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelane.functions import lexicons as lex
from tidelane.functions import scoring, text
from tidelane.operators import highlights as hl
from tidelane.operators import intervals as iv
from tidelane.operators import stories
from tidelane.plans.registry import query
from tidelane.plans.relational_queries import _d
from tidelane.sources.tables import source

_SPLIT = r"list_filter(regexp_split_to_array({}, '[ \t\n\r\f\x0b]+'), lambda x: x <> '')"


def _words_sql(column: str = "text") -> str:
    return _SPLIT.format(column)


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _present(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')::INT" for w in words) + ")"


@query("f1_word_counts", f"SELECT doc_id, len({_words_sql()}) AS words, length(text) AS chars FROM documents")
def word_counts(s, d):
    return source(s, d, "documents").select("doc_id", text.word_count("text").alias("words"), F.length("text").alias("chars"))


_CLEAN = r"regexp_replace(lower(x), '^[.,!?;:]+|[.,!?;:]+$', '', 'g')"


@query("f3_repeats_dropped", f"""WITH w AS (SELECT doc_id, {_words_sql()} AS w FROM documents), k AS (SELECT doc_id, w, list_transform(w, lambda x: {_CLEAN}) AS k FROM w)
SELECT doc_id, md5(array_to_string(list_filter(w, lambda x, i: NOT coalesce(i > 1 AND k[i] = k[i - 1] AND k[i] <> '', false)), ' ')) AS digest FROM k WHERE len(w) > 1""")
def repeats_dropped(s, d):
    return source(s, d, "documents").where(text.word_count("text") > 1).select("doc_id", F.md5(text.drop_repeats("text").cast("binary")).alias("digest"))


@query("f4_titles", f"""WITH w AS (SELECT doc_id, {_words_sql()}[1:6] AS w FROM documents), k AS (SELECT doc_id, w, list_transform(w, lambda x: {_CLEAN}) AS k FROM w),
t AS (SELECT doc_id, array_to_string(list_filter(w, lambda x, i: NOT coalesce(i > 1 AND k[i] = k[i - 1] AND k[i] <> '', false)), ' ') AS t FROM k) SELECT doc_id, CASE WHEN length(t) > 37 THEN t[1:37] || '...' ELSE t END AS title FROM t""")
def titles(s, d):
    return source(s, d, "documents").select("doc_id", text.title("text").alias("title"))


@query("f5_beat_titles", f"SELECT conv_id, turn, CASE WHEN length(t) > 40 THEN t[1:40] || '...' ELSE t END AS title FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Opening' WHEN 'assistant' THEN 'Key Insight' ELSE 'Segment' END || ': ' || array_to_string({_words_sql()}[1:4], ' ') AS t FROM conversations)")
def beat_titles(s, d):
    beat = F.when(F.col("role") == "user", "hook").when(F.col("role") == "assistant", "climax").otherwise("other")
    return source(s, d, "conversations").withColumn("beat", beat).select("conv_id", "turn", text.beat_title("beat", "text").alias("title"))


@query("a18_keywords", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+'), 1) AS pos FROM documents),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS pos FROM w WHERE length(word) > 3 AND word NOT IN ('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM c)
SELECT doc_id, rank::INTEGER AS rank, word, n FROM r WHERE rank <= 5""")
def keywords(s, d):
    return text.keywords(source(s, d, "documents"), "doc_id", "text")


@query("f6_masking")
def masking(s, d):
    masked = source(s, d, "documents").select("doc_id", "text", text.mask("text").alias("masked"))
    return masked.select("doc_id", F.col("masked").alias("text"), (F.col("masked") != F.col("text")).alias("changed"))


@query("u2_neighbour_jaccard", f"""WITH w AS (SELECT conv_id, turn, list_distinct({_words_sql('lower(text)')}) AS w, lead(list_distinct({_words_sql('lower(text)')})) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(w) = 0 OR len(n) = 0 THEN 0.0 ELSE len(list_intersect(w, n)) / len(list_distinct(list_concat(w, n))) END, 8) AS similarity FROM w WHERE n IS NOT NULL""")
def neighbour_jaccard(s, d):
    c = source(s, d, "conversations").withColumn("next_text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next_text IS NOT NULL")
    return c.select("conv_id", "turn", F.round(text.jaccard("text", "next_text"), 8).alias("similarity"))


_TURNS = "t AS (SELECT conv_id, turn, role, text, lower(text) AS low, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / greatest(count(*) OVER (PARTITION BY conv_id) - 1, 1) AS p FROM conversations) "


def _turns(s, d):
    return scoring.position_ratio(source(s, d, "conversations"), ["conv_id"], ["turn"], "p")


_BEAT_SQL = "CASE " + " ".join(f"WHEN {_any('low', w)} THEN '{b}'" for b, w in lex.BEAT_PHRASES.items()) + " WHEN p < 0.2 THEN 'setup' WHEN p < 0.4 THEN 'context' WHEN p < 0.7 THEN 'rising_action' ELSE 'falling_action' END"


@query("r5_story_beats", "WITH " + _TURNS + f"SELECT conv_id, turn, {_BEAT_SQL} AS beat FROM t")
def story_beats(s, d):
    return _turns(s, d).select("conv_id", "turn", scoring.story_beat(F.col("text"), F.col("p")).alias("beat"))


#: What turns are held to say, in turn, before their own text: words of beats in and out of their place, and plain ones.
_SAID = ["imagine the Background", "plain words", "an important question", "suddenly we found it", "in the end, remember", "it started when, at first", "you WON'T believe the summary", "because of a breakthrough", "what I learned finally"]
_QUOTED = ", ".join("'" + x.replace("'", "''") + "'" for x in _SAID)
_TOLD = f"u AS (SELECT conv_id, turn, p, lower(concat(list_extract(list_value({_QUOTED}), CAST((conv_id * 2 + turn) % {len(_SAID)} AS INT) + 1), ' ', text)) AS low FROM t)"


def _told(s, d):
    said = F.element_at(F.array(*map(F.lit, _SAID)), ((F.col("conv_id") * 2 + F.col("turn")) % len(_SAID) + 1).cast("int"))
    return _turns(s, d).withColumn("text", F.concat(said, F.lit(" "), "text"))


_BANDS = " ".join(f"WHEN {' AND '.join(x for x in (f'p >= {lo}' if lo is not None else '', f'p < {hi}' if hi is not None else '') if x)} AND {_any('low', w)} THEN " + "'{}|{}'".format(b, c) for b, (lo, hi, w, c) in lex.STORY_BANDS.items())


@query("r3_band_beats", "WITH " + _TURNS + f", {_TOLD}, b AS (SELECT conv_id, turn, CASE {_BANDS} END AS b FROM u) SELECT conv_id, turn, split_part(b, '|', 1) AS beat, split_part(b, '|', 2)::DOUBLE AS confidence FROM b WHERE b IS NOT NULL")
def band_beats(s, d):
    beat, sure = scoring.band_beat(F.col("text"), F.col("p"))
    return _told(s, d).select("conv_id", "turn", beat.alias("beat"), sure.alias("confidence")).where("confidence > 0.4")


_PATTERNS = ", ".join(f"CASE WHEN {_any('low', [w for w in words])} THEN '{b}' END" for b, words in lex.BEAT_PATTERNS.items())


@query("r4_beat_patterns", "WITH " + _TURNS + f", {_TOLD} SELECT conv_id, turn, unnest(list_filter([{_PATTERNS}], lambda x: x IS NOT NULL)) AS beat FROM u")
def beat_patterns(s, d):
    low = F.lower("text")
    hits = F.array_compact(F.array(*[F.when(text.count_present(low, [w for w in words if w == w.lower()]) > 0, b) for b, words in lex.BEAT_PATTERNS.items()]))
    return _told(s, d).select("conv_id", "turn", F.explode(hits).alias("beat"))


@query("r6_polarity", f"WITH t AS (SELECT doc_id, {_present('lower(text)', lex.POLARITY[0])} AS p, {_present('lower(text)', lex.POLARITY[1])} AS n FROM documents) SELECT doc_id, CASE WHEN p + n = 0 THEN 0.0 ELSE round((p - n) / (p + n), 8) END AS polarity FROM t")
def polarity(s, d):
    return source(s, d, "documents").select("doc_id", F.round(scoring.polarity(F.col("text")), 8).alias("polarity"))


@query("r7_feelings", "SELECT * FROM (SELECT doc_id, CASE " + " ".join(f"WHEN {_any('lower(text)', w)} THEN '{f}'" for f, w in lex.FEELINGS.items()) + " END AS feeling FROM documents) WHERE feeling IS NOT NULL")
def feelings(s, d):
    return source(s, d, "documents").select("doc_id", scoring.first_match(F.col("text"), lex.FEELINGS).alias("feeling")).where("feeling IS NOT NULL")


_TENSION = f"CASE WHEN {_any('low', lex.TENSION)} THEN least(b + 0.2, 1.0) ELSE b END"


@query("r8_tension", "WITH " + _TURNS + f", b AS (SELECT *, CASE WHEN p < 0.2 THEN 0.2 WHEN p < 0.7 THEN 0.2 + (p - 0.2) * 1.6 ELSE 1.0 - (p - 0.7) * 1.5 END AS b FROM t) SELECT conv_id, turn, round({_TENSION}, 8) AS tension FROM b")
def tension(s, d):
    return _turns(s, d).select("conv_id", "turn", F.round(scoring.tension(F.col("text"), F.col("p")), 8).alias("tension"))


@query("r9_boosted", "WITH " + _TURNS + f"SELECT conv_id, turn, round(least(p + CASE role WHEN 'user' THEN 0.2 WHEN 'assistant' THEN 0.15 ELSE 0 END + CASE WHEN {_any('low', lex.SUPERLATIVES)} THEN 0.1 ELSE 0 END + CASE WHEN contains(text, '?') THEN 0.05 ELSE 0 END, 1.0), 8) AS score FROM t")
def boosted(s, d):
    beat = F.when(F.col("role") == "user", "hook").when(F.col("role") == "assistant", "climax")
    return _turns(s, d).select("conv_id", "turn", F.round(scoring.boosted(F.col("p"), F.coalesce(beat, F.lit("x")), F.col("text")), 8).alias("score"))


_BOOSTS = " + ".join(f"CASE WHEN {_any('low', w)} THEN {b} ELSE 0 END" for w, b in lex.SCENE_BOOSTS)


@query("r10_scene_importance", "WITH " + _TURNS + f", x AS (SELECT *, (length(text) % 10) / 10.0 + {_BOOSTS} + 0.05 AS r, length(text) / 15.0 AS d FROM t), y AS (SELECT *, r * CASE WHEN d < 5 THEN 0.8 WHEN d > 30 THEN 0.9 ELSE 1 END + CASE WHEN p < 0.2 OR p > 0.8 THEN 0.05 ELSE 0 END AS i FROM x) SELECT conv_id, turn, round(least(i, 1.0), 8) AS importance, CASE WHEN round(i, 8) > 0.8 THEN 'key moment' WHEN round(i, 8) > 0.6 THEN 'important' WHEN round(i, 8) > 0.4 THEN 'relevant' ELSE 'context' END AS reason FROM y")
def scene_importance(s, d):
    importance, _ = scoring.scene_importance((F.length("text") % 10).cast("double"), F.col("text"), F.lit(0.5), F.length("text") / 15.0, F.col("p"))
    x = _turns(s, d).select("conv_id", "turn", F.round(importance, 8).alias("importance"))
    i = F.col("importance")
    return x.withColumn("reason", F.when(i > 0.8, "key moment").when(i > 0.6, "important").when(i > 0.4, "relevant").otherwise("context"))


@query("r12_audio_keywords", f"SELECT doc_id, round(least({_present('lower(text)', lex.AUDIO_KEYWORDS)} / 5.0, 1.0), 8) AS score FROM documents")
def audio_keywords(s, d):
    return source(s, d, "documents").select("doc_id", F.round(scoring.audio_keywords(F.col("text")), 8).alias("score"))


@query("r15_contexts", "SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {_any('lower(text)', w)} THEN '{c}' END" for c, w in lex.CONTEXTS.items()) + "], lambda x: x IS NOT NULL) AS contexts FROM documents")
def contexts(s, d):
    return source(s, d, "documents").select("doc_id", scoring.contexts(F.col("text")).alias("contexts"))


@query("r16_caption_styles", f"SELECT conv_id, turn, CASE WHEN {_any('lower(text)', lex.EMPHASIS)} THEN 'emphasis' WHEN len({_words_sql()}) > 15 THEN 'minimal' ELSE 'default' END AS style FROM conversations")
def caption_styles(s, d):
    return source(s, d, "conversations").select("conv_id", "turn", scoring.caption_style(F.col("text")).alias("style"))


@query("r14_hashtag_scores", f"WITH h AS (SELECT doc_id, unnest({_words_sql()}) AS tag FROM documents), c AS (SELECT doc_id, tag, lower(trim(tag, '#')) AS c FROM h) SELECT doc_id, tag, CASE WHEN c IN ('fyp', 'viral', 'trending', 'foryou', 'explore', 'reels') THEN 3.0 ELSE 1.0 END * CASE WHEN length(c) > 20 THEN 0.5 ELSE 1.0 END + CASE WHEN length(c) BETWEEN 8 AND 15 THEN 0.5 ELSE 0 END AS score FROM c")
def hashtag_scores(s, d):
    h = source(s, d, "documents").select("doc_id", F.explode(text.split_words("text")).alias("tag"))
    return h.select("doc_id", "tag", scoring.hashtag_score(F.col("tag")).alias("score"))


def _intensity_sql(name: str) -> str:
    words, pattern, factors = lex.EMOTIONS[name]
    counts = " + ".join(f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)} * {factors.get(w, 1.0) * 0.3!r}" for w in words)
    return f"least(1.0, {counts} + len(regexp_extract_all(low, '(?i){pattern.replace(chr(39), chr(39) * 2)}')) * 0.5)"


_INTENSITIES = ", ".join(f"{_intensity_sql(n)} AS e_{n}" for n in lex.EMOTIONS)
_ALL = " + ".join(f"e_{n}" for n in lex.EMOTIONS)
_PLUS, _MINUS = ("(" + " + ".join(f"e_{n}" for n in g) + ")" for g in (lex.POSITIVE_EMOTIONS, lex.NEGATIVE_EMOTIONS))


@query("a21_emotions", f"WITH l AS (SELECT doc_id, lower(text) AS low FROM documents), e AS (SELECT doc_id, {_INTENSITIES} FROM l), m AS (SELECT *, greatest({', '.join(f'e_{n}' for n in lex.EMOTIONS)}) AS i, least(1.0, ({_ALL}) / 3.0) AS a, CASE WHEN {_PLUS} + {_MINUS} = 0 THEN 0.0 ELSE ({_PLUS} - {_MINUS}) / ({_PLUS} + {_MINUS}) END AS v FROM e) SELECT doc_id, CASE WHEN i > 0.1 THEN CASE " + " ".join(f"WHEN e_{n} = i THEN '{n}'" for n in lex.EMOTIONS) + " END ELSE 'neutral' END AS primary_emotion, round(i, 6) AS emotional_intensity, round(v, 6) AS valence, round(a, 6) AS arousal, round(least(1.0, i * 0.4 + a * 0.4 + abs(v) * 0.2), 6) AS engagement FROM m")
def emotions(s, d):
    out = scoring.emotions(source(s, d, "documents").select("doc_id", "text"), "text")
    return _d(out.select("doc_id", "primary_emotion", "emotional_intensity", "valence", "arousal", "engagement"), "emotional_intensity", "valence", "arousal", "engagement", digits=6)


def _regexes(patterns: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all(low, '(?i){p.replace(chr(39), chr(39) * 2)}'))" for p in patterns)


@query("r22_hooks", "WITH " + _TURNS + f", x AS (SELECT *, ({_regexes(lex.HOOKS)}) * 0.3 * CASE WHEN p < 0.3 THEN 3.0 WHEN p < 0.7 THEN 1.0 ELSE 0.5 END * CASE WHEN length(text) * 60 < 8000 THEN 1.2 ELSE 1 END * CASE WHEN turn * 10000 < 30000 THEN 1.5 ELSE 1 END AS h, (({_regexes(lex.CLIMAXES)}) * 0.4 * CASE WHEN p < 0.3 THEN 0.8 WHEN p < 0.8 THEN 2.5 ELSE 2.0 END + p) AS c FROM t) SELECT conv_id, turn, round(h, 6) AS hook_score, round(c, 6) AS climax_score FROM x")
def hooks(s, d):
    start = F.col("turn") * 10000
    h = scoring.hook_score(F.col("text"), start, start + F.length("text") * 60, F.col("p"))
    c = scoring.climax_score(F.col("text"), F.col("p"), F.col("p"), F.lit(0.5))
    return _turns(s, d).select("conv_id", "turn", F.round(h, 6).alias("hook_score"), F.round(c, 6).alias("climax_score"))


# --- speakers ---


@query("a19_speaker_profiles", f"SELECT role, sum(len({_words_sql()}))::BIGINT AS total_words, sum(length(text))::BIGINT AS speaking_time, min(turn) AS first_appearance, max(turn) AS last_appearance, round(sum(length(text)) / sum(sum(length(text))) OVER (), 8) AS dominance FROM conversations GROUP BY 1")
def speaker_profiles(s, d):
    p = source(s, d, "conversations").groupBy("role").agg(F.sum(text.word_count("text")).alias("total_words"), F.sum(F.length("text")).alias("speaking_time"), F.min("turn").alias("first_appearance"), F.max("turn").alias("last_appearance"))
    total = p.agg(F.sum("speaking_time").alias("_t"))
    return p.crossJoin(F.broadcast(total)).withColumn("dominance", F.round(F.col("speaking_time") / F.col("_t"), 8)).drop("_t")  # one row


@query("a20_interactions", "WITH n AS (SELECT role, length(text) AS e, lead(role) OVER w AS nr, lead(length(text)) OVER w AS ne FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT least(role, nr) AS a, greatest(role, nr) AS b, count(*) AS interactions, round(avg(ne - e), 4) AS mean_change FROM n WHERE role <> nr GROUP BY 1, 2")
def interactions(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = source(s, d, "conversations").select("role", F.length("text").alias("e"), F.lead("role").over(w).alias("nr"), F.lead(F.length("text")).over(w).alias("ne")).where("role <> nr")
    return n.groupBy(F.least("role", "nr").alias("a"), F.greatest("role", "nr").alias("b")).agg(F.count(F.lit(1)).alias("interactions"), F.round(F.avg(F.col("ne") - F.col("e")), 4).alias("mean_change"))


def _cases(patterns: dict[str, str]) -> str:
    """Names of the patterns found in low, with word bounds that know all letters."""
    bound = r"[^\p{L}\p{N}_]"
    said = {n: p.replace(r"\b(", f"(^|{bound})(").replace(r")\b", f")($|{bound})").replace("\\'", "'").replace("'", "''") for n, p in patterns.items()}
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN '{n}' END" for n, p in said.items()) + "], lambda x: x IS NOT NULL)"


@query("r24_topics_and_roles", f"SELECT conv_id, turn, {_cases(lex.TOPICS)} AS topics, {_cases(lex.ROLES)} AS roles FROM (SELECT *, lower(text) AS low FROM conversations)")
def topics_and_roles(s, d):
    return source(s, d, "conversations").select("conv_id", "turn", scoring.matching(F.col("text"), lex.TOPICS).alias("topics"), scoring.matching(F.col("text"), lex.ROLES).alias("roles"))


@query("w5_speaker_turns", "WITH c AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c) SELECT conv_id, run::BIGINT AS run, min(role) AS speaker, min(turn) AS \"start\", max(turn) + 1 AS \"end\", count(*) AS words FROM g GROUP BY 1, 2")
def speaker_turns(s, d):
    c = source(s, d, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"))
    return iv.speaker_turns(c, "conv_id", ["turn"])


# --- words in time ---


@query("i14_word_timing", f"WITH s AS (SELECT conv_id, turn, {_words_sql()} AS w, turn * 10000 AS a, turn * 10000 + 9000 AS b FROM conversations), e AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos, len(w) AS n, a, b FROM s) SELECT conv_id, turn, pos::INTEGER AS pos, word, round((a + pos * ((b - a) / n)) / 1000, 8) AS word_start, round((a + pos * ((b - a) / n) + (b - a) / n) / 1000, 8) AS word_end FROM e")
def word_timing(s, d):
    return _d(_timed_words(s, d).select("conv_id", "turn", "pos", "word", "word_start", "word_end"), "word_start", "word_end", digits=8)


def _timed_words(s, d):
    c = source(s, d, "conversations").select("conv_id", "turn", "text", (F.col("turn") * 10000).alias("start_ms"), (F.col("turn") * 10000 + 9000).alias("end_ms"))
    return iv.word_timing(c)


def _stream(s, d):
    w = _timed_words(s, d)
    return w.select("conv_id", (F.col("turn") * 2**32 + F.col("pos")).cast("long").alias("pos"), "word", F.col("word_start").alias("start"), F.col("word_end").alias("end"), (F.length("word") / 20).alias("confidence"), (F.col("turn") % 2).cast("string").alias("speaker"))


@query("i10_segments")
def segments(s, d):
    return hl.segment_words(_stream(s, d), ["conv_id"])


@query("i12_word_groups")
def word_groups(s, d):
    return hl.group_words(_stream(s, d), ["conv_id"])


@query("i13_subtitle_lines")
def subtitle_lines(s, d):
    return hl.subtitle_lines(_stream(s, d).withColumn("clip_start", F.lit(0.0)), ["conv_id"])


@query("i7_merge_jitter")
def merge_jitter(s, d):
    a = _stream(s, d)
    b = a.withColumns({"start": F.col("start") + 0.02, "end": F.col("end") + 0.02, "confidence": F.col("confidence") + 0.01})
    return hl.merge_jitter(a.unionByName(b), ["conv_id"])


@query("i9_merge_streams")
def merge_streams(s, d):
    a = _stream(s, d)
    b = a.where("pos % 3 <> 1").withColumns({"start": F.col("start") + 0.01, "end": F.col("end") + 0.01, "confidence": F.col("confidence") * (F.col("pos") % 2 + 0.5)})
    return hl.merge_streams(a, b, ["conv_id"])


@query("i20_absorb_short_turns")
def absorb_short_turns(s, d):
    turns = iv.speaker_turns(_stream(s, d), "conv_id", ["pos"])
    return hl.absorb_short_turns(turns.withColumn("end", F.col("start") + F.col("words") * 0.2), ["conv_id"])


@query("r1_scored_segments")
def scored_segments(s, d):
    closed = hl.segment_words(_stream(s, d), ["conv_id"])
    total = F.max("end").over(Window.partitionBy("conv_id"))
    energy = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((F.col("conv_id") + i) % 10) / 10.0)
    return hl.score_segments(closed.withColumns({"energy": energy, "total": total}), "energy", "total").drop("energy")


def _scored(s, d):
    x = scored_segments(s, d).withColumn("id", F.col("start_ms"))
    zero = F.lit(0.0)
    out = x.select("conv_id", "id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "text", F.lit("local").alias("source"), F.lit(None).cast("string").alias("beat_type"), F.lit(None).cast("string").alias("speaker_id"), F.col("score").alias("base"), F.col("audio_energy").alias("energy"), zero.alias("visual"), zero.alias("clarity"), zero.alias("narrative"), zero.alias("uniqueness"), zero.alias("bonus"))
    return out.withColumn("total", F.col("base") + F.col("energy"))


@query("i2_merge_payload")
def merge_payload(s, d):
    return hl.merge_payload(_scored(s, d), ["conv_id"])


@query("i6_selected_highlights")
def selected_highlights(s, d):
    return hl.select_highlights(_scored(s, d), ["conv_id"])


@query("u1_union_sources", "SELECT doc_id, 'local' AS source, NULL AS score FROM documents UNION ALL SELECT doc_id, 'model', quality * 1.0 FROM labels")
def union_sources(s, d):
    local = source(s, d, "documents").select("doc_id", F.lit("local").alias("source"))
    model = source(s, d, "labels").select("doc_id", F.lit("model").alias("source"), (F.col("quality") * 1.0).cast("double").alias("score"))
    return local.unionByName(model, allowMissingColumns=True)


@query("j13_turn_similarity", f"""WITH w AS (SELECT conv_id, turn, list_distinct({_words_sql('lower(text)')}) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS j FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn <> b.turn),
s AS (SELECT conv_id, turn, sum(j) AS s FROM p GROUP BY 1, 2) SELECT w.conv_id, w.turn, round(greatest(0.1, 1.0 - 0.3 * coalesce(s, 0)), 6) AS uniqueness FROM w LEFT JOIN s USING (conv_id, turn)""")
def turn_similarity(s, d):
    c = source(s, d, "conversations").select("conv_id", "turn", "text")
    return hl.uniqueness(c, ["conv_id"], tie="turn").select("conv_id", "turn", F.round("uniqueness", 6).alias("uniqueness"))


@query("j14_dependencies", f"""WITH w AS (SELECT conv_id, turn, lower(text) AS low, list_distinct({_words_sql('lower(text)')}) AS w FROM conversations)
SELECT b.conv_id, b.turn, a.turn AS depends_on FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE {_any('b.low', lex.REFERENCES)} AND len(list_intersect(a.w, b.w)) > 3""")
def dependencies(s, d):
    c = source(s, d, "conversations").select("conv_id", "turn", text.word_set("text").alias("words"), text.contains_any(F.col("text"), lex.REFERENCES).alias("refers"))
    return hl.shared_words(c, ["conv_id"], "words", 4, tie="turn", asks="refers").withColumnRenamed("other", "depends_on")


@query("o15_story_order")
def story_order(s, d):
    t = _turns(s, d).select("conv_id", "turn", scoring.story_beat(F.col("text"), F.col("p")).alias("beat"), scoring.polarity(F.col("text")).alias("emotion"), scoring.tension(F.col("text"), F.col("p")).alias("tension"))
    at = t.select("conv_id", F.col("turn").alias("depends_on"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("at"))
    deps = dependencies(s, d).join(at, ["conv_id", "depends_on"]).groupBy("conv_id", "turn").agg(F.collect_set("at").alias("deps"))
    return stories.story_order(t.join(deps, ["conv_id", "turn"], "left"), ["conv_id"], ["turn"], tie="turn")


@query("r23_structure", "WITH " + _TURNS + f", b AS (SELECT conv_id, p, {_BEAT_SQL} AS beat FROM t) SELECT conv_id, count(*) FILTER (beat = 'hook' AND p < 0.4) > 0 AS has_hook, count(*) FILTER (beat = 'climax' AND p BETWEEN 0.2 AND 0.9) > 0 AS has_climax, count(*) FILTER (beat = 'resolution' AND p > 0.6) > 0 AS has_resolution FROM b GROUP BY 1")
def structure(s, d):
    b = _turns(s, d).select("conv_id", "p", scoring.story_beat(F.col("text"), F.col("p")).alias("beat"))
    hit = lambda name, where: (F.count_if((F.col("beat") == name) & where) > 0)
    p = F.col("p")
    return b.groupBy("conv_id").agg(hit("hook", p < 0.4).alias("has_hook"), hit("climax", p.between(0.2, 0.9)).alias("has_climax"), hit("resolution", p > 0.6).alias("has_resolution"))


