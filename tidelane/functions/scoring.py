"""Rule scores as column expressions over a row, or over a row and its place in its key."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions import lexicons as lex
from tidelane.functions.text import contains_any, count_present, occurrences, split_words, word_count


def first_match(text: Column, lists: dict[str, list[str]], default: Column | None = None) -> Column:
    """The first name whose words stand in the text."""
    out = default if default is not None else F.lit(None).cast("string")
    for name, words in reversed(lists.items()):
        out = F.when(contains_any(text, words), name).otherwise(out)
    return out


def content_score(text) -> Column:
    """Words, punctuation and word length: 0 to 9."""
    n = word_count(text)
    column = F.col(text) if isinstance(text, str) else text
    letters = F.aggregate(split_words(text), F.lit(0), lambda s, w: s + F.length(w)) / F.greatest(n, F.lit(1))
    size = F.when(n.between(10, 50), 4.0).when(n.between(5, 60), 2.0).otherwise(0.0)
    return size + F.when(column.rlike("[.!?]"), 2.0).otherwise(0.0) + F.when(letters >= 5, 3.0).when(letters >= 4, 1.0).otherwise(0.0)


def energy_at(energy: Column, mid: Column, total: Column) -> Column:
    """The sample of an evenly spread series at a time; 0.5 without samples or time."""
    i = F.least((mid / total * F.size(energy)).cast("int"), F.size(energy) - 1)
    return F.when((F.size(energy) > 0) & (total > 0), F.get(energy, i)).otherwise(0.5)


def local_score(text, complete: Column, energy: Column, seconds: Column) -> Column:
    return F.when(complete, 2.0).otherwise(0.0) + content_score(text) + energy * 2.0 + F.least(seconds / 10.0, F.lit(2.0))


def polarity(text: Column) -> Column:
    p, n = (count_present(text, words) for words in lex.POLARITY)
    return F.coalesce(F.try_divide((p - n).cast("double"), (p + n).cast("double")), F.lit(0.0))


def story_beat(text: Column, position: Column) -> Column:
    """Beat by phrases, else by position."""
    place = F.when(position < 0.2, "setup").when(position < 0.4, "context").when(position < 0.7, "rising_action").otherwise("falling_action")
    return first_match(text, lex.BEAT_PHRASES, place)


def band_beat(text: Column, position: Column) -> tuple[Column, Column]:
    """Beat and confidence by the words of the position's band; null and 0.3 outside."""
    beat, sure = F.lit(None).cast("string"), F.lit(0.3)
    for name, (low, high, words, confidence) in reversed(lex.STORY_BANDS.items()):
        inside = reduce(lambda a, b: a & b, [x for x in (position >= low if low is not None else None, position < high if high is not None else None) if x is not None])
        hit = inside & contains_any(text, words)
        beat, sure = F.when(hit, name).otherwise(beat), F.when(hit, confidence).otherwise(sure)
    return beat, sure


def tension(text: Column, position: Column) -> Column:
    base = F.when(position < 0.2, F.lit(0.2)).when(position < 0.7, 0.2 + (position - 0.2) * 1.6).otherwise(1.0 - (position - 0.7) * 1.5)
    return F.when(contains_any(text, lex.TENSION), F.least(base + 0.2, F.lit(1.0))).otherwise(base)


def boosted(score: Column, beat: Column, text: Column) -> Column:
    by_beat = F.when(beat == "hook", 0.2).when(beat == "climax", 0.15).otherwise(0.0)
    return F.least(score + by_beat + F.when(contains_any(text, lex.SUPERLATIVES), 0.1).otherwise(0.0) + F.when(text.contains("?"), 0.05).otherwise(0.0), F.lit(1.0))


def scene_importance(score: Column, text: Column, energy: Column, seconds: Column, position: Column) -> tuple[Column, Column]:
    """Capped importance, and the reason by the uncapped one."""
    raw = score / 10.0
    for words, boost in lex.SCENE_BOOSTS:
        raw = raw + F.when(contains_any(text, words), boost).otherwise(0.0)
    raw = (raw + energy * 0.1) * F.when(seconds < 5, 0.8).when(seconds > 30, 0.9).otherwise(1.0)
    raw = raw + F.when((position < 0.2) | (position > 0.8), 0.05).otherwise(0.0)
    return F.least(raw, F.lit(1.0)), F.when(raw > 0.8, "key moment").when(raw > 0.6, "important").when(raw > 0.4, "relevant").otherwise("context")


def track_score(score: Column, kind: Column, seconds: Column) -> Column:
    factor = F.when(kind == "face", 1.2).otherwise(1.0) * F.when(seconds.between(10, 20), 1.1).otherwise(1.0) * F.when(seconds < 5, 0.8).when(seconds > 30, 0.9).otherwise(1.0)
    return F.least(score * factor, F.lit(1.0))


def composite(visual: Column, audio: Column, composition: Column, subject: Column) -> Column:
    return visual * 0.3 + audio * 0.3 + composition * 0.2 + subject * 0.2


def composition(brightness: Column, contrast: Column) -> Column:
    return (1.0 - F.abs(brightness - 128) / 128 + F.least(contrast / 80, F.lit(1.0))) / 2


def subject(count: Column, largest: Column) -> Column:
    return F.when(count == 0, 0.2).otherwise(F.least(count / 3, F.lit(1.0)) * 0.5 + F.least(largest, F.lit(1.0)) * 0.5)


def audio_keywords(text: Column) -> Column:
    """Of the text around a time; 0.3 without any."""
    return F.when(text.isNull(), 0.3).otherwise(F.least(count_present(text, lex.AUDIO_KEYWORDS) / 5, F.lit(1.0)))


def visual_interest(faces: Column, bodies: Column, brightness: Column, contrast: Column) -> Column:
    return F.least(faces / 3, F.lit(1.0)) * 0.4 + F.least(contrast / 100, F.lit(1.0)) * 0.3 + 1.0 - F.abs(brightness - 128) / 128 * 0.2 + F.when((faces > 0) | (bodies > 0), 0.1).otherwise(0.0)


def hashtag_score(tag: Column) -> Column:
    clean = F.lower(F.regexp_replace(tag, "^#+|#+$", ""))
    n = F.length(clean)
    score = F.when(clean.isin(*lex.VIRAL_TAGS), 3.0).otherwise(1.0)
    return F.when(n > 20, score * 0.5).otherwise(score) + F.when(n.between(8, 15), 0.5).otherwise(0.0)


def contexts(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(contains_any(text, words), name) for name, words in lex.CONTEXTS.items()]))


def caption_style(text: Column) -> Column:
    return F.when(contains_any(text, lex.EMPHASIS), "emphasis").when(word_count(text) > 15, "minimal").otherwise("default")


def pressure(percent: Column) -> Column:
    return F.when(percent >= 90, "critical").when(percent >= 80, "high").when(percent >= 70, "moderate").otherwise("low")


def _fragments(pattern: str) -> list[str]:
    """For each alternative of a fixed pattern, letters that any of its matches in lower case has: texts without all of them are not searched."""
    return [max(re.split(r"\\.\+?|\.", x), key=len).lower() for x in pattern.removeprefix(r"\b(").removesuffix(r")\b").split("|")]


def emotions(df: DataFrame, text: str) -> DataFrame:
    """Adds an intensity for each emotion, primary_emotion, emotional_intensity, valence, arousal and engagement."""
    low = F.col("_low")
    made = {}
    for name, (words, pattern, factors) in lex.EMOTIONS.items():
        weighed = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(factors.get(w, 1.0) * 0.3).alias("f")) for w in words])
        found = F.aggregate(weighed, F.lit(0.0), lambda total, x: total + F.when(F.contains(low, x["w"]), occurrences(low, x["w"]) * x["f"]).otherwise(0.0))
        said = reduce(lambda a, b: a | b, (low.contains(x) for x in _fragments(pattern)))
        made[f"e_{name}"] = F.least(F.lit(1.0), found + F.when(said, F.regexp_count(low, F.lit("(?i)" + pattern)) * 0.5).otherwise(0.0))
    out = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit("")))).withColumns(made).drop("_low")
    names = list(lex.EMOTIONS)
    most = F.greatest(*[F.col(f"e_{n}") for n in names])
    first = F.coalesce(*[F.when(F.col(f"e_{n}") == F.col("emotional_intensity"), n) for n in names])
    plus, minus = (sum((F.col(f"e_{n}") for n in group), F.lit(0.0)) for group in (lex.POSITIVE_EMOTIONS, lex.NEGATIVE_EMOTIONS))
    out = out.withColumn("emotional_intensity", most)
    out = out.withColumns({"primary_emotion": F.when(most > 0.1, first).otherwise("neutral"), "valence": F.coalesce(F.try_divide(plus - minus, plus + minus), F.lit(0.0)), "arousal": F.least(F.lit(1.0), sum((F.col(f"e_{n}") for n in names), F.lit(0.0)) / 3.0)})
    return out.withColumn("engagement", F.least(F.lit(1.0), F.col("emotional_intensity") * 0.4 + F.col("arousal") * 0.4 + F.abs("valence") * 0.2))


def significance(pattern: Column, energy: Column, text: Column) -> Column:
    scores = F.create_map(*[F.lit(x) for kv in lex.PATTERN_SCORES.items() for x in kv])
    return F.least(F.lit(1.0), F.coalesce(scores[pattern], F.lit(0.5)) + F.least(F.lit(0.3), energy * 0.3) + count_present(text, lex.SIGNIFICANT_WORDS) * 0.1)


def engagement_type(emotion: Column, pattern: Column) -> Column:
    return (
        F.when((emotion == "excitement") & pattern.isin("peak", "building"), "high_energy_excitement")
        .when((emotion == "surprise") & (pattern == "volatile"), "shocking_revelation")
        .when((emotion == "curiosity") & (pattern == "building"), "building_intrigue")
        .when((emotion == "inspiration") & pattern.isin("peak", "plateau"), "inspirational_moment")
        .when((emotion == "humor") & (pattern == "peak"), "comedic_peak")
        .otherwise("general_engagement")
    )


def _hits(text: Column, patterns: list[str]) -> Column:
    return sum((F.regexp_count(F.lower(text), F.lit("(?i)" + p)) for p in patterns), F.lit(0))


def hook_score(text: Column, start_ms: Column, end_ms: Column, position: Column) -> Column:
    score = _hits(text, lex.HOOKS) * 0.3 * F.when(position < 0.3, 3.0).when(position < 0.7, 1.0).otherwise(0.5)
    return score * F.when(end_ms - start_ms < 8000, 1.2).otherwise(1.0) * F.when(start_ms < 30000, 1.5).otherwise(1.0)


def climax_score(text: Column, position: Column, boost: Column, energy: Column) -> Column:
    score = _hits(text, lex.CLIMAXES) * 0.4 * F.when(position < 0.3, 0.8).when(position < 0.8, 2.5).otherwise(2.0) + boost
    return score * F.when(energy > 0.7, 1.3).otherwise(1.0)


def position_ratio(df: DataFrame, key: list[str], order: list[str], name: str = "position") -> DataFrame:
    """i / max(n - 1, 1) of a row in its key."""
    w = Window.partitionBy(*key)
    return df.withColumn(name, (F.row_number().over(w.orderBy(*order)) - 1) / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1)))


def matching(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns found in a text, in their order."""
    return F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), name) for name, p in patterns.items()]))
