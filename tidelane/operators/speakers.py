"""Who speaks in a recording: profiles, roles, anchors, relations, flows and continuity, as aggregates and runs.

Rows are segments of a key: speaker, text, start_ms, end_ms, energy_level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions import lexicons as lex
from tidelane.functions.scoring import matching
from tidelane.functions.text import count_present, word_count
from tidelane.operators import intervals as iv


def _third_trend(values: str, n: str, i: str) -> Column:
    """Mean of the last third of a run less that of its first, as aggregates of rows numbered from 0; of two rows their difference."""
    third = F.floor(F.max(n) / 3)
    value = F.col(values)
    first = F.sum(F.when(F.col(i) < F.floor(F.col(n) / 3), value)) / third
    last = F.sum(F.when(F.col(i) >= F.col(n) - F.ceil(F.col(n) / 3), value)) / third
    two = F.max_by(value, F.col(i)) - F.min_by(value, F.col(i))
    return F.when(F.max(n) < 2, 0.0).when(F.max(n) < 3, two).otherwise(last - first)


def flows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Runs of one speaker: start_ms, end_ms of the last segment, topic of the first, mean energy, its trend, and the kind of flow."""
    rows = iv.changes(df, key, order, "speaker")
    whole = Window.partitionBy(key, "run")
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(whole), "_i": F.row_number().over(whole.orderBy(*order)) - 1})
    topic = F.coalesce(F.get(matching(F.col("text"), lex.TOPICS), F.lit(0)), F.lit("general"))
    out = rows.groupBy(key, "run").agg(
        F.min("speaker").alias("speaker"), F.min_by("start_ms", "_i").alias("start_ms"), F.max_by("end_ms", "_i").alias("end_ms"), F.min_by(topic, F.col("_i")).alias("topic"), F.avg("energy_level").alias("avg_energy"), _third_trend("energy_level", "_n", "_i").alias("_change")
    )
    out = out.withColumns({"duration": F.col("end_ms") - F.col("start_ms"), "energy_trend": F.when(F.col("_change") > 0.1, "rising").when(F.col("_change") < -0.1, "falling").otherwise("stable")}).drop("_change")
    kind = (
        F.when(F.col("duration") < 10000, "brief_exchange")
        .when(F.col("duration") > 60000, F.when(F.col("avg_energy") > 0.7, "passionate_monologue").otherwise("detailed_explanation"))
        .when(F.col("energy_trend") == "rising", "building_excitement")
        .when(F.col("energy_trend") == "falling", "conclusion")
        .otherwise("steady_discussion")
    )
    return out.withColumn("flow_type", kind)


def profiles(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each speaker's words, time, mean energy, topics, sentiment, dominance, consistency, role, and place among the anchors (null: none)."""
    topics, roles = list(lex.TOPICS), list(lex.ROLES)
    low = F.lower(F.coalesce("text", F.lit("")))
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = df.withColumns({"_at": at, "_low": low}).withColumns({"_topics": matching(F.col("_low"), lex.TOPICS), "_roles": matching(F.col("_low"), lex.ROLES)})
    has = lambda name, value: F.array_contains(F.col(name), value)
    made = [F.count_if(has("_roles", r)).alias(f"_r_{r}") for r in roles] + [F.min(F.when(has("_roles", r), F.col("_at"))).alias(f"_f_{r}") for r in roles]
    a = rows.groupBy(key, "speaker").agg(
        F.sum(word_count("text")).alias("total_words"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speaking_time"), F.avg("energy_level").alias("avg_energy"), F.var_pop("energy_level").alias("_var"), F.count(F.lit(1)).alias("_n"),
        F.array_compact(F.array(*[F.when(F.bool_or(has("_topics", t)), t) for t in topics])).alias("topics"), F.sum(count_present(F.col("_low"), lex.SENTIMENT[0])).alias("_plus"), F.sum(count_present(F.col("_low"), lex.SENTIMENT[1])).alias("_minus"), F.min("_at").alias("_first"), *made,
    )
    total = F.sum("speaking_time").over(Window.partitionBy(key))
    level = (F.greatest(F.lit(0.0), 1 - F.col("_var")) + F.greatest(F.lit(0.0), 1 - F.size("topics") / 10)) / 2
    a = a.withColumns({"dominance": F.when(total == 0, 0.0).otherwise(F.col("speaking_time") / total), "consistency": F.when(F.col("_n") < 2, 1.0).otherwise(level)})
    seen = [F.when(F.col(f"_r_{r}") > 0, F.struct((-F.col(f"_r_{r}")).alias("n"), F.col(f"_f_{r}").alias("f"), F.lit(i).alias("i"), F.lit(r).alias("role"))) for i, r in enumerate(roles)]
    usual = F.least(*seen)["role"]  # the most frequent, then the one seen first
    fallback = F.when(F.col("dominance") > 0.6, "primary_speaker").when(F.col("speaking_time") > 60000, "main_character").otherwise("supporting_character")
    role = (
        F.when((F.col("_r_host") > 0) | (F.col("_r_interviewer") > 0), F.when(F.col("dominance") > 0.4, "host").otherwise("interviewer"))
        .when((F.col("_r_expert") > 0) & (F.col("total_words") > 500), "expert")
        .when(F.col("_r_guest") > 0, "guest")
        .otherwise(F.coalesce(usual, fallback))
    )
    mood = F.when(F.col("_plus") > F.col("_minus") * 1.5, "positive").when(F.col("_minus") > F.col("_plus") * 1.5, "negative").otherwise("neutral")
    anchors = ((F.col("dominance") > 0.3) & (F.col("consistency") > 0.6) & (F.col("speaking_time") > 30000)) | (F.col("dominance") > 0.6)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_anchor").desc(), F.col("dominance").desc(), "_first"))
    a = a.withColumns({"role": role, "sentiment": mood, "_anchor": anchors}).withColumn("_place", place)
    anchor = F.when(F.col("_anchor") & (F.col("_place") <= 3), F.col("_place"))
    return a.select(key, "speaker", "total_words", "speaking_time", "avg_energy", "topics", "sentiment", "dominance", "consistency", "role", anchor.alias("anchor"))


def _mean(value: Column) -> Column:
    """Mean to six places by a product, as SQL engines round doubles; ``round`` to places goes by their shortest decimal, which differs at halves."""
    return F.round(F.avg(value) * 1e6) / 1e6


def relations(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Pairs of speakers who follow each other: how often, mean pause and change of energy, topics of what was answered, and the kind of relation. Unknown speakers have none.

    Means have six places, and the kind goes by these: a change of 0.1 is none above it, whatever sums of doubles leave behind.
    """
    w = Window.partitionBy(key).orderBy(*order)
    after = {f"_{c}": F.lead(c).over(w) for c in ("speaker", "start_ms", "energy_level")}
    rows = df.withColumns(after).where((F.col("speaker") != F.col("_speaker")) & (F.col("speaker") != "unknown") & (F.col("_speaker") != "unknown"))
    rows = rows.withColumn("_topics", matching(F.col("text"), lex.TOPICS))
    a = rows.groupBy(key, F.least("speaker", "_speaker").alias("a"), F.greatest("speaker", "_speaker").alias("b")).agg(
        F.count(F.lit(1)).alias("interactions"), _mean(F.col("_start_ms") - F.col("end_ms")).alias("mean_gap"), _mean(F.col("_energy_level") - F.col("energy_level")).alias("mean_change"), F.array_compact(F.array(*[F.when(F.bool_or(F.array_contains("_topics", t)), t) for t in lex.TOPICS])).alias("topics")
    )
    quick = F.when(F.col("mean_change") > 0.1, "dynamic_conversation").otherwise("collaborative_discussion")
    kind = F.when(F.col("interactions") < 2, "minimal").when(F.col("mean_gap") < 1000, quick).when(F.col("interactions") > 5, "structured_interview").otherwise("casual_exchange")
    return a.withColumn("relation", kind)


def continuity(speakers: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Per key, the mean of three scores: few speakers, their consistency, and flows of over five seconds."""
    s = speakers.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.avg("consistency").alias("_c"))
    f = runs.groupBy(key).agg(F.count_if(F.col("duration") > 5000).alias("_f"))
    score = (F.least(F.lit(1.0), 2 / F.col("_n")) + F.col("_c") + F.least(F.lit(1.0), F.col("_f") / 10)) / 3
    return s.join(f, key).select(key, score.alias("continuity"))
