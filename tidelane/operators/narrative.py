"""Story structure: coherence and completeness of beats, and titles from elsewhere merged with local segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.matching import best_matches, words_present

# Places and priorities of beats.
BEATS = ["hook", "climax", "resolution"]
ROLE_PRIORITY = {"hook": 4, "development": 2, "climax": 3, "resolution": 1}


def structure_scores(beats: DataFrame, key: str, place: str) -> DataFrame:
    """Coherence and completeness of a key's beats (kind hook, climax or resolution, start_ms, score), listed in ``place`` within their kind.

    Coherence weighs which kinds there are (0.4), whether starts ascend from hooks over climaxes to resolutions as listed (0.3; else 0.7 of it), and
    the mean over kinds of the mean scores (0.3). Completeness is the share of kinds with a bonus for two climaxes and for a hook with a resolution.
    """
    at = F.array_position(F.array(*map(F.lit, BEATS)), F.col("kind"))
    w = Window.partitionBy(key).orderBy(at, place)
    rows = beats.where(at > 0).withColumn("_down", F.coalesce(F.lag("start_ms").over(w) > F.col("start_ms"), F.lit(False)))
    per = [x for b in BEATS for x in (F.count_if(F.col("kind") == b).alias(f"_n_{b}"), F.coalesce(F.avg(F.when(F.col("kind") == b, F.col("score"))), F.lit(0.0)).alias(f"_s_{b}"))]
    a = rows.groupBy(key).agg(F.bool_or("_down").alias("_down"), *per)
    share = sum(((F.col(f"_n_{b}") > 0).cast("int") for b in BEATS), F.lit(0)) / 3
    quality = sum((F.col(f"_s_{b}") for b in BEATS), F.lit(0.0)) / 3
    bonus = F.when(F.col("_n_climax") >= 2, 0.1).otherwise(0.0) + F.when((F.col("_n_hook") > 0) & (F.col("_n_resolution") > 0), 0.1).otherwise(0.0)
    return a.select(key, (share * 0.4 + F.when(F.col("_down"), 0.7).otherwise(1.0) * 0.3 + quality * 0.3).alias("coherence"), F.least(F.lit(1.0), share + bonus).alias("completeness"))


def merge_titled(segments: DataFrame, titled: DataFrame, key: str, tie: str = "id") -> DataFrame:
    """Segments (key, id, start_ms, text, score) and titled highlights of the same key (place, title, keywords, role), merged.

    Each highlight goes to the segment whose text has most of its keywords, three more if it has the title; of ties the first, and none without
    any. That segment, once for each highlight, gains twice the priority of its role; segments that begin where none of these does gain 1.5 for each distinct
    keyword of all highlights in their text, 4 at most. A hook comes first, then the better score; place is by key.
    """
    low = segments.select(key, tie, F.lower("text").alias("text"))
    lowered = titled.select(key, "place", F.lower("title").alias("title"), F.transform("keywords", F.lower).alias("keywords"))
    matched = best_matches(low, lowered, key, tie).join(titled.select(key, "place", "title", "role"), [key, "place"]).join(segments.select(key, tie, "start_ms", "score"), [key, tie])
    boost = F.coalesce(F.create_map(*[F.lit(x) for kv in ROLE_PRIORITY.items() for x in kv])[F.col("role")], F.lit(1)) * 2
    enhanced = matched.select(key, tie, "start_ms", (F.col("score") + boost).alias("score"), F.col("title"), F.col("role"), F.col("place").alias("_p"))
    rest = segments.join(matched.select(key, "start_ms"), [key, "start_ms"], "left_anti")
    keywords = titled.select(key, F.explode("keywords").alias("_k")).distinct().select(key, F.lower("_k").alias("_k"))
    hits = words_present(low, keywords, key, "_k", tie).withColumnRenamed("hits", "_hits")
    gained = F.least(F.coalesce("_hits", F.lit(0)) * 1.5, F.lit(4.0))
    plain = rest.join(hits, [key, tie], "left").select(key, tie, "start_ms", (F.col("score") + gained).alias("score"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("int").alias("_p"))
    both = enhanced.unionByName(plain)
    order = [~F.coalesce(F.col("role") == "hook", F.lit(False)), F.col("score").desc(), F.col("_p").asc_nulls_last(), F.col(tie)]
    return both.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).drop("_p")
