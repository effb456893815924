"""Intervals and sequences: islands, sessions, runs, alignment and range joins.

What a window can express is a window; a range join becomes an equi-join on time buckets of several widths with the exact predicate on top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.storage import materialize, shuffle_partitions


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    """Half-open intervals that share more than a bound."""
    return ~((F.col(a_end) <= F.col(b_start)) | (F.col(b_end) <= F.col(a_start)))


def overlap_length(a_start, a_end, b_start, b_end) -> Column:
    return F.greatest(F.least(F.col(a_end), F.col(b_end)) - F.greatest(F.col(a_start), F.col(b_start)), F.lit(0))


def _by(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def islands(df: DataFrame, key, start: str, end: str, gap, name: str = "island", tie: str = "id") -> DataFrame:
    """Numbers groups of intervals in which each begins at most ``gap`` after everything before it has ended."""
    w = Window.partitionBy(*_by(key)).orderBy(start, end, tie)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col(start) - reach > gap) | reach.isNull()
    return df.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(w)).drop("_new")


def merge_bounds(df: DataFrame, key, start: str = "start_ms", end: str = "end_ms", gap=1000) -> DataFrame:
    """Spans of merged intervals, with how many each took."""
    k = _by(key)
    return islands(df, k, start, end, gap).groupBy(*k, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("island")


def merge_typed(df: DataFrame, key, start: str = "start_ms", end: str = "end_ms", score: str = "value", kind: str = "kind", features: str | None = None) -> DataFrame:
    """Strictly overlapping intervals become one, with the greatest score and their common kind or ``mixed``.

    ``features``: a map column; the merged one has each feature's last value, by the intervals' order (start, end, id). Maps that are null have no features.
    """
    k = _by(key)
    w = Window.partitionBy(*k).orderBy(start, end, "id")
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = df.withColumn("_new", ((F.col(start) >= reach) | reach.isNull()).cast("int")).withColumn("island", F.sum("_new").over(w))
    out = numbered.groupBy(*k, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.max(score).alias(score), F.when(F.min(kind) == F.max(kind), F.min(kind)).otherwise("mixed").alias(kind))
    if features:
        each = numbered.select(*k, "island", F.struct(start, end, "id").alias("_o"), F.explode(features).alias("_f", "_v"))
        last = each.groupBy(*k, "island", "_f").agg(F.max_by("_v", "_o").alias("_v"))
        maps = last.groupBy(*k, "island").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_f", "_v")))).alias(features))  # as many as a feature has names
        out = out.join(maps, [*k, "island"], "left").withColumn(features, F.coalesce(features, F.create_map().cast(df.schema[features].dataType)))
    return out.drop("island")


def sessions(df: DataFrame, key, at: str, gap, least=0) -> DataFrame:
    """Groups of points no more than ``gap`` apart; those shorter than ``least`` go."""
    k = _by(key)
    w = Window.partitionBy(*k).orderBy(at)
    new = F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True)).cast("int")
    numbered = df.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w))
    return numbered.groupBy(*k, "_s").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n")).where(F.col("end") - F.col("start") >= least).drop("_s")


def threshold_runs(df: DataFrame, key, at: str, value: str, percentile: float, least, score: float) -> DataFrame:
    """Runs above the key's percentile, up to the first point that isn't; a run still open at the end goes, as do short ones."""
    k = _by(key)
    limit = df.groupBy(*k).agg(F.percentile(value, F.lit(percentile)).alias("_limit"))
    w = Window.partitionBy(*k).orderBy(at)
    flagged = df.join(limit, k).withColumn("_hot", F.col(value) > F.col("_limit"))
    edges = flagged.withColumn("_edge", (F.col("_hot") != F.coalesce(F.lag("_hot").over(w), F.lit(False)))).where("_edge")
    closed = edges.withColumn("_end", F.lead(at).over(w)).where("_hot AND _end IS NOT NULL")
    return closed.where(F.col("_end") - F.col(at) >= least).select(*k, F.col(at).alias("start"), F.col("_end").alias("end"), F.lit(score).alias("score"))


def changes(df: DataFrame, key, order: list[str], value: str, name: str = "run") -> DataFrame:
    """Numbers runs of equal ``value``; null is a value."""
    w = Window.partitionBy(*_by(key)).orderBy(*order)
    first = F.row_number().over(w) == 1
    new = (first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w)).drop("_new")


def state_changes(df: DataFrame, key, order: list[str], value: str) -> DataFrame:
    """Rows at which ``value`` differs from the row before, the first of a key included."""
    w = Window.partitionBy(*_by(key)).orderBy(*order)
    return df.where("true").withColumn("previous", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("previous")))


def drop_repeated_words(words: DataFrame, key, order: list[str], word: str = "word") -> DataFrame:
    """A run of one word, but for case and outer space, is its first row, to the run's last end, at its greatest confidence."""
    k = _by(key)
    runs = changes(words.withColumn("_w", F.trim(F.lower(word))), k, order, "_w")
    at = F.struct(*order)
    return runs.groupBy(*k, "run").agg(F.min_by(word, at).alias(word), F.min_by("start", at).alias("start"), F.max_by("end", at).alias("end"), F.max("confidence").alias("confidence")).drop("run")


def speaker_turns(words: DataFrame, key, order: list[str], speaker: str = "speaker") -> DataFrame:
    """Runs of one speaker: from the first word's start to the last word's end."""
    k = _by(key)
    at = F.struct(*order)
    return changes(words, k, order, speaker).groupBy(*k, "run").agg(F.first(speaker).alias(speaker), F.min_by("start", at).alias("start"), F.max_by("end", at).alias("end"), F.count(F.lit(1)).alias("words"))


def merge_same_speaker(segments: DataFrame, key, gap: float = 0.5, least: float = 0.0, speaker: str = "speaker") -> DataFrame:
    """Neighbours of one speaker less than ``gap`` apart become one, ending where the last does; shorter ones than ``least`` go."""
    k = _by(key)
    w = Window.partitionBy(*k).orderBy("start", "end")
    joined = F.col(speaker).eqNullSafe(F.lag(speaker).over(w)) & (F.col("start") - F.lag("end").over(w) < gap)
    numbered = segments.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("_r", F.sum("_new").over(w))
    at = F.struct("start", "end")
    out = numbered.groupBy(*k, "_r").agg(F.first(speaker).alias(speaker), F.min("start").alias("start"), F.max_by("end", at).alias("end"))
    return out.where(F.col("end") - F.col("start") >= least).drop("_r")


def pad_transitions(segments: DataFrame, key, overlap: float = 0.1) -> DataFrame:
    """Widens each interval by half the overlap toward its neighbours, to at most ``overlap`` into them; bounds are the neighbours' original ones."""
    w = Window.partitionBy(*_by(key)).orderBy("start", "end")
    start = F.when(F.lag("end").over(w).isNotNull(), F.greatest(F.col("start") - overlap / 2, F.lag("end").over(w) - overlap)).otherwise(F.col("start"))
    end = F.when(F.lead("start").over(w).isNotNull(), F.least(F.col("end") + overlap / 2, F.lead("start").over(w) + overlap)).otherwise(F.col("end"))
    return segments.withColumns({"_s": start, "_e": end}).withColumns({"start": F.col("_s"), "end": F.col("_e")}).drop("_s", "_e")


def offset_chunks(df: DataFrame, chunk: str, seconds: float, *columns: str) -> DataFrame:
    """Times of a chunk become times of the whole."""
    return df.withColumns({c: F.col(c) + F.col(chunk) * seconds for c in columns})


def word_timing(segments: DataFrame, text: str = "text", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """A row for each word of a segment, its time shared out evenly: word, pos, word_start and word_end in seconds."""
    words = F.filter(F.split(F.regexp_replace(text, r"[\s ]+", " "), " "), lambda x: x != "")
    exploded = segments.withColumn("_w", words).select("*", F.size("_w").alias("_n"), F.posexplode("_w").alias("pos", "word"))
    each = (F.col(end) - F.col(start)) / F.col("_n")
    first = F.col(start) + F.col("pos") * each
    return exploded.withColumns({"word_start": first / 1000.0, "word_end": (first + each) / 1000.0}).drop("_w", "_n")


# --- range joins ---
#
# An interval is one row at the level of its length: levels double in width, and at its level an interval is no longer than a bucket, so a point in it lies in the bucket
# of its start or in the next. A point asks for two buckets at each level that its key has.


def _width(level: Column, width) -> Column:
    return F.lit(float(width)) * F.pow(F.lit(2.0), level)


def held(intervals: DataFrame, start: str, end: str, width) -> DataFrame:
    """``intervals`` with _level and _bucket, a row each. Level 0 has buckets of ``width``."""
    length = (F.col(end) - F.col(start)).cast("double")
    guess = F.greatest(F.lit(0.0), F.ceil(F.log2(F.greatest(length, F.lit(float(width))) / width)))
    level = F.when(length > _width(guess, width) * 0.999999, guess + 1).otherwise(guess)  # a bucket has room for rounding
    return intervals.withColumn("_level", level.cast("int")).withColumn("_bucket", F.floor(F.col(start) / _width(F.col("_level"), width)))


def _in_held(points: DataFrame, at: Column, right: DataFrame, key: list[str], width) -> DataFrame:
    """Points with what is :func:`held` of their key in the buckets where what contains them stands."""
    levels = right.groupBy(*key).agg(F.collect_set("_level").alias("_levels"))
    asked = F.flatten(F.transform("_levels", lambda n: F.transform(F.array(F.lit(0), F.lit(1)), lambda back: F.struct(n.alias("n"), (F.floor(at / _width(n, width)) - back).alias("b")))))
    probes = points.join(levels, key).withColumn("_ask", F.explode(asked)).select(*points.columns, F.col("_ask.n").alias("_level"), F.col("_ask.b").alias("_bucket"))
    return probes.join(right, [*key, "_level", "_bucket"]).drop("_level", "_bucket")


def point_in_interval(points: DataFrame, intervals: DataFrame, key, at: str, start: str, end: str, width, tie: list[str], take: list[str]) -> DataFrame:
    """For each point the first interval, by ``tie``, that holds it (both ends count), with its ``take`` columns; nulls if none does.

    ``points`` need a unique ``id``. ``width`` should be near a short interval's length; a longer one is a row all the same.
    """
    k = _by(key)
    right = intervals.select(*k, F.col(start).alias("_s"), F.col(end).alias("_e"), *[F.col(c).alias(f"_t_{c}") for c in tie], *[F.col(c).alias(f"_x_{c}") for c in take])
    hits = _in_held(points, F.col(at), held(right, "_s", "_e", width), k, width).where(F.col(at).between(F.col("_s"), F.col("_e")))
    first = hits.groupBy("id").agg(F.min_by(F.struct(*[F.col(f"_x_{c}").alias(c) for c in take]), F.struct(*[f"_t_{c}" for c in tie])).alias("_m"))
    return points.join(first, "id", "left").select(*points.columns, *[F.col(f"_m.{c}").alias(c) for c in take])


def contained(inner: DataFrame, outer: DataFrame, key, width, inner_bounds=("start", "end"), outer_bounds=("start", "end"), outer_id: str = "outer_id") -> DataFrame:
    """Pairs of an inner interval that lies wholly in an outer one: the inner's columns and the outer's id."""
    k = _by(key)
    right = held(outer.select(*k, outer_id, F.col(outer_bounds[0]).alias("_s"), F.col(outer_bounds[1]).alias("_e")), "_s", "_e", width)
    hits = _in_held(inner, F.col(inner_bounds[0]), right, k, width)
    # an inner one that ends before it begins may begin behind the outer one's end, which no bucket leads to: it lies in none
    return hits.where((F.col(inner_bounds[0]) >= F.col("_s")) & (F.col(inner_bounds[1]) <= F.col("_e")) & (F.col(inner_bounds[0]) <= F.col("_e"))).drop("_s", "_e")


def overlapping(left: DataFrame, right: DataFrame, key, width, left_bounds, right_bounds, right_id: str) -> DataFrame:
    """Pairs of overlapping half-open intervals: the left's columns and the right's id, each pair once.

    Of two that overlap, the one that begins later begins in the other: the right ones that begin in left ones (or with them), and the left ones that begin in right ones.
    """
    k = _by(key)
    ls, le = (F.col(c) for c in left_bounds)
    b = right.select(*k, F.col(right_id).alias("_id"), F.col(right_bounds[0]).alias("_s"), F.col(right_bounds[1]).alias("_e"))
    hit = (ls < F.col("_e")) & (le > F.col("_s"))
    columns = [*left.columns, F.col("_id").alias(right_id)]
    later = _in_held(left, ls, held(b, "_s", "_e", width), k, width).where(hit & (F.col("_s") < ls)).select(columns)
    earlier = _in_held(b, F.col("_s"), held(left, *left_bounds, width), k, width).where(hit & (ls <= F.col("_s"))).select(columns)
    return later.unionByName(earlier)


def as_of(points: DataFrame, states: DataFrame, key, at: str, since: str, value: str, default, tie: str = "id", until: str | None = None) -> DataFrame:
    """``points`` with ``value`` of the state of their key that began last at or before ``at`` - of several at once the greatest value - or ``default`` if none did, or if it was over (``until``) by then.

    Both sides are laid out by key and time in ranges, so a key of any size is many tasks' work; what a key's last state was is carried from range to range in a table of one
    row for each range and key. ``points`` need a unique ``tie``. Null times and keys have the default.
    """
    k, spark = _by(key), points.sparkSession
    none = F.lit(None)
    over = F.col(until) if until else none.cast(dict(states.dtypes)[since])
    began = states.where(F.col(since).isNotNull()).select(*k, F.col(since).alias("_at"), F.struct(F.col(since).alias("a"), F.col(value).alias("v"), over.alias("u")).alias("_state"), none.cast(dict(points.dtypes)[tie]).alias("_tie"))
    asked = points.where(F.col(at).isNotNull()).select(*k, F.col(at).cast(dict(states.dtypes)[since]).alias("_at"), none.cast(dict(began.dtypes)["_state"]).alias("_state"), F.col(tie).alias("_tie"))
    ranged = began.unionByName(asked).repartitionByRange(shuffle_partitions(spark), *k, "_at").withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "as-of")  # a range is the same one in both uses
    carried = ranged.groupBy(*k, "_range").agg(F.max("_state").alias("_last"))
    carried = carried.withColumn("_before", F.max("_last").over(Window.partitionBy(*k).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    own = F.max("_state").over(Window.partitionBy(*k, "_range").orderBy("_at"))  # a range of values: states of the same time count
    found = ranged.withColumn("_own", own).where(F.col("_tie").isNotNull()).join(carried, [*k, "_range"]).select("_tie", "_at", F.coalesce("_own", "_before").alias("_state"))
    fits = F.col("_state").isNotNull() & (F.lit(True) if until is None else F.coalesce(F.col("_at") <= F.col("_state.u"), F.lit(False)))
    told = found.select(F.col("_tie").alias(tie), F.when(fits, F.col("_state.v")).alias("_v"))
    return points.join(told, tie, "left").withColumn(value, F.coalesce("_v", F.lit(default))).drop("_v")


def overlap_anti(left: DataFrame, right: DataFrame, key, width, bounds=("start_ms", "end_ms"), left_id: str = "id") -> DataFrame:
    """Left intervals that overlap no right one."""
    hit = overlapping(left, right.withColumnRenamed(left_id, "_right"), key, width, bounds, bounds, "_right").select(left_id).distinct()
    return left.join(hit, left_id, "left_anti")


def within(points: DataFrame, others: DataFrame, key, at: str, other_at: str, distance, take: list[str]) -> DataFrame:
    """Pairs of points less than ``distance`` apart: the left's columns and the right's ``take``."""
    k = _by(key)
    left = points.withColumn("_b", F.explode(F.sequence(F.floor(F.col(at) / distance) - 1, F.floor(F.col(at) / distance) + 1)))
    right = others.select(*k, F.col(other_at).alias("_o"), *take).withColumn("_b", F.floor(F.col("_o") / distance))
    return left.join(right, [*k, "_b"]).where(F.abs(F.col("_o") - F.col(at)) < distance).drop("_b", "_o")


def uniform_samples(df: DataFrame, duration: str = "duration") -> DataFrame:
    """Three to five evenly spread samples of a duration: sample, start, end."""
    d = F.col(duration)
    n = F.least(F.lit(5), F.greatest(F.lit(3), F.floor(d / 60).cast("int")))
    out = df.withColumn("_n", n).withColumn("_len", F.least(F.lit(20.0), d / (F.col("_n") * 2))).select("*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("sample"))
    start = F.greatest(F.lit(0.0), d / (F.col("_n") + 1) * F.col("sample") - F.col("_len") / 2)
    return out.withColumn("start", start).withColumn("end", F.least(F.col("start") + F.col("_len"), d)).drop("_n", "_len")


def gaps_to_next(df: DataFrame, key, start: str, end: str) -> DataFrame:
    """Adds gap, from an interval's end to the next one's start; negative if they overlap."""
    w = Window.partitionBy(*_by(key)).orderBy(start, end, "id")
    return df.withColumn("gap", F.lead(start).over(w) - F.col(end))


def peaks(df: DataFrame, key, order: list[str], value: str, least: float | None = None) -> DataFrame:
    """Rows strictly above both neighbours (and ``least``)."""
    w = Window.partitionBy(*_by(key)).orderBy(*order)
    v = F.col(value)
    ok = (v > F.lag(value).over(w)) & (v > F.lead(value).over(w))
    return df.withColumn("_ok", ok if least is None else ok & (v > least)).where("_ok").drop("_ok")


def fixed_windows(df: DataFrame, key, size: int, at: str = "i", value: str = "value") -> DataFrame:
    """Statistics of consecutive windows of ``size`` samples; the last window goes, full or not, unless samples follow it."""
    k = _by(key)
    g = df.groupBy(*k, F.floor(F.col(at) / size).alias("win")).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.regr_slope(value, at).alias("slope"), F.count(F.lit(1)).alias("n"))
    last = F.max("win").over(Window.partitionBy(*k))
    cls = (
        F.when(F.col("std") > 0.15, "volatile").when(F.col("mean") > 0.7, "peak").when(F.col("mean") < 0.3, "low").when(F.col("slope") > 0.02, "building").when(F.col("slope") < -0.02, "drop").otherwise("plateau")
    )
    return g.withColumn("_last", last).where(F.col("win") < F.col("_last")).withColumn("pattern", cls).drop("_last", "n")


def sliding_arcs(df: DataFrame, key, order: list[str], intensity: str, valence: str, size: int = 5) -> DataFrame:
    """Slopes, ranges, class and impact over each row and the ``size`` - 1 after it; flat ones and incomplete windows go."""
    w = Window.partitionBy(*_by(key)).orderBy(*order)
    f = w.rowsBetween(0, size - 1)
    out = df.withColumn("_x", F.row_number().over(w).cast("double"))
    out = out.withColumns({"intensity_slope": F.round(F.regr_slope(intensity, "_x").over(f), 12), "valence_slope": F.round(F.regr_slope(valence, "_x").over(f), 12), "_n": F.count(F.lit(1)).over(f), "_ir": F.max(intensity).over(f) - F.min(intensity).over(f), "_vr": F.max(valence).over(f) - F.min(valence).over(f), "_ia": F.avg(intensity).over(f)})
    i, v = F.col("intensity_slope"), F.col("valence_slope")
    arc = F.when((i > 0.1) & (v > 0.1), "rising_positive").when((i > 0.1) & (v < -0.1), "rising_negative").when((i < -0.1) & (v > 0.1), "resolving_positive").when((i < -0.1) & (v < -0.1), "declining").when(F.col("_ir") > 0.4, "volatile")
    out = out.where(F.col("_n") == size).withColumn("arc", arc).where("arc IS NOT NULL")
    return out.withColumn("impact", F.least(F.lit(1.0), F.col("_ir") * 0.4 + F.col("_vr") * 0.3 + F.col("_ia") * 0.3)).drop("_x", "_n", "_ir", "_vr", "_ia")
