"""Aggregations beyond the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_percentile_of(df: DataFrame, key: list[str], value: str, p: float, name: str) -> DataFrame:
    """The element at position int(n p) of the sorted values, not interpolated: counts by value and a running sum, no list of the group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*key)
    run = counts.withColumn("_to", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w))
    at = F.least(F.floor(F.col("_all") * F.lit(p)), F.col("_all") - 1)
    return run.where((at < F.col("_to")) & (at >= F.col("_to") - F.col("_n"))).select(*key, F.col(value).alias(name))


def histogram(df: DataFrame, key: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts by upper bound ``le``, +Inf included."""
    counts = df.groupBy(*key).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)], F.count(value).alias(f"_{len(bounds)}"))
    edges = [*map(float, bounds), float("inf")]
    return counts.select(*key, F.explode(F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"_{i}").alias("count")) for i, e in enumerate(edges)])).alias("b")).select(*key, "b.*")


def histogram_quantile(buckets: DataFrame, key: list[str], q: float, name: str = "quantile") -> DataFrame:
    """The quantile by linear interpolation in the first bucket that reaches it; of the +Inf bucket, the greatest finite bound. Null without samples."""
    w = Window.partitionBy(*key).orderBy("le")
    rows = buckets.withColumns({"_lo": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "_before": F.coalesce(F.lag("count").over(w), F.lit(0)), "_all": F.max("count").over(Window.partitionBy(*key))})
    rank = F.col("_all") * F.lit(q)
    inside = F.when(F.col("le") == float("inf"), F.col("_lo")).otherwise(F.col("_lo") + (F.col("le") - F.col("_lo")) * F.try_divide(rank - F.col("_before"), F.col("count") - F.col("_before")))
    hit = rows.where((F.col("_all") > 0) & (F.col("count") >= rank)).groupBy(*key).agg(F.min_by(inside, "le").alias(name))
    return buckets.select(*key).distinct().join(hit, key, "left")


def last_n_summary(df: DataFrame, key: list[str], at: str, value: str, n: int = 10) -> DataFrame:
    """Current value, mean of the last ``n`` and peak of all."""
    w = Window.partitionBy(*key).orderBy(F.col(at).desc())
    return df.withColumn("_r", F.row_number().over(w)).groupBy(*key).agg(F.max_by(value, at).alias("current"), F.avg(F.when(F.col("_r") <= n, F.col(value))).alias("recent_avg"), F.max(value).alias("peak"), F.count(F.lit(1)).alias("samples"))


def diversity(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Distinct values at three decimals against their number: identical, low (under 0.7) or fine."""
    out = df.groupBy(*key).agg(F.countDistinct(F.format_string("%.3f", value)).alias("distinct_values"), F.count(value).alias("n"))
    grade = F.when((F.col("distinct_values") == 1) & (F.col("n") > 1), "identical").when(F.col("distinct_values") < F.col("n") * 0.7, "low").otherwise("fine")
    return out.withColumn("diversity", grade)


def duplicate_groups(df: DataFrame, text: str, id_: str) -> DataFrame:
    """Groups of equal texts but for case and white space, by digest: their number and smallest id."""
    norm = F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0b]+", " "))
    return df.groupBy(F.md5(norm.cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min(id_).alias("first_id")).where("n > 1")


def rate(hits: str, misses: str) -> Column:
    """Share of hits in per cent, 0 of nothing."""
    return F.coalesce(F.try_divide(F.col(hits) * 100.0, F.col(hits) + F.col(misses)), F.lit(0.0))


def mode(df: DataFrame, key: list[str], value: str, at: str) -> DataFrame:
    """The most frequent value; of ties the one seen first."""
    counts = df.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("_first"))
    return counts.groupBy(*key).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_first"))).alias("m")).select(*key, F.col(f"m.{value}").alias("dominant"), "m.n")


def spread(df: DataFrame, key: list[str], value: str, limit: float = 1.5) -> DataFrame:
    out = df.groupBy(*key).agg((F.max(value) - F.min(value)).alias("spread"))
    return out.withColumn("meets_target", F.col("spread") <= limit)


def json_rows(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """All rows of a key as a JSON array, in order: one value, so a key's rows have to fit one row."""
    rows = F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    kept = F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    return df.groupBy(*key).agg(F.to_json(kept).alias("rows"))


def health(services: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: share of healthy services and a status by the gravest recent alert. services: state, success_rate, failures; alerts: severity."""
    ok = (F.col("state") == "CLOSED") & (F.col("success_rate") > 0.8) & (F.col("failures") < 3)
    s = services.agg(F.count(F.lit(1)).alias("total_services"), F.count_if(ok).alias("healthy_services"))
    a = alerts.agg(F.count(F.lit(1)).alias("recent_alerts"), F.count_if(F.col("severity") == "critical").alias("critical_alerts"), F.count_if(F.col("severity") == "high").alias("high_alerts"))
    score = F.coalesce(F.try_divide(F.col("healthy_services") * 100.0, F.col("total_services")), F.lit(100.0))
    both = s.crossJoin(a).withColumn("health_score", score)  # one row each
    return both.withColumn("overall_status", F.when(F.col("critical_alerts") > 0, "critical").when(F.col("high_alerts") > 0, "degraded").when(F.col("health_score") < 80, "warning").otherwise("healthy"))


#: Of a sketch of this size, a quantile's true rank is within 1.65 hundredths of what was asked for, with 99 % confidence, however many sketches were merged.
SKETCH, SKETCH_ERROR = 200, 0.0165


def quantile_sketches(df: DataFrame, keys: list[str], at: str, value: str, size: int = SKETCH) -> DataFrame:
    """(keys, hour, n, total, least, most, sketch): what is kept of each hour's values, a few kilobytes whatever their number. Null values don't count."""
    v = F.col(value).cast("double")
    hour = F.date_trunc("hour", F.col(at).cast("timestamp")).alias("hour")
    return df.where(v.isNotNull()).groupBy(*keys, hour).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.kll_sketch_agg_double(v, size).alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: list[str], quantiles: dict[str, float], since: str | None = None, until: str | None = None) -> DataFrame:
    """(keys, n, mean, least, most, a column for each of ``quantiles``) over the hours from ``since`` to before ``until``, from their sketches alone. All but the quantiles is exact; for them see SKETCH_ERROR."""
    own = sketches
    own = own.where(F.col("hour") >= F.lit(since).cast("timestamp")) if since else own
    own = own.where(F.col("hour") < F.lit(until).cast("timestamp")) if until else own
    merged = own.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("_total"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch").alias("_sketch"))
    return merged.select(*keys, "n", (F.col("_total") / F.col("n")).alias("mean"), "least", "most", *[F.kll_sketch_get_quantile_double("_sketch", F.lit(float(q))).alias(name) for name, q in quantiles.items()])


def quantile_errors(df: DataFrame, keys: list[str], value: str, estimates: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """``estimates`` with name_error for each of ``quantiles``: how far the estimate's true ranks in ``df`` are from what was asked for, 0 if it stands at that rank."""
    v = F.col(value).cast("double")
    e = estimates.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(q).alias(f"_{q}") for q in quantiles])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = df.where(v.isNotNull()).join(e, same)
    counts = [x for q in quantiles for x in (F.count_if(v < F.col(f"_{q}")).alias(f"_{q}_below"), F.count_if(v <= F.col(f"_{q}")).alias(f"_{q}_upto"))]
    ranks = joined.groupBy(*[f"_{k}" for k in keys]).agg(F.count(F.lit(1)).alias("_all"), *counts)
    share = lambda name: F.col(name) / F.col("_all")
    errors = [F.greatest(share(f"_{q}_below") - p, F.lit(p) - share(f"_{q}_upto"), F.lit(0.0)).alias(f"{q}_error") for q, p in quantiles.items()]
    back = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return estimates.join(ranks, back).select(*estimates.columns, *errors)


def trailing_counts(df: DataFrame, key: list[str], at: str, seconds: dict[str, int]) -> DataFrame:
    """For each event, how many of its key came less than so many seconds before it, itself not counted."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(*key).orderBy(micros)
    return df.withColumns({name: F.count(F.lit(1)).over(w.rangeBetween(-s * 1_000_000 + 1, -1)) for name, s in seconds.items()})


def trailing_sum(df: DataFrame, key: list[str], at: str, value: str, seconds: int = 60, rows: int = 60) -> DataFrame:
    """Sum over the last ``seconds`` but at most the last ``rows`` events, the event itself included, at event times in milliseconds."""
    w = Window.partitionBy(*key).orderBy(at, "id").rowsBetween(1 - rows, 0)
    recent = F.collect_list(F.struct(F.col(at).alias("t"), F.col(value).alias("v"))).over(w)
    return df.withColumn("_h", recent).withColumn("trailing", F.aggregate(F.filter("_h", lambda x: F.col(at) - x["t"] <= seconds * 1000), F.lit(0.0), lambda s, x: s + x["v"])).drop("_h")
