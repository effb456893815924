"""Experiments and service levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.text import variant_bucket

MIN_SAMPLE, MIN_EFFECT = 30, 0.02


def assign(df: DataFrame, job: str, experiment: str, percent: int) -> DataFrame:
    """Adds bucket (1 to 100) and variant."""
    bucket = variant_bucket(F.col(job), experiment)
    return df.withColumn("bucket", bucket).withColumn("variant", F.when(F.col("bucket") <= percent, "experimental").otherwise("control"))


def compare(df: DataFrame, metrics: list[str], variant: str = "variant") -> DataFrame:
    """One scan: for each metric that both variants have, means, counts and the relative lift (0 if the control's mean isn't positive)."""
    long = df.select(variant, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")).select(variant, "m.*").where("v IS NOT NULL")
    side = lambda name: F.when(F.col(variant) == name, F.col("v"))
    out = long.groupBy("metric").agg(F.avg(side("control")).alias("control_mean"), F.avg(side("experimental")).alias("experimental_mean"), F.count(side("control")).alias("control_count"), F.count(side("experimental")).alias("experimental_count"))
    out = out.where("control_count > 0 AND experimental_count > 0")
    return out.withColumn("improvement", F.when(F.col("control_mean") > 0, (F.col("experimental_mean") - F.col("control_mean")) / F.col("control_mean")).otherwise(0.0))


def significance(comparison: DataFrame, min_confidence: float = 0.95) -> DataFrame:
    n = F.col("control_count") + F.col("experimental_count")
    confidence = F.when(n >= 200, 0.95).when(n >= 100, 0.90).otherwise(0.80)
    ok = (n >= MIN_SAMPLE) & (F.abs("improvement") >= MIN_EFFECT) & (confidence >= min_confidence)
    return comparison.withColumns({"sample_size": n, "confidence": confidence, "is_significant": ok})


def decide(tested: DataFrame, max_cost_increase: float = 0.1, cost_metric: str = "cost") -> DataFrame:
    """One row: promote if half of the metrics, rounded down, improve significantly and cost doesn't grow too much; else fail if any falls by two per cent, significant or not; else go on."""
    a = tested.agg(F.count(F.lit(1)).alias("metrics"), F.count_if(F.col("is_significant") & (F.col("improvement") > 0)).alias("improved"), F.count_if(F.col("improvement") < -MIN_EFFECT).alias("fallen"), F.coalesce(F.max(F.when(F.col("metric") == cost_metric, F.col("improvement"))), F.lit(0.0)).alias("cost_increase_ratio"))
    enough = F.col("improved") >= F.floor(F.col("metrics") / 2)
    return a.withColumn("decision", F.when(F.col("metrics") == 0, "insufficient_data").when(enough & (F.col("cost_increase_ratio") <= max_cost_increase), "promote").when(enough, "cost_exceeded").when(F.col("fallen") > 0, "fail").otherwise("continue"))


def gate(checks: DataFrame, lenient: int = 0, hard: tuple[str, ...] = ()) -> DataFrame:
    """One row from checks (name, value, op, threshold): PASS, PARTIAL if at most ``lenient`` fail and none that is hard, or FAIL."""
    v, t = F.col("value"), F.col("threshold")
    ok: Column = F.when(F.col("op") == "<=", v <= t).when(F.col("op") == "<", v < t).when(F.col("op") == ">=", v >= t).when(F.col("op") == ">", v > t).otherwise(v == t)
    tested = checks.withColumn("passed", F.coalesce(ok, F.lit(False)))
    out = tested.agg(F.count_if(~F.col("passed")).alias("failed"), F.count_if(~F.col("passed") & F.col("name").isin(*hard)).alias("failed_hard"), F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("name")))).alias("violations"))
    return out.withColumn("status", F.when(F.col("failed") == 0, "PASS").when((F.col("failed") <= lenient) & (F.col("failed_hard") == 0), "PARTIAL").otherwise("FAIL")).drop("failed_hard")
