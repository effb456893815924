"""Dictionary queries, views, and table maintenance over DataFrames."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.storage import materialize

# What an identifier and an ordering may look like.
IDENTIFIER = re.compile(r"[a-zA-Z][a-zA-Z0-9_]{0,63}")
ORDERING = re.compile(r"\s*([a-zA-Z][a-zA-Z0-9_]*)(?:\s+(ASC|DESC))?\s*", re.I)
FORBIDDEN = ("drop", "delete", "insert", "update", "alter", "create", "exec", "union", "select", "--", "/*", "*/", ";")


def known_column(df: DataFrame, name: str) -> Column:
    """The column of that name, or ValueError: names come from the table's own schema."""
    if not IDENTIFIER.fullmatch(name) or name not in df.columns:
        raise ValueError(f"unknown column: {name!r}")
    return F.col(name)


def matches(df: DataFrame, where: Mapping[str, object] | None) -> Column:
    """Conjunction of equalities; a None matches nothing, as ``= NULL`` does."""
    return reduce(lambda a, b: a & b, (known_column(df, c) == F.lit(v) for c, v in (where or {}).items()), F.lit(True))


def ordering(df: DataFrame, clause: str) -> Column:
    """One column, ascending with nulls last or descending with nulls first."""
    m = ORDERING.fullmatch(clause)
    if not m:
        raise ValueError(f"not an ordering: {clause!r}")
    column = known_column(df, m[1])
    return column.desc_nulls_first() if (m[2] or "").upper() == "DESC" else column.asc_nulls_last()


def find_many(df: DataFrame, where: Mapping[str, object] | None = None, order_by: str | None = None, limit: int | None = None) -> DataFrame:
    out = df.where(matches(df, where))
    out = out.orderBy(ordering(df, order_by)) if order_by else out
    return out.limit(limit) if limit is not None else out


def find_one(df: DataFrame, where: Mapping[str, object]) -> DataFrame:
    return find_many(df, where, limit=1)


def count(df: DataFrame, where: Mapping[str, object] | None = None) -> DataFrame:
    return df.where(matches(df, where)).agg(F.count(F.lit(1)).alias("n"))


def suspicious(column: Column) -> Column:
    """Whether a text holds an SQL fragment."""
    low = F.lower(column)
    return reduce(lambda a, b: a | b, (low.contains(x) for x in FORBIDDEN))


# --- maintenance: each returns the table's new content ---


def upsert(df: DataFrame, rows: DataFrame, key: list[str], update: bool = True) -> DataFrame:
    """Rows replace (or, without ``update``, yield to) those of equal key; of rows with equal keys the last by position is not defined, so they must be distinct."""
    new, old = (rows, df.join(rows.select(*key), key, "left_anti")) if update else (rows.join(df.select(*key), key, "left_anti"), df)
    return old.unionByName(new, allowMissingColumns=True)


def insert_returning(df: DataFrame, rows: DataFrame, id_: str, order: list[str]) -> DataFrame:
    """``rows`` with ids that go on from the greatest of ``df`` (0 of none), in an order: ranks in range partitions and their prefix sums, no single task."""
    cut = materialize(rows.drop(id_).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "inserted")
    w = Window.partitionBy("_p").orderBy(*order)
    bases = cut.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = bases.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row a partition
    last = df.agg(F.coalesce(F.max(id_), F.lit(0)).cast("long").alias("_last"))
    numbered = cut.withColumn("_r", F.row_number().over(w)).join(base, "_p").crossJoin(last)  # one row
    return numbered.withColumn(id_, F.col("_last") + F.col("_base") + F.col("_r")).drop("_p", "_r", "_base", "_last")


def restore(first: DataFrame, second: DataFrame, key: list[str], as_of: str) -> tuple[DataFrame, DataFrame]:
    """Checkpoints (key, data, expires_at, written_at) of two tiers: the newest live one of the first, else of the second; and what has to be written to the first again."""
    live = first.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp")))
    newest = lambda df: df.groupBy(*key).agg(F.max_by("data", "written_at").alias("data"))
    missing = newest(second).join(live.select(*key), key, "left_anti")
    found = newest(live).withColumn("tier", F.lit(1)).unionByName(missing.withColumn("tier", F.lit(2)))
    return found, missing


def update(df: DataFrame, values: Mapping[str, object], where: Mapping[str, object]) -> DataFrame:
    if not where:
        raise ValueError("an update needs a condition")
    hit = F.coalesce(matches(df, where), F.lit(False))
    return df.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(known_column(df, c)) for c, v in values.items()})


def delete(df: DataFrame, where: Mapping[str, object]) -> DataFrame:
    if not where:
        raise ValueError("a delete needs a condition")
    return df.where(~F.coalesce(matches(df, where), F.lit(False)))


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is there."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def expire(df: DataFrame, column: str, as_of: str, days: int = 0, when: Column | None = None) -> DataFrame:
    """Rows that are kept when those older than ``as_of`` less ``days`` go (of those for which ``when`` holds)."""
    old = F.col(column) < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return df.where(~F.coalesce(old if when is None else old & when, F.lit(False)))


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds ``violations``, the names of the rules that a row breaks; an unknown outcome breaks none."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()])))


# --- views ---


def active_jobs(jobs: DataFrame, segments: DataFrame, costs: DataFrame) -> DataFrame:
    """Both child joins fan out, as the view's definition has it: counts and sums are over pairs of children."""
    s = segments.groupBy("job_id").agg(F.count("id").alias("ns"), F.count("score").alias("nscore"), F.sum("score").alias("sscore"))
    c = costs.groupBy("job_id").agg(F.count(F.lit(1)).alias("nc"), F.sum("amount").alias("sc"))
    j = jobs.where(F.col("status").isin("queued", "processing")).withColumnRenamed("id", "job_id")
    both = j.join(s, "job_id", "left").join(c, "job_id", "left")
    # the product of two groups needs no join of their rows: counts multiply, sums scale by the other side's count
    times_s, times_c = F.greatest(F.coalesce("ns", F.lit(0)), F.lit(1)), F.greatest(F.coalesce("nc", F.lit(0)), F.lit(1))
    return both.select(F.col("job_id").alias("id"), "status", (F.coalesce("ns", F.lit(0)) * times_c).alias("segment_count"), (F.col("sscore") / F.col("nscore")).alias("avg_segment_score"), (F.col("sc") * times_s).alias("current_cost"))


def job_summary(jobs: DataFrame, segments: DataFrame, costs: DataFrame, corrected: bool = False) -> DataFrame:
    """Fanned out as defined, or ``corrected`` to count each child once."""
    s = segments.groupBy("job_id").agg(F.count("id").alias("ns"), F.count_if("enhanced").alias("ne"))
    c = costs.groupBy("job_id").agg(F.count(F.lit(1)).alias("nc"), F.sum("amount").alias("sc"))
    both = jobs.withColumnRenamed("id", "job_id").join(s, "job_id", "left").join(c, "job_id", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    one = F.lit(1)
    by_c, by_s = (one, one) if corrected else (F.greatest(zero("nc"), one), F.greatest(zero("ns"), one))
    return both.select(F.col("job_id").alias("id"), "status", (zero("ns") * by_c).alias("total_segments"), (zero("ne") * by_c).alias("enhanced_segments"), (zero("sc") * by_s).alias("total_cost"), "budget_limit", F.col("run_seconds").alias("processing_duration_seconds"))


def highlight_summary(jobs: DataFrame, segments: DataFrame) -> DataFrame:
    """Distinct highlights (enhanced segments) and segments of a job, and the highlights' bounds."""
    s = segments.groupBy("job_id").agg(F.countDistinct(F.when(F.col("enhanced"), F.col("id"))).alias("h"), F.countDistinct("id").alias("s"), F.min(F.when(F.col("enhanced"), F.col("start_ms"))).alias("first_start"), F.max(F.when(F.col("enhanced"), F.col("end_ms"))).alias("last_end"))
    j = jobs.withColumnRenamed("id", "job_id").join(s, "job_id", "left")
    return j.select(F.col("job_id").alias("id"), "status", F.coalesce("h", F.lit(0)).alias("highlight_count"), F.coalesce("s", F.lit(0)).alias("segment_count"), "first_start", "last_end")


def global_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """RANK() over the whole table by ``value`` descending, without one task: ranks of distinct values by range partitions and their prefix sums, joined back."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    # stored, so that a range is the same one in its numbers and in its sum
    ordered = materialize(counts.repartitionByRange(F.col(value).desc_nulls_first()).withColumn("_p", F.spark_partition_id()), "rank-ranges")
    ordered = ordered.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy(F.col(value).desc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bases = ordered.groupBy("_p").agg(F.sum("_n").alias("_t"))
    base = bases.withColumn("_base", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_base")  # a row a partition
    ranks = ordered.join(base, "_p").select(F.col(value).alias("_v"), (F.col("_base") + F.col("_before") + 1).alias(name))
    return df.join(ranks, df[value].eqNullSafe(ranks["_v"])).drop("_v")


def top_segments(jobs: DataFrame, segments: DataFrame) -> DataFrame:
    done = jobs.where("status = 'completed'").select(F.col("id").alias("job_id"), F.col("status").alias("job_status"))
    rows = segments.join(done, "job_id")
    rows = rows.withColumn("job_rank", F.rank().over(Window.partitionBy("job_id").orderBy(F.col("score").desc_nulls_first())))
    return global_rank(rows, "score", "global_rank")


def cost_analysis(costs: DataFrame) -> DataFrame:
    return costs.groupBy("service", "operation").agg(
        F.count(F.lit(1)).alias("call_count"),
        F.sum("amount").alias("total_cost"),
        F.avg("amount").alias("avg_cost_per_call"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum("duration_seconds").alias("total_duration_seconds"),
    ).orderBy(F.col("total_cost").desc())


def performance_summary(metrics: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    recent = metrics.where(F.col("ts") > F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours)))
    value = F.col("value")
    return recent.groupBy("component", "stage", "metric_name").agg(
        F.count(F.lit(1)).alias("measurement_count"), F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY value)").alias("median_value"), F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY value)").alias("p95_value")
    )


def cost_efficiency(jobs: DataFrame, segments: DataFrame, costs: DataFrame) -> DataFrame:
    """Segments a unit of cost over the fanned-out join, or the count where nothing was spent."""
    v = job_summary(jobs, segments, costs)
    n, cost = F.col("total_segments").cast("double"), F.col("total_cost").cast("double")
    return v.select("id", F.when(cost > 0, n / cost).otherwise(n).alias("efficiency"))


def job_counts(jobs: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    return jobs.agg(F.count(F.lit(1)).alias("total_jobs"), is_("completed").alias("completed_jobs"), is_("failed").alias("failed_jobs"), is_("processing").alias("processing_jobs"), is_("queued").alias("queued_jobs"), F.avg("run_seconds").alias("avg_processing_seconds"))


def cost_breakdown(costs: DataFrame) -> DataFrame:
    """Costs by job and service, with a row of service NULL for each job's total."""
    return costs.rollup("job_id", "service").agg(F.sum("amount").alias("cost"), F.grouping_id().alias("_g")).where("_g < 3").select("job_id", "service", "cost", (F.col("_g") == 1).alias("is_total"))


def maintained_totals(jobs: DataFrame, costs: DataFrame) -> DataFrame:
    """Each job's total cost, zero without any."""
    c = costs.groupBy("job_id").agg(F.sum("amount").alias("total_cost"))
    return jobs.select(F.col("id").alias("job_id")).join(c, "job_id", "left").select(F.col("job_id").alias("id"), F.coalesce("total_cost", F.lit(0)).cast("decimal(22,2)").alias("total_cost"))


def apply_changes(totals: DataFrame, changes: DataFrame, key: str = "job_id", total: str = "total_cost") -> DataFrame:
    """Totals after changes to the rows that they sum (key, before, after: null before is an insert, null after a delete): each total moves by what its rows moved, and no other row is read.

    A row that went to another key is a delete there and an insert here. Keys that have no total yet begin at 0.
    """
    kind = totals.schema[total].dataType
    zero = F.lit(0)
    moved = changes.groupBy(key).agg(F.sum(F.coalesce("after", zero) - F.coalesce("before", zero)).alias("_moved"))
    return totals.join(moved, key, "full").select(key, (F.coalesce(total, zero) + F.coalesce("_moved", zero)).cast(kind).alias(total))


def last_stage(checkpoints: DataFrame, stages: list[str], key: str = "job_id", stage: str = "stage") -> DataFrame:
    """Each key's furthest stage in a fixed order; unknown stages don't count."""
    at = F.array_position(F.array(*map(F.lit, stages)), F.col(stage))
    return checkpoints.where(at > 0).groupBy(key).agg(F.max_by(stage, at).alias("last_stage"))


def resolve_cached(entries: DataFrame, as_of: str) -> DataFrame:
    """Live entries of a keyed store: keys over 200 characters by their hash, the newest of each key, unless it has expired."""
    key = F.when(F.length("key") > 200, F.sha2("key", 256)).otherwise(F.col("key"))
    newest = entries.groupBy("namespace", key.alias("key")).agg(F.max_by(F.struct("value", "expires_at"), "written_at").alias("e"))
    return newest.where(F.col("e.expires_at") > F.lit(as_of).cast("timestamp")).select("namespace", "key", "e.value", "e.expires_at")
