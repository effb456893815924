"""Queries of single clauses and functions: projections, predicates, plain joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelane.functions import text
from tidelane.operators import highlights as hl
from tidelane.operators import relational as rel
from tidelane.plans.registry import query
from tidelane.plans.relational_queries import AS_OF
from tidelane.plans.text_queries import _words_sql
from tidelane.sources.tables import cte, source, table


@query("p2_star_projection", "SELECT * FROM orders WHERE o_orderstatus = 'P'")
def star_projection(s, d):
    return rel.find_many(source(s, d, "orders"), {"o_orderstatus": "P"})


@query("p5_coalesced_sums", cte("job", "cost") + "SELECT j.id, coalesce(sum(c.amount) FILTER (c.service = 'R'), 0)::DOUBLE AS returned, coalesce(max(j.run_seconds), -1) AS run_seconds FROM job j LEFT JOIN cost c ON j.id = c.job_id GROUP BY 1")
def coalesced_sums(s, d):
    c = table(s, d, "cost").where("service = 'R'").groupBy("job_id").agg(F.sum("amount").alias("returned"))
    j = table(s, d, "job").join(c, F.col("id") == F.col("job_id"), "left")
    return j.select("id", F.coalesce("returned", F.lit(0)).cast("double").alias("returned"), F.coalesce("run_seconds", F.lit(-1)).alias("run_seconds"))


@query("p6_in_list", cte("job") + "SELECT id, status FROM job WHERE status IN ('queued', 'processing') AND priority NOT IN ('1-URGENT', '5-LOW')")
def in_list(s, d):
    return table(s, d, "job").where(F.col("status").isin("queued", "processing") & ~F.col("priority").isin("1-URGENT", "5-LOW")).select("id", "status")


@query("p9_json_prefixes", "SELECT event_id FROM events WHERE props->>'k' LIKE '1%' OR props->>'experiment' LIKE 'exp-%' OR props->>'k' LIKE '7_'")
def json_prefixes(s, d):
    """A key that isn't there matches nothing."""
    key = lambda name: F.get_json_object("props", f"$.{name}")
    return source(s, d, "events").where(key("k").like("1%") | key("experiment").like("exp-%") | key("k").like("7_")).select("event_id")


@query("p18_legacy_duration", cte("segment") + "SELECT id, job_id, end_ms - start_ms AS duration_ms FROM segment WHERE (end_ms - start_ms) / 1000.0 BETWEEN 5 AND 60")
def legacy_duration(s, d):
    length = F.col("end_ms") - F.col("start_ms")
    return table(s, d, "segment").where((length / 1000.0).between(5, 60)).select("id", "job_id", length.alias("duration_ms"))


@query("j1_left_join", cte("job", "segment") + "SELECT j.id, j.status, s.id AS segment_id, s.score FROM job j LEFT JOIN segment s ON j.id = s.job_id AND s.enhanced")
def left_join(s, d):
    seg = table(s, d, "segment").where("enhanced").select("job_id", F.col("id").alias("segment_id"), "score")
    return table(s, d, "job").join(seg, F.col("id") == F.col("job_id"), "left").select("id", "status", "segment_id", "score")


@query("a1_counts", cte("job") + "SELECT owner, count(*) AS jobs, count(run_seconds) AS ended, count(CASE WHEN status = 'queued' THEN 1 END) AS queued FROM job GROUP BY 1")
def counts(s, d):
    return table(s, d, "job").groupBy("owner").agg(F.count(F.lit(1)).alias("jobs"), F.count("run_seconds").alias("ended"), F.count(F.when(F.col("status") == "queued", 1)).alias("queued"))


@query("a3_sums", cte("cost") + "SELECT service, sum(amount)::DOUBLE AS total, round(avg(amount), 6)::DOUBLE AS mean, min(amount)::DOUBLE AS least, max(amount)::DOUBLE AS most, sum(input_tokens)::BIGINT AS tokens, sum(duration_seconds) AS seconds, min(output_tokens) AS fewest FROM cost GROUP BY 1")
def sums(s, d):
    amount = F.col("amount")
    out = table(s, d, "cost").groupBy("service").agg(F.sum(amount).cast("double").alias("total"), F.round(F.avg(amount.cast("double")), 6).alias("mean"), F.min(amount).cast("double").alias("least"), F.max(amount).cast("double").alias("most"), F.sum("input_tokens").alias("tokens"), F.sum("duration_seconds").alias("seconds"), F.min("output_tokens").alias("fewest"))
    return out


@query("a29_grouping_sets", cte("cost") + "SELECT service, operation, grouping(service)::INTEGER AS over_services, grouping(operation)::INTEGER AS over_operations, sum(amount)::DOUBLE AS amount, count(*) AS n FROM cost GROUP BY CUBE (service, operation)")
def grouping_sets(s, d):
    c = table(s, d, "cost").cube("service", "operation")
    return c.agg(F.grouping("service").cast("int").alias("over_services"), F.grouping("operation").cast("int").alias("over_operations"), F.sum("amount").cast("double").alias("amount"), F.count(F.lit(1)).alias("n"))


@query("i4_uniqueness", f"""WITH w AS (SELECT item_id, list_distinct({_words_sql('lower(text)')}) AS w FROM benchmark), p AS (SELECT a.item_id, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS j FROM w a JOIN w b ON a.item_id <> b.item_id),
s AS (SELECT item_id, sum(j) AS s FROM p GROUP BY 1) SELECT w.item_id, round(greatest(0.1, 1.0 - 0.3 * coalesce(s, 0)), 6) AS uniqueness FROM w LEFT JOIN s USING (item_id)""")
def item_uniqueness(s, d):
    """All items of the benchmark as one key."""
    items = source(s, d, "benchmark").withColumn("key", F.lit(0))
    return hl.uniqueness(items, ["key"], tie="item_id").select("item_id", F.round("uniqueness", 6).alias("uniqueness"))


@query("f2_trimmed_words", f"WITH w AS (SELECT conv_id, turn, {_words_sql()} AS w FROM conversations) SELECT conv_id, turn, trim(lower(w[1]), '.,!?;:') AS first_word, len(list_filter(w, lambda x: regexp_matches(x, '[.!?]$'))) AS sentences FROM w WHERE len(w) > 0")
def trimmed_words(s, d):
    w = source(s, d, "conversations").select("conv_id", "turn", text.split_words("text").alias("w")).where(F.size("w") > 0)
    ends = F.filter("w", lambda x: x.endswith(".") | x.endswith("!") | x.endswith("?"))
    return w.select("conv_id", "turn", text.strip_punctuation(F.col("w")[0]).alias("first_word"), F.size(ends).cast("long").alias("sentences"))


@query("f10_intervals", f"SELECT o_orderkey AS id, o_orderdate > TIMESTAMP '{AS_OF}' - INTERVAL '90 days' AS recent, epoch(o_orderdate + INTERVAL '36 hours')::BIGINT AS due, o_orderdate + INTERVAL '30 days' < now()::TIMESTAMP AS expired FROM orders")
def intervals(s, d):
    at, now = F.col("o_orderdate").cast("timestamp"), F.lit(AS_OF).cast("timestamp")
    recent = at > now - F.make_interval(days=F.lit(90))
    return source(s, d, "orders").select(F.col("o_orderkey").alias("id"), recent.alias("recent"), F.unix_seconds(at + F.make_interval(hours=F.lit(36))).alias("due"), (at + F.make_interval(days=F.lit(30)) < F.current_timestamp()).alias("expired"))


@query("f18_formatted", cte("segment") + "SELECT id, job_id, printf('%.3f', score / 7) AS share, printf('%.3f|%s', end_ms / 1000.0, kind) AS label FROM segment")
def formatted(s, d):
    return table(s, d, "segment").select("id", "job_id", F.format_string("%.3f", F.col("score") / 7).alias("share"), F.format_string("%.3f|%s", F.col("end_ms") / 1000.0, F.col("kind")).alias("label"))


@query("t14_trigger_totals", cte("cost") + "SELECT job_id, sum(CASE WHEN service = 'A' THEN 0 WHEN service = 'R' THEN amount + 1 ELSE amount END)::DOUBLE AS total_cost FROM cost GROUP BY 1")
def trigger_totals(s, d):
    """Totals kept through inserts, updates (R costs one more) and deletes (A goes), without reading what didn't change."""
    cost = table(s, d, "cost")
    old = cost.where("operation = 'F'")
    totals = old.groupBy("job_id").agg(F.sum("amount").cast("decimal(22,2)").alias("total_cost"))
    inserts = cost.where("operation <> 'F'").select("job_id", F.lit(None).cast("decimal(12,2)").alias("before"), F.col("amount").alias("after"))
    updates = cost.where("service = 'R'").select("job_id", F.col("amount").alias("before"), (F.col("amount") + 1).cast("decimal(12,2)").alias("after"))
    deletes = cost.where("service = 'A'").select("job_id", F.col("amount").alias("before"), F.lit(None).cast("decimal(12,2)").alias("after"))
    return rel.apply_changes(totals, inserts.unionByName(updates).unionByName(deletes)).select("job_id", F.col("total_cost").cast("double").alias("total_cost"))
