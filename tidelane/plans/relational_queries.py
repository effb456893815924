"""Queries over jobs, segments, costs and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelane.operators import aggregates as agg
from tidelane.operators import experiments, relational as rel
from tidelane.plans.registry import query
from tidelane.sources.tables import cte, source, table

AS_OF = "2024-01-30 12:00:00"


def _d(df, *columns, digits=4):
    """Doubles of equal digits, for comparison."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


@query("a10_cost_analysis", cte("cost") + """SELECT service, operation, count(*) AS call_count, sum(amount)::DOUBLE AS total_cost, round(avg(amount)::DOUBLE, 4) AS avg_cost_per_call,
  sum(input_tokens)::BIGINT AS total_input_tokens, sum(output_tokens)::BIGINT AS total_output_tokens, sum(duration_seconds) AS total_duration_seconds FROM cost GROUP BY service, operation""")
def cost_analysis(s, d):
    return _d(rel.cost_analysis(table(s, d, "cost")), "avg_cost_per_call").withColumn("total_cost", F.col("total_cost").cast("double"))


@query("j2_active_jobs", cte("job", "segment", "cost") + """SELECT j.id, j.status, count(s.id) AS segment_count, round(avg(s.score), 4) AS avg_segment_score, sum(c.amount)::DOUBLE AS current_cost
  FROM job j LEFT JOIN segment s ON j.id = s.job_id LEFT JOIN cost c ON j.id = c.job_id WHERE j.status IN ('queued', 'processing') GROUP BY j.id, j.status""")
def active_jobs(s, d):
    return _d(rel.active_jobs(table(s, d, "job"), table(s, d, "segment"), table(s, d, "cost")), "avg_segment_score").withColumn("current_cost", F.col("current_cost").cast("double"))


_SUMMARY = """SELECT j.id, j.status, count(s.id) AS total_segments, count(CASE WHEN s.enhanced THEN 1 END) AS enhanced_segments, coalesce(sum(c.amount), 0)::DOUBLE AS total_cost,
  j.budget_limit::DOUBLE AS budget_limit, j.run_seconds AS processing_duration_seconds FROM job j LEFT JOIN segment s ON j.id = s.job_id LEFT JOIN cost c ON j.id = c.job_id GROUP BY j.id, j.status, j.budget_limit, j.run_seconds"""


def _doubles(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@query("j2_job_summary", cte("job", "segment", "cost") + _SUMMARY)
def job_summary(s, d):
    return _doubles(rel.job_summary(table(s, d, "job"), table(s, d, "segment"), table(s, d, "cost")), "total_cost", "budget_limit")


@query("j2_job_summary_corrected", cte("job", "segment", "cost") + """, sa AS (SELECT job_id, count(*) n, count(*) FILTER (enhanced) e FROM segment GROUP BY 1), ca AS (SELECT job_id, sum(amount) c FROM cost GROUP BY 1)
SELECT j.id, j.status, coalesce(n, 0) AS total_segments, coalesce(e, 0) AS enhanced_segments, coalesce(c, 0)::DOUBLE AS total_cost, j.budget_limit::DOUBLE AS budget_limit, j.run_seconds AS processing_duration_seconds
FROM job j LEFT JOIN sa ON j.id = sa.job_id LEFT JOIN ca ON j.id = ca.job_id""")
def job_summary_corrected(s, d):
    return _doubles(rel.job_summary(table(s, d, "job"), table(s, d, "segment"), table(s, d, "cost"), corrected=True), "total_cost", "budget_limit")


@query("a2_highlight_summary", cte("job", "segment") + """SELECT j.id, j.status, count(DISTINCT CASE WHEN s.enhanced THEN s.id END) AS highlight_count, count(DISTINCT s.id) AS segment_count,
  min(s.start_ms) FILTER (s.enhanced) AS first_start, max(s.end_ms) FILTER (s.enhanced) AS last_end FROM job j LEFT JOIN segment s ON j.id = s.job_id GROUP BY j.id, j.status""")
def highlight_summary(s, d):
    return rel.highlight_summary(table(s, d, "job"), table(s, d, "segment"))


@query("w1_top_segments", cte("job", "segment") + """SELECT s.id, s.job_id, s.start_ms, s.end_ms, s.score, s.enhanced, s.kind, j.status AS job_status, rank() OVER (PARTITION BY s.job_id ORDER BY s.score DESC) AS job_rank,
  rank() OVER (ORDER BY s.score DESC) AS global_rank FROM segment s JOIN job j ON s.job_id = j.id WHERE j.status = 'completed'""")
def top_segments(s, d):
    return rel.top_segments(table(s, d, "job"), table(s, d, "segment"))


@query("a11_performance_summary", cte("metric") + f"""SELECT component, stage, metric_name, count(*) AS measurement_count, round(avg(value), 4) AS avg_value, min(value) AS min_value, max(value) AS max_value,
  round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 4) AS median_value, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 4) AS p95_value
  FROM metric WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL '24 hours' GROUP BY component, stage, metric_name""")
def performance_summary(s, d):
    return _d(rel.performance_summary(table(s, d, "metric"), AS_OF), "avg_value", "median_value", "p95_value")


@query("a14_cost_efficiency", cte("job", "segment", "cost") + """SELECT id, round(CASE WHEN c > 0 THEN n / c ELSE n END, 8) AS efficiency FROM
  (SELECT j.id, count(s.id)::DOUBLE AS n, coalesce(sum(c.amount), 0)::DOUBLE AS c FROM job j LEFT JOIN segment s ON j.id = s.job_id LEFT JOIN cost c ON j.id = c.job_id GROUP BY j.id)""")
def cost_efficiency(s, d):
    return _d(rel.cost_efficiency(table(s, d, "job"), table(s, d, "segment"), table(s, d, "cost")), "efficiency", digits=8)


@query("a9_job_counts", cte("job") + """SELECT count(*) AS total_jobs, count(CASE WHEN status = 'completed' THEN 1 END) AS completed_jobs, count(CASE WHEN status = 'failed' THEN 1 END) AS failed_jobs, count(CASE WHEN status = 'processing' THEN 1 END) AS processing_jobs,
  count(CASE WHEN status = 'queued' THEN 1 END) AS queued_jobs, round(avg(run_seconds), 4) AS avg_processing_seconds FROM job""")
def job_counts(s, d):
    return _d(rel.job_counts(table(s, d, "job")), "avg_processing_seconds")


@query("a13_cost_breakdown", cte("cost") + "SELECT job_id, service, sum(amount)::DOUBLE AS cost, false AS is_total FROM cost GROUP BY 1, 2 UNION ALL SELECT job_id, NULL, sum(amount)::DOUBLE, true FROM cost GROUP BY 1")
def cost_breakdown(s, d):
    return _doubles(rel.cost_breakdown(table(s, d, "cost")), "cost")


@query("a12_maintained_totals", cte("job", "cost") + "SELECT j.id, coalesce(sum(c.amount), 0)::DOUBLE AS total_cost FROM job j LEFT JOIN cost c ON j.id = c.job_id GROUP BY j.id")
def maintained_totals(s, d):
    return _doubles(rel.maintained_totals(table(s, d, "job"), table(s, d, "cost")), "total_cost")


@query("s1_find_many", cte("job") + "SELECT id, owner, priority FROM job WHERE status = 'queued' AND priority = '1-URGENT'")
def find_many(s, d):
    return rel.find_many(table(s, d, "job"), {"status": "queued", "priority": "1-URGENT"}, order_by="id DESC").select("id", "owner", "priority")


@query("s4_find_one", cte("job") + "SELECT id, owner, status FROM job WHERE id = 7")
def find_one(s, d):
    return rel.find_one(table(s, d, "job"), {"id": 7}).select("id", "owner", "status")


@query("p1_null_equality", cte("job") + "SELECT count(*) AS n FROM job WHERE run_seconds = NULL")
def null_equality(s, d):
    return rel.count(table(s, d, "job"), {"run_seconds": None})


@query("s2_raw_sql", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def raw_sql(s, d):
    return s.sql("SELECT o_orderstatus AS status, count(*) AS n FROM {t} WHERE o_totalprice > :least GROUP BY 1", args={"least": 100000}, t=source(s, d, "orders"))


@query("o1_order_limit", cte("segment") + "SELECT id, job_id, score, start_ms FROM segment ORDER BY score DESC, id, start_ms LIMIT 25")
def order_limit(s, d):
    return table(s, d, "segment").orderBy(F.col("score").desc(), "id", "start_ms").limit(25).select("id", "job_id", "score", "start_ms")


@query("p7_between_in_like", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30' AND o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '1-%'")
def between_in_like(s, d):
    o = source(s, d, "orders")
    at = F.col("o_orderdate").cast("timestamp_ntz").between(F.expr("TIMESTAMP_NTZ '1996-01-01'"), F.expr("TIMESTAMP_NTZ '1996-06-30'"))
    return o.where(at & F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").like("1-%")).select("o_orderkey", "o_orderpriority")


@query("p8_recent_metrics", cte("metric") + f"SELECT metric_name, count(*) AS n FROM metric WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL '7 days' GROUP BY 1")
def recent_metrics(s, d):
    m = table(s, d, "metric")
    return m.where(F.col("ts") > F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 7 DAYS")).groupBy("metric_name").agg(F.count(F.lit(1)).alias("n"))


@query("p10_json_equality", "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events WHERE props->>'$.k' = '42' OR props->>'$.k' LIKE '9%'")
def json_equality(s, d):
    k = F.get_json_object("props", "$.k")
    return source(s, d, "events").where((k == "42") | k.like("9%")).select("event_id", k.cast("int").alias("k"))


@query("p13_violations", cte("job", "segment") + """SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT score BETWEEN 2 AND 48 THEN 'score' END, CASE WHEN NOT end_ms - start_ms >= 2000 THEN 'length' END, CASE WHEN NOT kind IN ('A', 'R') THEN 'kind' END], lambda x: x IS NOT NULL)) AS rule FROM segment) GROUP BY rule""")
def violations(s, d):
    rules = {"score": F.col("score").between(2, 48), "length": F.col("end_ms") - F.col("start_ms") >= 2000, "kind": F.col("kind").isin("A", "R")}
    return rel.violations(table(s, d, "segment"), rules).select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


#: What documents are held to say, in turn, before their own text.
_FRAGMENTS = ["plain words", "please select one", "it is done; next", "a UNION of two", "nothing here", "-- a note", "words /* in */ stars", "undeleted", "a quiet day"]
_SUSPECT = "concat(element_at(array(" + ", ".join(f"'{x}'" for x in _FRAGMENTS) + "), CAST(doc_id % " + str(len(_FRAGMENTS)) + " AS INT) + 1), ' ', text)"


@query("p16_suspicious_text", f"WITH t AS (SELECT doc_id, {_SUSPECT.replace('element_at(array(', 'list_extract(list_value(')} AS text FROM documents) SELECT doc_id FROM t WHERE regexp_matches(lower(text), 'drop|delete|insert|update|alter|create|exec|union|select|--|/\\*|\\*/|;')")
def suspicious_text(s, d):
    return source(s, d, "documents").selectExpr("doc_id", f"{_SUSPECT} AS text").where(rel.suspicious(F.col("text"))).select("doc_id")


@query("p4_case_coalesce", cte("job") + "SELECT CASE WHEN run_seconds IS NULL THEN 'open' WHEN run_seconds < 1800 THEN 'short' ELSE 'long' END AS band, count(*) AS n, sum(coalesce(run_seconds, 0))::BIGINT AS seconds FROM job GROUP BY 1")
def case_coalesce(s, d):
    band = F.when(F.col("run_seconds").isNull(), "open").when(F.col("run_seconds") < 1800, "short").otherwise("long")
    return table(s, d, "job").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("run_seconds", F.lit(0))).alias("seconds"))


@query("d2_upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'replaced' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -1 - c_custkey, 'new' FROM customer")
def upsert(s, d):
    old = source(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    new = old.where("id % 7 = 0").withColumn("status", F.lit("replaced")).unionByName(source(s, d, "customer").select((-1 - F.col("c_custkey")).alias("id"), F.lit("new").alias("status")))
    return rel.upsert(old, new, ["id"])


@query("d2_insert_if_absent", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders UNION ALL SELECT -1 - c_custkey, 'new' FROM customer")
def insert_if_absent(s, d):
    old = source(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    new = old.where("id % 7 = 0").withColumn("status", F.lit("ignored")).unionByName(source(s, d, "customer").select((-1 - F.col("c_custkey")).alias("id"), F.lit("new").alias("status")))
    return rel.upsert(old, new, ["id"], update=False)


@query("d3_update", cte("job") + "SELECT id, CASE WHEN status = 'queued' THEN 'processing' ELSE status END AS status FROM job")
def update(s, d):
    return rel.update(table(s, d, "job"), {"status": "processing"}, {"status": "queued"}).select("id", "status")


@query("d5_delete", cte("job") + "SELECT id, status FROM job WHERE NOT (status = 'completed' AND priority = '5-LOW')")
def delete(s, d):
    return rel.delete(table(s, d, "job"), {"status": "completed", "priority": "5-LOW"}).select("id", "status")


@query("d9_cascade", cte("job", "segment") + "SELECT s.id, s.job_id FROM segment s WHERE s.job_id IN (SELECT id FROM job WHERE status <> 'queued')")
def cascade(s, d):
    return rel.cascade(table(s, d, "segment"), table(s, d, "job").where("status <> 'queued'"), "job_id", "id").select("id", "job_id")


@query("t9_retention", cte("metric") + f"SELECT event_id FROM metric WHERE NOT (metric_name = 'error' AND ts < TIMESTAMP '{AS_OF}' - INTERVAL '10 days')")
def retention(s, d):
    return rel.expire(table(s, d, "metric"), "ts", AS_OF, 10, F.col("metric_name") == "error").select("event_id")


@query("s9_live_entries", f"""WITH e AS (SELECT event_type AS namespace, CASE WHEN length(props || user_id) > 200 THEN sha256(props || user_id) ELSE props || user_id END AS key, value, ts + INTERVAL '6 days' AS expires_at, ts FROM events)
SELECT namespace, key, value FROM (SELECT *, row_number() OVER (PARTITION BY namespace, key ORDER BY ts DESC) AS r FROM e) WHERE r = 1 AND expires_at > TIMESTAMP '{AS_OF}'""")
def live_entries(s, d):
    e = source(s, d, "events").select(F.col("event_type").alias("namespace"), F.concat("props", F.col("user_id").cast("string")).alias("key"), "value", F.col("ts").cast("timestamp").alias("written_at"))
    return rel.resolve_cached(e.withColumn("expires_at", F.col("written_at") + F.expr("INTERVAL 6 DAYS")), AS_OF).select("namespace", "key", "value")


_STAGES = ["view", "click", "signup", "purchase"]


@query("o13_last_stage", "SELECT user_id, CASE max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END) WHEN 1 THEN 'view' WHEN 2 THEN 'click' WHEN 3 THEN 'signup' ELSE 'purchase' END AS last_stage FROM events WHERE event_type <> 'error' GROUP BY 1")
def last_stage(s, d):
    return rel.last_stage(source(s, d, "events"), _STAGES, "user_id", "event_type")


# --- aggregates ---


@query("a4_percentile_cont", "SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95 FROM events GROUP BY 1")
def percentile_cont(s, d):
    return source(s, d, "events").groupBy("event_type").agg(F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY value)"), 6).alias("p50"), F.round(F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY value)"), 6).alias("p95"))


@query("a5_index_percentile", "SELECT event_type, list_sort(list(value))[least(floor(count(*) * 0.95)::BIGINT, count(*) - 1) + 1] AS p95 FROM events GROUP BY 1")
def index_percentile(s, d):
    return agg.index_percentile_of(source(s, d, "events"), ["event_type"], "value", 0.95, "p95")


@query("a6_percentile_threshold", "WITH t AS (SELECT event_type, quantile_cont(value, 0.75) AS q FROM events GROUP BY 1) SELECT e.event_id FROM events e JOIN t USING (event_type) WHERE e.value > t.q")
def percentile_threshold(s, d):
    e = source(s, d, "events")
    return e.join(e.groupBy("event_type").agg(F.percentile("value", F.lit(0.75)).alias("q")), "event_type").where("value > q").select("event_id")


_BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


@query("a8_histogram", "SELECT event_type, b.le AS le, count(*) FILTER (value <= b.le) AS count FROM events, (SELECT unnest([5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 'inf'::DOUBLE]::DOUBLE[]) AS le) b GROUP BY 1, 2")
def histogram(s, d):
    return agg.histogram(source(s, d, "events"), ["event_type"], "value", _BOUNDS)


@query("a7_histogram_quantile", """WITH h AS (SELECT event_type, b.le AS le, count(*) FILTER (value <= b.le) AS c FROM events, (SELECT unnest([5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 'inf'::DOUBLE]::DOUBLE[]) AS le) b GROUP BY 1, 2),
w AS (SELECT *, coalesce(lag(le) OVER o, 0) AS lo, coalesce(lag(c) OVER o, 0) AS before, max(c) OVER (PARTITION BY event_type) AS n FROM h WINDOW o AS (PARTITION BY event_type ORDER BY le)),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS r FROM w WHERE c >= n * 0.95) SELECT event_type, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (n * 0.95 - before) / (c - before) END, 6) AS quantile FROM f WHERE r = 1""")
def histogram_quantile(s, d):
    return _d(agg.histogram_quantile(agg.histogram(source(s, d, "events"), ["event_type"], "value", _BOUNDS), ["event_type"], 0.95), "quantile", digits=6)


@query("a22_last_n_summary", "SELECT user_id, max_by(value, ts) AS current, round(avg(value) FILTER (r <= 10), 6) AS recent_avg, max(value) AS peak, count(*) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) GROUP BY 1")
def last_n_summary(s, d):
    return _d(agg.last_n_summary(source(s, d, "events"), ["user_id"], "ts", "value"), "recent_avg", digits=6)


@query("a23_diversity", "SELECT *, CASE WHEN distinct_values = 1 AND n > 1 THEN 'identical' WHEN distinct_values < n * 0.7 THEN 'low' ELSE 'fine' END AS diversity FROM (SELECT user_id, count(DISTINCT printf('%.3f', value)) AS distinct_values, count(value) AS n FROM events GROUP BY 1)")
def diversity(s, d):
    return agg.diversity(source(s, d, "events"), ["user_id"], "value")


@query("a24_spread", "SELECT user_id, round(max(value) - min(value), 6) AS spread, max(value) - min(value) <= 150 AS meets_target FROM events GROUP BY 1")
def spread(s, d):
    return _d(agg.spread(source(s, d, "events"), ["user_id"], "value", 150), "spread", digits=6)


@query("a17_dominant", "SELECT user_id, event_type AS dominant, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)) WHERE r = 1")
def dominant(s, d):
    return agg.mode(source(s, d, "events"), ["user_id"], "event_type", "event_id")


@query("a25_duplicate_groups", r"SELECT md5(trim(regexp_replace(lower(text), '[ \t\n\r\f\x0b]+', ' ', 'g'))) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(s, d):
    return agg.duplicate_groups(source(s, d, "documents"), "text", "doc_id")


@query("a26_hit_rate", "SELECT user_id, round(coalesce(count(*) FILTER (event_type = 'view') * 100.0 / nullif(count(*) FILTER (event_type IN ('view', 'error')), 0), 0), 6) AS hit_rate FROM events GROUP BY 1")
def hit_rate(s, d):
    c = source(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("h"), F.count_if(F.col("event_type") == "error").alias("m"))
    return c.select("user_id", F.round(agg.rate("h", "m"), 6).alias("hit_rate"))


@query("a27_json_rows", "SELECT r_regionkey AS region, to_json(list({'n_nationkey': n_nationkey, 'n_name': n_name} ORDER BY n_nationkey))::VARCHAR AS rows FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def json_rows(s, d):
    n = source(s, d, "nation").join(source(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return agg.json_rows(n.withColumn("region", F.col("r_regionkey")), ["region"], ["n_nationkey"], ["n_nationkey", "n_name"])


_SERVICE = "SELECT user_id, count(*) FILTER (event_type <> 'error') / count(*) AS success_rate, count(*) FILTER (event_type = 'error' AND value > 60) AS failures, CASE WHEN count(*) FILTER (event_type = 'error') > 18 THEN 'OPEN' ELSE 'CLOSED' END AS state FROM events GROUP BY 1"


@query("a28_health", f"""WITH sv AS ({_SERVICE}), al AS (SELECT CASE WHEN value > 200 THEN 'critical' WHEN value > 100 THEN 'high' ELSE 'low' END AS severity FROM events WHERE event_type = 'error'),
x AS (SELECT count(*) AS total_services, count(*) FILTER (state = 'CLOSED' AND success_rate > 0.8 AND failures < 3) AS healthy_services FROM sv), y AS (SELECT count(*) AS recent_alerts, count(*) FILTER (severity = 'critical') AS critical_alerts, count(*) FILTER (severity = 'high') AS high_alerts FROM al)
SELECT *, round(healthy_services * 100.0 / total_services, 6) AS health_score, CASE WHEN critical_alerts > 0 THEN 'critical' WHEN high_alerts > 0 THEN 'degraded' WHEN healthy_services * 100.0 / total_services < 80 THEN 'warning' ELSE 'healthy' END AS overall_status FROM x, y""")
def health(s, d):
    e = source(s, d, "events")
    error = F.col("event_type") == "error"
    services = e.groupBy("user_id").agg((F.count_if(~error) / F.count(F.lit(1))).alias("success_rate"), F.count_if(error & (F.col("value") > 60)).alias("failures"), F.when(F.count_if(error) > 18, "OPEN").otherwise("CLOSED").alias("state"))
    alerts = e.where(error).select(F.when(F.col("value") > 200, "critical").when(F.col("value") > 100, "high").otherwise("low").alias("severity"))
    return _d(agg.health(services, alerts), "health_score", digits=6)


@query("w8_trailing_counts", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND INTERVAL '0.000001 seconds' PRECEDING) AS last_hour,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND INTERVAL '0.000001 seconds' PRECEDING) AS last_day FROM events""")
def trailing_counts(s, d):
    return agg.trailing_counts(source(s, d, "events"), ["user_id"], "ts", {"last_hour": 3600, "last_day": 86400}).select("event_id", "last_hour", "last_day")


@query("w7_trailing_sum", cte("span") + """SELECT id, round(list_sum(list_transform(list_filter(h, lambda x: start_ms - x.t <= 36000000), lambda x: x.v)), 4) AS trailing FROM
  (SELECT id, start_ms, list({'t': start_ms, 'v': value}) OVER (PARTITION BY key ORDER BY start_ms, id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS h FROM span)""")
def trailing_sum(s, d):
    return _d(agg.trailing_sum(table(s, d, "span"), ["key"], "start_ms", "value", seconds=36000).select("id", "trailing"), "trailing")


# --- experiments and gates ---


@query("f8_variants", """WITH b AS (SELECT user_id, md5(user_id || ':speed') AS h FROM (SELECT DISTINCT user_id FROM events)), q AS (SELECT user_id, ((('0x' || substr(h, 1, 8))::BIGINT % 100 * 96 + ('0x' || substr(h, 9, 8))::BIGINT) % 100 * 96 + ('0x' || substr(h, 17, 8))::BIGINT) % 100 AS r, ('0x' || substr(h, 25, 8))::BIGINT AS l FROM b)
SELECT user_id, ((r * 96 + l) % 100 + 1)::INTEGER AS bucket, CASE WHEN (r * 96 + l) % 100 + 1 <= 30 THEN 'experimental' ELSE 'control' END AS variant FROM q""")
def variants(s, d):
    return experiments.assign(source(s, d, "events").select("user_id").distinct(), "user_id", "speed", 30)


_EXPERIMENT = """, v AS (SELECT *, CASE WHEN key % 3 = 0 THEN 'experimental' ELSE 'control' END AS variant FROM span), m AS (SELECT variant, unnest([{'metric': 'cost', 'v': value}, {'metric': 'score', 'v': k::DOUBLE}, {'metric': 'length', 'v': CASE WHEN kind = 'error' THEN NULL ELSE value * 2 END}], recursive := true) FROM v),
c AS (SELECT metric, avg(v) FILTER (variant = 'control') AS cm, avg(v) FILTER (variant = 'experimental') AS em, count(v) FILTER (variant = 'control') AS control_count, count(v) FILTER (variant = 'experimental') AS experimental_count FROM m GROUP BY 1) """


def _experiment(s, d):
    v = table(s, d, "span").withColumn("variant", F.when(F.col("key") % 3 == 0, "experimental").otherwise("control"))
    v = v.select("variant", F.col("value").alias("cost"), F.col("k").alias("score"), F.when(F.col("kind") != "error", F.col("value") * 2).alias("length"))
    return experiments.significance(experiments.compare(v, ["cost", "score", "length"]))


@query("a15_a16_comparison", cte("span") + _EXPERIMENT + """SELECT metric, round(cm, 6) AS control_mean, round(em, 6) AS experimental_mean, control_count, experimental_count, round((em - cm) / cm, 6) AS improvement, control_count + experimental_count AS sample_size,
  CASE WHEN control_count + experimental_count >= 200 THEN 0.95 WHEN control_count + experimental_count >= 100 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence, control_count + experimental_count >= 200 AND abs((em - cm) / cm) >= 0.02 AS is_significant FROM c""")
def comparison(s, d):
    return _d(_experiment(s, d), "control_mean", "experimental_mean", "improvement", "confidence", digits=6)


@query("r19_decision", cte("span") + _EXPERIMENT + """, t AS (SELECT metric, (em - cm) / cm AS i, control_count + experimental_count >= 200 AND abs((em - cm) / cm) >= 0.02 AS sig FROM c), a AS (SELECT count(*) AS metrics, count(*) FILTER (sig AND i > 0) AS improved, count(*) FILTER (i < -0.02) AS fallen, max(i) FILTER (metric = 'cost') AS ratio FROM t)
SELECT metrics, improved, fallen, round(ratio, 6) AS cost_increase_ratio, CASE WHEN improved >= metrics // 2 AND ratio <= 0.1 THEN 'promote' WHEN improved >= metrics // 2 THEN 'cost_exceeded' WHEN fallen > 0 THEN 'fail' ELSE 'continue' END AS decision FROM a""")
def decision(s, d):
    return _d(experiments.decide(_experiment(s, d)), "cost_increase_ratio", digits=6)


@query("r18_gate", """WITH a AS (SELECT percentile_cont(0.99) WITHIN GROUP (ORDER BY value) AS p, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) AS e, avg(value) AS c FROM events),
v AS (SELECT list_filter([CASE WHEN NOT c <= 80 THEN 'cpu' END, CASE WHEN NOT e < 0.25 THEN 'errors' END, CASE WHEN NOT p <= 120 THEN 'p99' END], lambda x: x IS NOT NULL) AS violations FROM a)
SELECT len(violations) AS failed, violations, CASE WHEN len(violations) = 0 THEN 'PASS' WHEN len(violations) <= 1 AND NOT list_contains(violations, 'errors') THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM v""")
def gate(s, d):
    a = source(s, d, "events").agg(F.percentile("value", F.lit(0.99)).alias("p99"), F.avg((F.col("event_type") == "error").cast("double")).alias("errors"), F.avg("value").alias("cpu"))
    limits = [("p99", "<=", 120.0), ("errors", "<", 0.25), ("cpu", "<=", 80.0)]
    checks = a.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value"), F.lit(o).alias("op"), F.lit(t).alias("threshold")) for n, o, t in limits])).alias("c")).select("c.*")
    return experiments.gate(checks, lenient=1, hard=("errors",))


@query("p17_order_clause", cte("job") + "SELECT id, run_seconds FROM job ORDER BY run_seconds DESC NULLS FIRST, id")
def order_clause(s, d):
    jobs = table(s, d, "job")
    return jobs.orderBy(rel.ordering(jobs, "run_seconds DESC"), "id").select("id", "run_seconds")


@query("j3_star_join", "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def star_join(s, d):
    facts = source(s, d, "lineitem").join(source(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(source(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = facts.join(source(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("f20_url_checks", "SELECT page_id, regexp_matches(url, '^https?://[a-zA-Z0-9.-]+(:[0-9]+)?(/[^\\s]*)?$') AS ok FROM pages")
def url_checks(s, d):
    from tidelane.functions.text import well_formed

    return source(s, d, "pages").select("page_id", well_formed(F.col("url"), "url").alias("ok"))


@query("r26_pressure", "SELECT event_id, CASE WHEN value >= 90 THEN 'critical' WHEN value >= 80 THEN 'high' WHEN value >= 70 THEN 'moderate' ELSE 'low' END AS level FROM events")
def pressure(s, d):
    from tidelane.functions.scoring import pressure as level

    return source(s, d, "events").select("event_id", level(F.col("value")).alias("level"))
