"""Queries over voices, stories and the catalogue of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelane.functions import text
from tidelane.operators import aggregates, clustering, stored
from tidelane.operators import highlights as hl
from tidelane.operators import intervals as iv
from tidelane.plans import text_queries as tq
from tidelane.plans.registry import query
from tidelane.plans.relational_queries import AS_OF
from tidelane.sources import catalogue, files
from tidelane.sources.tables import cte, source, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("i24_voice_clusters")
def voice_clusters(s, d):
    """All embeddings, a recording a label. Vectors have unit length, so that two unlike ones are about 1.4 apart."""
    voices = source(s, d, "embeddings").select(F.coalesce("label", F.lit(-1)).alias("label"), "vec_id", "embedding")
    found = clustering.average_linkage(voices, ["label"], "embedding", tie="vec_id", limit=1.3)
    return found.select("vec_id", "label", F.format_string("SPEAKER_%02d", F.col("cluster")).alias("speaker"))


@query("s13_table_sizes")
def table_sizes(s, d):
    return catalogue.table_sizes(s, {t: f"{d}/{t}.parquet" for t in TABLES})


@query("s13_table_rows", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS row_count FROM {t}" for t in TABLES) + ")")
def table_rows(s, d):
    return catalogue.table_files(s, {t: f"{d}/{t}.parquet" for t in TABLES}).groupBy("name").agg(F.sum("row_count").alias("row_count"))


def _define(s, d):
    progress = F.when(F.col("status") == "completed", 100).when(F.col("status") == "processing", 50)
    jobs = table(s, d, "job").withColumn("progress", progress)
    checkpoints = table(s, d, "metric").select(F.col("event_id").alias("id"), F.col("metric_name").alias("stage"), (F.col("ts") + F.make_interval(days=F.lit(7))).alias("expires_at"))
    stored.define(s, jobs, table(s, d, "segment"), table(s, d, "cost"), checkpoints)


@query("d8_stored_functions", cte("job", "segment", "cost") + """, g AS (SELECT job_id, count(*) AS n FROM segment GROUP BY 1), c AS (SELECT job_id, count(*) AS n, sum(amount) AS a FROM cost GROUP BY 1)
SELECT id, coalesce(CASE status WHEN 'completed' THEN 100 WHEN 'processing' THEN 50 END, 0) AS progress, round(CASE WHEN coalesce(c.a, 0) > 0 THEN coalesce(g.n, 0) * coalesce(c.n, 1) / (c.a * coalesce(g.n, 1))::DOUBLE ELSE coalesce(g.n, 0) * greatest(coalesce(c.n, 0), 1) END, 9) AS efficiency
FROM job j LEFT JOIN g ON j.id = g.job_id LEFT JOIN c ON j.id = c.job_id""")
def stored_functions(s, d):
    _define(s, d)
    return s.sql("SELECT id, tidelane_job_progress(id) AS progress, round(tidelane_cost_efficiency(id), 9) AS efficiency FROM {jobs}", jobs=table(s, d, "job").select("id"))


@query("d8_clean_up", f"SELECT event_type AS stage, count(*) AS live, (SELECT count(*) FROM events WHERE ts + INTERVAL '7 days' < TIMESTAMP '{AS_OF}') AS expired FROM events WHERE ts + INTERVAL '7 days' >= TIMESTAMP '{AS_OF}' GROUP BY 1")
def clean_up(s, d):
    _define(s, d)
    return s.sql(f"SELECT stage, count(*) AS live, tidelane_expired_checkpoints(TIMESTAMP '{AS_OF}') AS expired FROM tidelane_live_checkpoints(TIMESTAMP '{AS_OF}') GROUP BY stage")


def _within(q: str):
    """Within twice the error that 99 of 100 sketches keep, which leaves no doubt."""
    return (F.col(f"{q}_error") <= 2 * aggregates.SKETCH_ERROR).alias(f"{q}_within")


@query("a4_sketched_percentiles", "SELECT event_type, count(value) AS n, true AS p50_within, true AS p95_within FROM events GROUP BY 1")
def sketched_percentiles(s, d):
    """Percentiles merged from hourly sketches: whether the exact ranks of the estimates are within bounds."""
    asked = {"p50": 0.5, "p95": 0.95}
    e = source(s, d, "events")
    found = aggregates.merged_quantiles(aggregates.quantile_sketches(e, ["event_type"], "ts", "value"), ["event_type"], asked)
    return aggregates.quantile_errors(e, ["event_type"], "value", found, asked).select("event_type", "n", _within("p50"), _within("p95"))


@query("a11_sketched_summary", cte("metric") + f"""SELECT component, stage, metric_name, count(*) AS measurement_count, round(avg(value), 8) AS avg_value, min(value) AS min_value, max(value) AS max_value, true AS median_value_within, true AS p95_value_within
FROM metric WHERE date_trunc('hour', ts) >= date_trunc('hour', TIMESTAMP '{AS_OF}' - INTERVAL '24 hours') GROUP BY component, stage, metric_name""")
def sketched_summary(s, d):
    """The performance view over whole hours of the last day, from hourly sketches."""
    keys, asked = ["component", "stage", "metric_name"], {"median_value": 0.5, "p95_value": 0.95}
    m, since = table(s, d, "metric"), F.date_trunc("hour", F.lit(AS_OF).cast("timestamp") - F.make_interval(hours=F.lit(24)))
    hours = aggregates.quantile_sketches(m, keys, "ts", "value").where(F.col("hour") >= since)
    found = aggregates.merged_quantiles(hours, keys, asked)
    told = aggregates.quantile_errors(m.where(F.date_trunc("hour", "ts") >= since), keys, "value", found, asked)
    return told.select(*keys, F.col("n").alias("measurement_count"), F.round("mean", 8).alias("avg_value"), F.col("least").alias("min_value"), F.col("most").alias("max_value"), *map(_within, asked))


@query("i17_merged_features", cte("span") + """, r AS (SELECT *, max(end_ms) OVER (PARTITION BY key ORDER BY start_ms, end_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM span), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY start_ms, end_ms, id) AS i FROM r),
f AS (SELECT key, i, start_ms, end_ms, id, unnest(CASE WHEN k % 4 = 0 THEN [] ELSE ['k' || k % 3, kind] END) AS name, k AS v FROM g), l AS (SELECT key, i, name, v FROM (SELECT *, row_number() OVER (PARTITION BY key, i, name ORDER BY start_ms DESC, end_ms DESC, id DESC) AS n FROM f) WHERE n = 1),
m AS (SELECT key, i, string_agg(name || '=' || v, ' ' ORDER BY name) AS features FROM l GROUP BY 1, 2)
SELECT g.key, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(value) AS value, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'mixed' END AS kind, coalesce(any_value(features), '') AS features FROM g LEFT JOIN m ON g.key = m.key AND g.i = m.i GROUP BY g.key, g.i""")
def merged_features(s, d):
    features = F.when(F.col("k") % 4 != 0, F.create_map(F.concat(F.lit("k"), (F.col("k") % 3).cast("string")), "k", "kind", "k"))
    merged = iv.merge_typed(table(s, d, "span").withColumn("features", features), "key", features="features")
    shown = F.transform(F.array_sort(F.map_entries("features")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return merged.withColumn("features", F.array_join(shown, " "))


@query("s8_subtitle_json")
def subtitle_json(s, d):
    words = tq._stream(s, d)
    lines = hl.subtitle_lines(words.withColumn("clip_start", F.lit(0.0)), ["conv_id"])
    return files.to_subtitle_json(lines, words, ["conv_id"], "concat('conversation-', conv_id)")


@query("u4_ordered_unique", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ 	

]+'), lambda x: x <> '') AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), f AS (SELECT doc_id, x, min(i) AS i FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT d.doc_id, coalesce(string_agg(x, ' ' ORDER BY n) FILTER (n <= 5), '') AS words FROM documents d LEFT JOIN r USING (doc_id) GROUP BY 1""")
def ordered_unique(s, d):
    """The first five different words of each text, in order."""
    first = F.slice(F.array_distinct(text.split_words(F.lower("text"))), 1, 5)
    return source(s, d, "documents").select("doc_id", F.coalesce(F.array_join(first, " "), F.lit("")).alias("words"))


@query("f19_named_uuids", "WITH h AS (SELECT o_orderkey AS id, md5('job:' || o_orderkey) AS h FROM orders) SELECT id, h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-' || ('89ab')[(instr('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS uuid FROM h")
def named_uuids(s, d):
    return source(s, d, "orders").select(F.col("o_orderkey").alias("id"), text.named_uuid(F.concat(F.lit("job:"), F.col("o_orderkey").cast("string"))).alias("uuid"))
