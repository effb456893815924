"""Domain tables of the engine, read from a folder of Parquet tables.

Each table is a projection that Catalyst can prune and push filters through. ``CTE`` holds the same projections as SQL for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (source table, Spark SQL projection, comparison SQL projection); one entry where both dialects agree.
_TABLES = {
    "job": (
        "orders",
        ["o_orderkey AS id", "o_custkey AS owner", "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'processing' END AS status", "o_orderpriority AS priority", "CAST(o_orderdate AS TIMESTAMP) AS created_at", "CASE WHEN o_orderstatus = 'F' THEN 60 + o_orderkey % 7200 END AS run_seconds", "CAST(o_totalprice AS DECIMAL(14,2)) AS budget_limit"],
    ),
    "segment": (
        "lineitem",
        ["l_orderkey * 8 + l_linenumber AS id", "l_orderkey AS job_id", "l_partkey * 37 % 60000 AS start_ms", "l_partkey * 37 % 60000 + 1000 + l_suppkey * 991 % 9000 AS end_ms", "l_quantity AS score", "l_returnflag = 'A' AS enhanced", "l_returnflag AS kind"],
    ),
    "cost": (
        "lineitem",
        ["l_orderkey AS job_id", "l_returnflag AS service", "l_linestatus AS operation", "CAST(l_extendedprice AS DECIMAL(12,2)) AS amount", "l_partkey AS input_tokens", "l_suppkey AS output_tokens", "l_quantity AS duration_seconds"],
    ),
    "metric": ("events", ["event_id", "event_type AS metric_name", "CONCAT('c', user_id % 3) AS component", "CASE WHEN user_id % 5 < 4 THEN CONCAT('s', user_id % 5) END AS stage", "value", "CAST(ts AS TIMESTAMP) AS ts"]),
    "span": ("events", ["event_id AS id", "user_id AS key", "event_type AS kind", "value", "{ms} AS start_ms", "{ms} + CAST(round(value * 60000) AS BIGINT) AS end_ms", "{k} AS k"]),
}
_SPARK = {"ms": "CAST(unix_millis(CAST(ts AS TIMESTAMP)) AS BIGINT)", "k": "CAST(get_json_object(props, '$.k') AS INT)"}
_DUCK = {"ms": "epoch_us(ts) // 1000", "k": "CAST(props->>'$.k' AS INTEGER)"}


def _fill(columns: list[str], names: dict[str, str]) -> list[str]:
    for k, v in names.items():
        columns = [c.replace("{" + k + "}", v) for c in columns]
    return columns


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table: job, segment, cost, metric or span (an interval of a key)."""
    stored, columns = _TABLES[name]
    return source(spark, sf_dir, stored).selectExpr(*_fill(columns, _SPARK))


def cte(*names: str) -> str:
    """WITH clause that defines the domain tables for comparison SQL."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(_fill(_TABLES[n][1], _DUCK))} FROM {_TABLES[n][0]})" for n in names) + " "
