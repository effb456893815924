"""Functions of the store that SQL texts can call: a job's progress and cost efficiency, and checkpoints with the expired ones left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelane.operators.relational import cost_efficiency


def define(spark: SparkSession, jobs: DataFrame, segments: DataFrame, costs: DataFrame, checkpoints: DataFrame, prefix: str = "tidelane") -> None:
    """Defines, for this session, temporary SQL functions over the given tables and replaces earlier ones of the same ``prefix``:

    * ``<prefix>_job_progress(job)``: the job's progress (jobs: id, progress), 0 if there is none or no such job;
    * ``<prefix>_cost_efficiency(job)``: its segments for each unit of cost, over the fanned-out join; 0 without a job;
    * ``<prefix>_expired_checkpoints(at)``: how many checkpoints (with expires_at) had expired before ``at``;
    * ``<prefix>_live_checkpoints(at)``: a table function, the checkpoints that a clean-up at ``at`` leaves. What never expires stays.

    A call on a column becomes a join with the function's table, grouped by job, never a query for each row.
    """
    jobs.createOrReplaceTempView(f"{prefix}_fn_jobs")
    cost_efficiency(jobs, segments, costs).createOrReplaceTempView(f"{prefix}_fn_efficiency")
    checkpoints.createOrReplaceTempView(f"{prefix}_fn_checkpoints")
    key, shape = dict(jobs.dtypes)["id"], ", ".join(f"`{n}` {t}" for n, t in checkpoints.dtypes)
    columns = ", ".join(f"`{n}`" for n in checkpoints.columns)
    for text in (
        f"job_progress(job {key}) RETURNS INT RETURN coalesce((SELECT max(progress) FROM {prefix}_fn_jobs WHERE id = job), 0)",
        f"cost_efficiency(job {key}) RETURNS DOUBLE RETURN coalesce((SELECT max(efficiency) FROM {prefix}_fn_efficiency WHERE id = job), 0.0)",
        f"expired_checkpoints(moment TIMESTAMP) RETURNS BIGINT RETURN (SELECT count(*) FROM {prefix}_fn_checkpoints WHERE expires_at < moment)",
        f"live_checkpoints(moment TIMESTAMP) RETURNS TABLE ({shape}) RETURN SELECT {columns} FROM {prefix}_fn_checkpoints WHERE NOT coalesce(expires_at < moment, false)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{text}")
