"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.storage import discard, materialize


def _star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v) -> (v, least of u and all v of u); a large u's rows meet its least in a join that Spark can split. Second, the stored leasts."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m")), least


def _settled(edges: DataFrame) -> bool:
    """Whether each u has one v, which is no u itself: then v is the smallest id of u's component."""
    roles = edges.select(F.col("u").alias("id"), F.lit(1).alias("below")).union(edges.select(F.col("v").alias("id"), F.lit(0).alias("below")))
    both = roles.groupBy("id").agg(F.sum("below").alias("below"), F.count_if(F.col("below") == 0).alias("above"))
    return both.where("below > 1 OR (below > 0 AND above > 0)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, label): the smallest id of each id's component, for every id of ``edges`` (a, b of one orderable type). Nulls and loops are no edges.

    Each round is a few shuffles of the edges, written to the shared folder; rounds grow with the logarithm of the largest component, and edges
    that are stars already need none.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star-edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        large, least = _star(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = materialize(large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "star-large")
        discard(now, least)
        small, least = _star(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "star-edges")
        discard(large, least)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).union(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
