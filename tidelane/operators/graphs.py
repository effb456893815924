"""Connected components of tables of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.storage import discard, materialize


def connected(pairs: DataFrame, key: list[str], a: str, b: str, most: int = 100) -> DataFrame:
    """(key, id, root): for each id of ``pairs`` the smallest id that it is connected with.

    Each round points every id at the least root among its neighbours' and follows that pointer once, so rounds grow with the logarithm of a chain's
    length. A round is stored; the driver gets one number. Nulls are no ids.
    """
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*key, F.col(a).alias("id"), F.col(b).alias("_to"))
    edges = materialize(both.unionByName(both.select(*key, F.col("_to").alias("id"), F.col("id").alias("_to"))).distinct(), "graph-edges")
    now = materialize(edges.groupBy(*key, "id").agg(F.least(F.min("_to"), F.col("id")).alias("root")), "graph-roots")
    for _ in range(most):
        seen = edges.join(now.select(*key, F.col("id").alias("_to"), F.col("root").alias("_r")), [*key, "_to"]).groupBy(*key, "id").agg(F.min("_r").alias("_r"))
        least = now.join(seen, [*key, "id"]).select(*key, "id", F.least("root", "_r").alias("_m"), "root")
        hooked = least.unionByName(least.select(*key, F.col("root").alias("id"), "_m", "root")).groupBy(*key, "id").agg(F.min("_m").alias("_m"))  # an old root follows its members
        hooked = materialize(hooked, "graph-hooked")
        jumped = hooked.join(hooked.select(*key, F.col("id").alias("_m"), F.col("_m").alias("_n")), [*key, "_m"]).select(*key, "id", F.least("_m", "_n").alias("root"))
        after = materialize(jumped, "graph-roots")
        moved = after.join(now.withColumnRenamed("root", "_old"), [*key, "id"]).where("root <> _old").isEmpty()
        discard(now, hooked)
        now = after
        if moved:
            discard(edges)
            return now
    raise RuntimeError("components did not settle")
