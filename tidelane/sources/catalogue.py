"""What is known of the files behind tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, file, bytes, row_count, blocks, modified): a row for each file of the tables at ``paths``, with the number of blocks that scans cut it into.

    No column of a table is read: Spark adds file metadata to each row group's count. Files without rows have no row.
    """

    def files(name: str, path: str) -> DataFrame:
        m = F.col("_metadata")
        rows = spark.read.parquet(path).select(m.file_path.alias("file"), m.file_size.alias("bytes"), m.file_block_start.alias("block"), m.file_modification_time.alias("modified"))
        blocks = rows.groupBy("file", "block").agg(F.max("bytes").alias("bytes"), F.max("modified").alias("modified"), F.count(F.lit(1)).alias("row_count"))
        whole = blocks.groupBy("file").agg(F.max("bytes").alias("bytes"), F.sum("row_count").alias("row_count"), F.count(F.lit(1)).alias("blocks"), F.max("modified").alias("modified"))
        return whole.select(F.lit(name).alias("name"), "file", "bytes", "row_count", "blocks", "modified")

    return reduce(DataFrame.unionByName, [files(name, path) for name, path in sorted(paths.items())])


def table_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(place, name, files, bytes, row_count, bytes_per_row): tables, largest first."""
    sums = table_files(spark, paths).groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("row_count").alias("row_count"))
    by_size = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("b"), "name", "files", "bytes", "row_count")))  # a row for each table
    return sums.agg(by_size.alias("t")).select(F.posexplode("t").alias("place", "t")).select((F.col("place") + 1).alias("place"), "t.name", "t.files", "t.bytes", "t.row_count", F.round(F.col("t.bytes") / F.col("t.row_count"), 3).alias("bytes_per_row"))
