"""Scratch tables."""

import glob
import os

from pyspark.sql import functions as F

from tidelane.storage import discard, materialize


def _shuffle_files(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in local for f in glob.glob(os.path.join(d, "**", "shuffle_*"), recursive=True)}


def test_stored_tables_leave_no_shuffle_files(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = _shuffle_files(spark), spark.conf.get(setting)
    df = spark.range(5000).groupBy((F.col("id") % 777).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    one, two = materialize(df, "a"), materialize(df.join(df.withColumnRenamed("n", "m"), "k").repartition(3), "b")
    assert _shuffle_files(spark) <= before and spark.conf.get(setting) == was
    assert one.agg(F.sum("n")).first()[0] == 5000 and two.count() == 777 and df.count() == 777
    discard(one, two)
