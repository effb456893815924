"""Scratch tables and files in the folder that a cluster shares.

Everything that has to outlive a task - cut lineage, side tables that several
plans read, binary shards - goes below ``spark.checkpoint.dir``. The setting is
read from the session. Only a local session without that setting gets a folder
of its own; on a cluster a missing setting is an error, because a machine-local
folder would be invisible to the other executors.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
#: Spark's setting to delete an execution's shuffle files at its end, not when the driver next collects garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """URI of the shared scratch folder of this application."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="tidelane-")
            atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
        root = f"file://{_LOCAL_ROOTS[app]}"
    elif not urlparse(root).scheme and root.startswith("/") and spark.sparkContext.master.startswith("local"):
        root = f"file://{root}"
    return f"{root.rstrip('/')}/tidelane/{app}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new, unused URI below the shared folder."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage is cut and the rows survive lost executors. Shuffle files that the write needed go with it."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    for made in _MADE:
        made.append(stored)
    return stored


_MADE: list[list[DataFrame]] = []


@contextmanager
def noted():
    """A list of the tables that :func:`materialize` stores meanwhile, in order, for :func:`discard`."""
    made: list[DataFrame] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE.pop()


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables of :func:`materialize` that nothing reads any more: all that was derived from them is stored."""
    for df in tables:
        spark = df.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        marker = urlparse(shared_root(spark)).path
        for folder in folders:
            if urlparse(folder).path.startswith(f"{marker}/"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_store(uri: str):
    """``(filesystem, path)`` of a URI, for tasks that read or write whole files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
