"""Cutting lineage so that a lost executor costs a re-read, not the whole history."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # with the query that wrote them


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: what the cluster names in spark.checkpoint.dir; one of this machine's own only
    where nothing is named and all executors run on this machine (tests, a laptop)."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not folder:
            folder = tempfile.mkdtemp(prefix="quillwork-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
        named = sc._jsc.sc().getCheckpointDir()
    return named.get()


def durable(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the checkpoint folder until nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed with all that was written there when the program ends."""
    path = f"{shared_folder(spark)}/quillwork-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The same rows as a compressed table in the shared folder, removed when the program ends. For results that are
    read several times: columns are pruned and filters pushed down on each reading. What was shuffled for it goes at once,
    not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = shared_path(spark)
    kept = spark.conf.get(SHUFFLES_END, "false")
    spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLES_END, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` as soon as nothing that is still to be computed reads them."""
    for t in tables:
        _remove(t.sparkSession, t._written_to)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
