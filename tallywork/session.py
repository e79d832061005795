"""Local session for tests and the benchmark; on a cluster the caller brings its own."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

from tallywork.errors import Refusal


def local_session(cpus: int | str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tallywork")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors see: the one the cluster names in spark.checkpoint.dir.

    Only a local session, as in tests, may fall back to a folder of its own machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise Refusal("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tallywork-")


def checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute a frame once, into the shared folder, when several later steps read it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
