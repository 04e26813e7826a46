"""Session settings and the shared scratch folder."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SPLIT_BITS_CONF = "renderscope.split.bits"
SPLIT_ROWS_CONF = "renderscope.split.rows"
SPLIT_ROWS_DEFAULT = 1_000_000


def local_session(cores: int | str = "*", name: str = "renderscope") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    partitions = 8 if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, as the cluster names it.

    Only a local master may go without the setting; it then gets a fresh
    folder of its own.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_CONF, folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def split_bits(spark: SparkSession) -> int:
    """log2 of the number of value ranges a hot group is split into.

    Follows the shuffle width, so that a group holding most rows still
    spreads over the whole cluster.
    """
    set_bits = spark.conf.get(SPLIT_BITS_CONF, None)
    if set_bits:
        return int(set_bits)
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return min(12, max(2, math.ceil(math.log2(max(width, 2)))))


def split_rows(spark: SparkSession) -> int:
    """Rows of one key that a single task may order; larger keys are split."""
    return int(spark.conf.get(SPLIT_ROWS_CONF, str(SPLIT_ROWS_DEFAULT)))


def staged(df: DataFrame) -> DataFrame:
    """Write a table once to the shared folder and go on from there.

    For tables that several branches of a plan read: they are computed once,
    survive the loss of executors, and their true size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
