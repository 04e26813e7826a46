"""Keyed updates, partition replacement and schema evolution of stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from renderscope.operators.ratings import in_domain

VERSION = "version"


def merge_rows(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old and new rows by key, the new row winning.

    Where the table format has ``MERGE INTO``, use that; plain files get the
    merged table written as a new version.
    """
    rest = [c for c in new.columns if c not in key]
    both = old.select(*new.columns, F.lit(0).alias("_new")).unionByName(
        new.withColumn("_new", F.lit(1))
    )
    picked = both.groupBy(*key).agg(F.max_by(F.struct(*rest), "_new").alias("_row"))
    return picked.select(*[c if c in key else F.col("_row")[c].alias(c) for c in new.columns])


def current_version(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest complete version."""
    table = spark.read.parquet(path)
    newest = table.agg(F.max(VERSION)).scalar()
    return table.where(F.col(VERSION) == newest).drop(VERSION)


def write_version(df: DataFrame, path: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{VERSION}={version}")


def upsert(spark: SparkSession, path: str, new: DataFrame, key: Sequence[str], version: int) -> None:
    """Write version ``version`` of a keyed table: the current rows with ``new`` applied."""
    write_version(merge_rows(current_version(spark, path), new, key), path, version)


def replace_partition(df: DataFrame, path: str, column: str) -> None:
    """Replace exactly the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add the columns an old file lacks, with their default."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def rescaled_log(df: DataFrame) -> DataFrame:
    """Carry a legacy scale over: ratings off the scale become NULL, exposure is reset."""
    return df.withColumn("rating", in_domain(F.col("rating"))).withColumn("exposure_json", F.lit("{}"))


def as_append_only(df: DataFrame, next_columns: Sequence[str]) -> DataFrame:
    """Rows of a one-row-per-key table under the append-only layout, all kept."""
    return df.select(*next_columns)


class CheckFailed(Exception):
    """A write whose counts are not what was asked for; nothing of it is visible."""


def write_checked(df: DataFrame, path: str, expected: Mapping[str, tuple[Column, object]]) -> dict[str, object]:
    """Write a table whose aggregates must have the given values; they are taken in the pass that writes.

    Rows go to a hidden folder beside ``path`` and are moved there only if every
    aggregate is as expected; else ``CheckFailed`` is raised and ``path`` stays
    as it was. An existing ``path`` is refused. Aggregates are over the rows that
    are written, so a stage that runs again after a lost executor counts once.
    """
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.exists(target):
        raise CheckFailed(f"{path} exists")
    hidden = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_pending-{uuid.uuid4().hex}")
    seen = Observation()
    df.observe(seen, *[value.alias(name) for name, (value, _) in expected.items()]).write.parquet(hidden.toString())
    found = seen.get
    wrong = {name: (found[name], value) for name, (_, value) in expected.items() if found[name] != value}
    if wrong or not files.rename(hidden, target):
        files.delete(hidden, True)
        raise CheckFailed(f"{path}: found and expected {wrong}" if wrong else f"{path}: could not be moved into place")
    return found


def migrate_append_only(old: DataFrame, path: str, next_columns: Sequence[str], version: int, key: str = "id") -> int:
    """Carry a one-row-per-key table over to a new version of the append-only layout; gives its row count.

    No row may be lost or added: the rows and the keys that are written have to
    be as many as the old table holds and their sum of key hashes the same.
    """
    digest = F.sum(F.xxhash64(key).cast("decimal(38,0)"))
    rows, keys, hashes = old.agg(F.count(F.lit(1)), F.count(key), digest).first()
    expected = {"rows": (F.count(F.lit(1)), rows), "keys": (F.count(key), keys), "hashes": (digest, hashes)}
    write_checked(as_append_only(old, next_columns), f"{path}/{VERSION}={version}", expected)
    return rows
