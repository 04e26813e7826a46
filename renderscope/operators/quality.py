"""Coverage checks and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage_audit(df: DataFrame, key: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, duplicates and rows with every required value, in one row.

    Folded by key first, so the distinct count needs no copy of the table.
    """
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(whole).alias("_full"))
    return per_key.agg(
        F.sum("_n").alias("row_count"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        F.sum("_full").alias("complete_rows"),
    ).withColumn("complete", F.col("complete_rows") == F.col("row_count"))


def ragged_union(*tables: DataFrame) -> DataFrame:
    """Union over the union of columns; absent ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def missing_keys(expected: DataFrame, actual: DataFrame, key: Sequence[str]) -> DataFrame:
    """Expected keys that are absent, and keys that were not expected."""
    want, have = expected.select(*key).distinct(), actual.select(*key).distinct()
    return want.join(have, list(key), "left_anti").withColumn("side", F.lit("missing")).unionByName(
        have.join(want, list(key), "left_anti").withColumn("side", F.lit("unexpected"))
    )


def membership(df: DataFrame, members: DataFrame, key: str, out: str) -> DataFrame:
    flagged = members.select(key).distinct().withColumn("_in", F.lit(True))
    return df.join(flagged, key, "left").withColumn(out, F.col("_in").isNotNull()).drop("_in")
