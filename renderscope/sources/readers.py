"""Reading logs, tables, CSV files and JSON documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renderscope import schemas


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 8,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Database scan; ``table`` may be ``(select ..) alias``.

    With a partition column the scan runs as parallel range queries.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**dict(properties or {}))
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.load()


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema; malformed rows fail the job."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option(
        "multiLine", True
    ).option("escape", '"').csv(path)


def read_rating_log(spark: SparkSession, path: str, *, packs: Sequence[str] | None = None) -> DataFrame:
    log = read_csv(spark, path, schemas.RATING_LOG)
    return log if packs is None else log.where(F.col("pack_slug").isin(*packs))


def extract_by_ids(table: DataFrame, ids: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of the rows whose key is in a list."""
    return table.select(key, *[c for c in columns if c != key]).join(
        ids.select(key).distinct(), key, "left_semi"
    )


def read_manifest(spark: SparkSession, path: str, *, tiers: Sequence[str] | None = None) -> DataFrame:
    """Passages of a selection manifest, with its slug and seed."""
    document = spark.read.schema(schemas.MANIFEST).json(path, multiLine=True)
    rows = document.select("selection_slug", "seed", F.explode("passages").alias("_p")).select(
        "selection_slug", "seed", "_p.*"
    )
    return rows if tiers is None else rows.where(F.col("tier").isin(*tiers))


def read_scores(spark: SparkSession, path: str, metrics: Sequence[str]) -> DataFrame:
    """Externally computed scores, one row per ``row_index``."""
    document = spark.read.schema(schemas.score_file(list(metrics))).json(path, multiLine=True)
    return document.select(F.explode("scores").alias("_s")).select("_s.*")


def read_score_status(spark: SparkSession, path: str) -> DataFrame:
    document = spark.read.schema(schemas.score_file(["x"])).json(path, multiLine=True)
    return document.select(F.explode("status").alias("metric", "status"))


def merge_scores(rows: DataFrame, scores: DataFrame, index: str = "row_index") -> DataFrame:
    """Attach scores by position; a missing score stays NULL."""
    return rows.join(scores, index, "left")
