"""Writing result tables, documents and scoring requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renderscope.functions.splits import row_numbers
from renderscope.operators.quality import ragged_union


def csv_value(df: DataFrame, name: str) -> Column:
    """Floats to 8 decimals, non-finite as empty, booleans as true/false."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
        return F.when(finite, F.format_string("%.8f", c.cast("double"))).alias(name)
    return c.cast("string").alias(name)


def csv_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Given columns in order; others are dropped and absent ones are empty."""
    return df.select(
        *[csv_value(df, c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    )


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    rows = csv_rows(df, columns or df.columns)
    rows.write.mode("overwrite").option("header", True).option("escape", "\"").option(
        "nullValue", ""
    ).option("emptyValue", "").csv(path)


def write_csv_union(path: str, *tables: DataFrame) -> None:
    """All rows under the union of their columns."""
    write_csv(ragged_union(*tables), path)


def summary_document(df: DataFrame, name: str, **metadata: object) -> DataFrame:
    """One JSON document around a summary table (one row per group, already reduced)."""
    rows = F.collect_list(F.struct(*df.columns)).alias(name)
    return df.agg(*[F.lit(v).alias(k) for k, v in metadata.items()], rows) if metadata else df.agg(rows)


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def scoring_request(pairs: DataFrame, key: str) -> DataFrame:
    """Rows for an external scorer with a stable 0-based index in key order.

    Only the keys, which are unique, are put in order; texts join them by key.
    """
    numbered = row_numbers(pairs.select(key), [], key, "row_index").withColumn("row_index", F.col("row_index") - 1)
    return pairs.join(numbered, key)


def public_columns(df: DataFrame, private: Sequence[str]) -> DataFrame:
    """Drop texts, ids and timestamps before publication."""
    return df.select(*[c for c in df.columns if c not in set(private)])


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
