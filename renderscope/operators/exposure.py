"""Exposure traces: what a reviewer saw before saving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARIANT_EXPOSURE = T.StructType(
    [
        T.StructField("visible_ms", T.DoubleType()),
        T.StructField("first_visible_ms", T.DoubleType()),
        T.StructField("last_visible_ms", T.DoubleType()),
        T.StructField("view_count", T.IntegerType()),
        T.StructField("max_intersection_ratio", T.DoubleType()),
    ]
)
EXPOSURE = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("page_loaded_at", T.StringType()),
        T.StructField("captured_at_ms", T.DoubleType()),
        T.StructField("helper_visibility_threshold", T.DoubleType()),
        T.StructField("helpers_revealed", T.BooleanType()),
        T.StructField("variants", T.MapType(T.StringType(), VARIANT_EXPOSURE)),
    ]
)


def parsed(raw: Column) -> Column:
    """Exposure struct; invalid text and non-objects give NULL fields."""
    return F.from_json(F.coalesce(F.nullif(raw, F.lit("")), F.lit("{}")), EXPOSURE, {"mode": "PERMISSIVE"})


def visible_values(exposure: Column) -> Column:
    times = F.transform(F.map_values(exposure["variants"]), lambda v: v["visible_ms"])
    return F.coalesce(F.filter(times, lambda ms: ms > 0), F.array().cast("array<double>"))


def helper_count(exposure: Column) -> Column:
    return F.size(visible_values(exposure))


def helper_seconds(exposure: Column) -> Column:
    total = F.aggregate(visible_values(exposure), F.lit(0.0), lambda a, ms: a + ms)
    return F.round(total / 1000.0, 3)


def peak_visible_ms(exposure: Column) -> Column:
    return F.array_max(visible_values(exposure))


def elapsed_seconds(exposure: Column) -> Column:
    """Seconds from page load to save; missing stays missing."""
    captured = exposure["captured_at_ms"]
    return F.when(captured > 0, F.round(captured / 1000.0, 3))


def exposure_summary(df: DataFrame, raw: str = "exposure_json") -> DataFrame:
    """Helpers seen, their summed time, the longest one, and the elapsed time."""
    trace = df.withColumn("_e", parsed(F.col(raw)))
    e = F.col("_e")
    return trace.select(
        *df.columns,
        helper_count(e).alias("helper_variants_visible"),
        helper_seconds(e).alias("helper_visible_seconds"),
        peak_visible_ms(e).alias("peak_visible_ms"),
        elapsed_seconds(e).alias("elapsed_seconds"),
    ).drop(raw)


def exposure_rows(df: DataFrame, raw: str = "exposure_json") -> DataFrame:
    """One row per (save, variant) of the trace."""
    trace = df.select(*[c for c in df.columns if c != raw], parsed(F.col(raw))["variants"].alias("_v"))
    rows = trace.select("*", F.explode("_v").alias("exposed_variant", "_t")).drop("_v")
    return rows.select("*", "_t.*").drop("_t")
