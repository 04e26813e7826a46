"""Timing of first evaluations and gaps between saves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renderscope.functions.splits import previous_rows, rank_table, row_numbers


def seconds_between(start: Column, end: Column) -> Column:
    micros = [F.unix_micros(t.cast("timestamp")) for t in (end, start)]
    return (micros[0] - micros[1]) / F.lit(1e6)


def iso_timestamp(text: Column) -> Column:
    """ISO text with a trailing Z, or ``yyyy-MM-dd HH:mm:ss``."""
    return F.try_to_timestamp(text)


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], *, ceil_index: bool = False
) -> DataFrame:
    """Exact percentiles from the ranks, with no group gathered in one place.

    Linear interpolation between neighbours, or the value at the rounded-up
    index with ``ceil_index``.
    """
    table = rank_table(df, keys, value)
    v, low = F.col(value), F.col("below")
    high = F.col("below") + F.col("cnt")
    picks, out = [], []
    for name, q in points.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        down, up = (F.ceil(at), F.ceil(at)) if ceil_index else (F.floor(at), F.ceil(at))
        picks += [
            F.max(F.when((low <= down) & (down < high), v)).alias(f"_d_{name}"),
            F.max(F.when((low <= up) & (up < high), v)).alias(f"_u_{name}"),
            F.max(at - down).alias(f"_f_{name}"),
        ]
        step = F.col(f"_u_{name}") - F.col(f"_d_{name}")
        out.append((F.col(f"_d_{name}") + step * F.col(f"_f_{name}")).alias(name))
    return table.groupBy(*keys).agg(*picks).select(*keys, *out)


def describe(
    df: DataFrame, keys: Sequence[str], value: str, *, threshold: float | None = None, approximate: bool = False
) -> DataFrame:
    """n, min, q1, median, q3, max, mean, and how many stay under ``threshold``.

    ``approximate`` trades the exact ranks for one-pass quantile sketches.
    """
    v = F.col(value)
    under = [] if threshold is None else [F.count_if(v < threshold).alias("under_threshold")]
    base = [F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean")]
    present = df.where(v.isNotNull())
    points = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    if approximate:
        sketch = [F.percentile_approx(v, F.lit(q), F.lit(10_000)).alias(n) for n, q in points.items()]
        return present.groupBy(*keys).agg(*base, *sketch, *under)
    return present.groupBy(*keys).agg(*base, *under).join(
        percentiles(present, keys, value, points), list(keys)
    )


def save_gaps(df: DataFrame, condition: str = "treatment") -> DataFrame:
    """Seconds since the reviewer's previous save, and the same only where both
    saves are of the ``single`` condition."""
    rows = previous_rows(
        df, ["reviewer"], "id", {"_prev_at": "created_at", "_prev_condition": condition}
    )
    gap = seconds_between(F.col("_prev_at"), F.col("created_at"))
    both_single = (F.col(condition) == "single") & (F.col("_prev_condition") == "single")
    return (
        rows.withColumn("seconds_since_previous", gap)
        .withColumn("successive_single_gap", F.when(both_single, gap))
        .drop("_prev_at", "_prev_condition")
    )


def timing_contingency(df: DataFrame, condition: str = "treatment", elapsed: str = "elapsed_seconds") -> DataFrame:
    """Timed and missing first evaluations per condition."""
    return df.groupBy(condition).agg(
        F.count(elapsed).alias("timed"), (F.count(F.lit(1)) - F.count(elapsed)).alias("missing")
    )


def drop_longest(df: DataFrame, keys: Sequence[str], value: str, row: str) -> DataFrame:
    """All rows but the single longest per key; on a tie the highest row id."""
    longest = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.max_by(F.col(row), F.struct(value, row)).alias(row))
    )
    return df.join(longest, [*keys, row], "left_anti")


def condition_sequence(df: DataFrame, condition: str = "treatment") -> DataFrame:
    """Conditions in save order, one row per step."""
    return row_numbers(df.select("reviewer", "id", condition), ["reviewer"], "id", "step").drop("id")
