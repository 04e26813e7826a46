"""Reproducible selection and assignment by seeded hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renderscope.functions.hashing import seeded_key
from renderscope.functions.splits import row_numbers
from renderscope.functions.text import fingerprint, preview

PRIMARY = "primary_random_review"  # fixed values
SECONDARY = "secondary_random_review"


def require_pool(df: DataFrame, requested: int) -> DataFrame:
    """Fail the job when fewer than ``requested`` rows are there."""
    if requested <= 0:
        raise ValueError("at least one passage must be requested")
    have = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    message = F.concat(F.lit(f"pool is smaller than the {requested} requested: "), F.col("_have").cast("string"))
    checked = F.when(F.col("_have") < requested, F.raise_error(message)).otherwise(F.lit(True)).cast("boolean")
    return df.withColumn("_have", have).where(checked).drop("_have")


def seeded_sample(df: DataFrame, key: str, k: int, seed: int, *, out: str = "selection_rank") -> DataFrame:
    """k rows without replacement, ranked in draw order (TakeOrdered, then k rows)."""
    drawn = df.withColumn("_draw", seeded_key(seed, F.col(key))).orderBy("_draw", key).limit(k)
    rank = F.row_number().over(Window.orderBy("_draw", key))
    return drawn.withColumn(out, rank.cast("long")).drop("_draw")


def with_tiers(selected: DataFrame, primary: int, rank: str = "selection_rank") -> DataFrame:
    """First ranks are primary, the rest secondary; the tier rank restarts."""
    in_primary = F.col(rank) <= primary
    return selected.withColumn("tier", F.when(in_primary, PRIMARY).otherwise(SECONDARY)).withColumn(
        "tier_rank", F.when(in_primary, F.col(rank)).otherwise(F.col(rank) - primary)
    )


def selection_record(df: DataFrame, source: str, translation: str, *columns: str) -> DataFrame:
    """Manifest row: hashes, sizes and previews in place of the texts."""
    def of(name: str, prefix: str) -> list[Column]:
        text = F.coalesce(F.col(name), F.lit(""))
        return [
            fingerprint(text).alias(f"{prefix}_sha256"),
            F.length(text).alias(f"{prefix}_char_count"),
            preview(text).alias(f"{prefix}_preview"),
        ]

    return df.select(*columns, *of(source, "source"), *of(translation, "human_translation"))


def seeded_assignment(df: DataFrame, keys: Sequence[str], item: str, seed: int) -> DataFrame:
    """Display order and a half split into treatments, from two independent shuffles."""
    keys = list(keys)
    shuffled = df.withColumn("_order", seeded_key(seed, F.col(item))).withColumn(
        "_half", seeded_key(f"{seed}/half", F.col(item))
    )
    ordered = row_numbers(shuffled, keys, "_order", "display_order")
    halved = row_numbers(ordered, keys, "_half", "_pick")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    treated = F.col("_pick") <= F.floor(F.col("_n") / 2)
    return (
        halved.join(sizes, keys)
        .withColumn("treatment", F.when(treated, "assisted").otherwise("single"))
        .drop("_order", "_half", "_pick", "_n")
    )


def by_manifest(df: DataFrame, manifest: DataFrame, key: str, *attributes: str) -> DataFrame:
    """Rows of an explicit list, carrying the list's attributes."""
    return df.join(manifest.select(key, *attributes), key)


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def first_appearance(df: DataFrame, group: str, position: str) -> DataFrame:
    """Groups in the order in which they first appear."""
    return df.groupBy(group).agg(
        F.min(position).alias("first_position"), F.count(F.lit(1)).alias("passages")
    )
