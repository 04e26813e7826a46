"""Review packs: focal translations, helpers, neighbours, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renderscope.functions.splits import previous_rows
from renderscope.functions.text import non_blank
from renderscope.operators.pool import SUCCESS_STATUSES, is_true


def profile_subset(
    profiles: DataFrame,
    *,
    names: Sequence[str] | None = None,
    prefix: str | None = None,
    skip_focal: bool = False,
    skip_helpers: bool = False,
    max_priority: int | None = None,
) -> DataFrame:
    out = profiles
    if names is not None:
        out = out.where(F.col("name").isin(*names))
    if prefix is not None:
        out = out.where(F.col("name").startswith(prefix))
    if skip_focal:
        out = out.where(~is_true(F.col("is_focal")))
    if skip_helpers:
        out = out.where(is_true(F.col("is_focal")))
    if max_priority is not None:
        out = out.where(F.coalesce("priority", F.lit(5)) <= max_priority)
    return out


def focal_assembly(
    sets: DataFrame, items: DataFrame, passages: DataFrame, runs: DataFrame, profiles: DataFrame, references: DataFrame
) -> DataFrame:
    """Set x item x passage x focal run x profile x reference, all inner."""
    return (
        items.join(sets, "review_set_id")
        .join(passages, "passage_id")
        .join(runs.select(F.col("run_id").alias("focal_run_id"), "profile_id", "candidate_text"), "focal_run_id")
        .join(profiles.select("profile_id", "name", "label"), "profile_id")
        .join(references.select("passage_id", "reference_text"), "passage_id")
    )


def helper_packs(items: DataFrame, runs: DataFrame, profiles: DataFrame) -> DataFrame:
    """All helpers named by each item, fetched in one job and ranked by priority."""
    named = items.select(
        "item_id", "passage_id", F.explode("helper_profile_names").alias("name")
    )
    usable = runs.where(
        F.col("status").isin(*SUCCESS_STATUSES) & non_blank(F.col("translation_text")).isNotNull()
    )
    helpers = profile_subset(profiles, skip_focal=True).select("profile_id", "name", "priority")
    return (
        named.join(helpers, "name")
        .join(usable.select("run_id", "passage_id", "profile_id"), ["passage_id", "profile_id"])
        .select("item_id", "passage_id", "name", "priority", "run_id")
    )


def set_neighbours(items: DataFrame, keys: Sequence[str], item: str, order: str = "display_order") -> DataFrame:
    """Previous and next item of each set."""
    back = previous_rows(items, keys, order, {"previous_item": item})
    return previous_rows(back, keys, order, {"next_item": item}, following=True)


def completeness(runs: DataFrame, profiles: DataFrame, passage: str = "passage_id") -> DataFrame:
    """Profiles covered per passage against the number of active profiles."""
    active = profiles.where(is_true(F.col("active")))
    wanted = active.agg(F.count(F.lit(1)).alias("n")).scalar()
    done = (
        runs.where(F.col("status").isin(*SUCCESS_STATUSES))
        .join(active.select("profile_id"), "profile_id", "left_semi")
        .groupBy(passage, "profile_id")
        .agg(F.count(F.lit(1)).alias("_runs"))
    )
    covered = done.groupBy(passage).agg(
        F.count(F.lit(1)).alias("profiles_done"), F.sum("_runs").alias("runs")
    )
    passages = runs.select(passage).distinct()
    return (
        passages.join(covered, passage, "left")
        .select(
            passage,
            F.coalesce("profiles_done", F.lit(0)).cast("long").alias("profiles_done"),
            F.coalesce("runs", F.lit(0)).cast("long").alias("runs"),
        )
        .withColumn("profiles_wanted", wanted)
        .withColumn("complete", F.col("profiles_done") == F.col("profiles_wanted"))
    )
