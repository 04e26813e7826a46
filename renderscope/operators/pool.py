"""Choosing one row per entry and assembling the approved pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renderscope.functions.text import first_non_blank, non_blank
from renderscope.operators.ratings import tier_lookup

# Lower is preferred.
STAGE_ORDER = {"final": 0, "reviewed": 1}
STATUS_ORDER = {"approved": 0, "completed": 1}
APPROVED_STAGES = ("reviewed", "final")
SUCCESS_STATUSES = ("completed", "approved")


def is_true(flag: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(flag, F.lit(False))


def best_row(df: DataFrame, key: Sequence[str], *preference: Column) -> DataFrame:
    """The row with the greatest preference tuple per key.

    A comparison of structs puts NULL lowest, i.e. last; it runs as a map-side
    aggregate, so long histories shrink before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*preference)).alias("_row"))
    return picked.select(*[c if c in key else F.col("_row")[c].alias(c) for c in df.columns])


def approved_translations(human: DataFrame) -> DataFrame:
    """One approved translation per entry: final before reviewed, then newest."""
    usable = human.where(
        (F.col("status") == "approved")
        & F.col("stage").isin(*APPROVED_STAGES)
        & non_blank(F.col("translation_text")).isNotNull()
    )
    return best_row(
        usable,
        ["lemma_id"],
        -tier_lookup(F.col("stage"), STAGE_ORDER, 2),
        F.col("reviewed_at"),
        F.col("updated_at"),
        F.col("id"),
    )


def current_source(versions: DataFrame, *, need_text: bool = False) -> DataFrame:
    """Newest current public source text per entry, with its label."""
    current = versions.where(is_true(F.col("is_current")) & is_true(F.col("is_public")))
    if need_text:
        current = current.where(non_blank(F.col("text_body")).isNotNull())
    label = F.concat_ws(
        " ", F.nullif(F.col("source_document"), F.lit("")), F.nullif(F.col("source_variant"), F.lit(""))
    )
    return best_row(current, ["lemma_id"], F.col("id")).select(
        "lemma_id", F.col("id").alias("source_version_id"), "text_body", label.alias("source_label")
    )


def approved_pool(human: DataFrame, entries: DataFrame, versions: DataFrame) -> DataFrame:
    """Approved entries with their best source text; source is optional."""
    approved = approved_translations(human).withColumnRenamed("translation_text", "human_translation")
    return (
        approved.select("lemma_id", "human_translation", "stage", "reviewed_by")
        .join(entries.where(~is_true(F.col("quarantined"))), "lemma_id")
        .join(current_source(versions), "lemma_id", "left")
        .select(
            "lemma_id",
            F.coalesce("lemma", F.lit("")).alias("lemma"),
            "entry_number",
            F.coalesce("source_label", F.lit("")).alias("source_label"),
            first_non_blank(
                F.col("text_body"), F.col("human_source"), F.col("corrected_source"), F.col("scanned_source")
            ).alias("source_text"),
            "human_translation",
            F.col("stage").alias("human_stage"),
            F.coalesce("reviewed_by", F.lit("")).alias("human_reviewed_by"),
        )
    )


def pool_order() -> list[Column]:
    """Explicit order of the pool: case-folded name, number with NULLs last, id."""
    return [F.lower("lemma"), F.asc_nulls_last("entry_number"), F.col("lemma_id")]


def approved_sources(human: DataFrame, entries: DataFrame, versions: DataFrame) -> DataFrame:
    """Entries that may be queued: approved, not quarantined, with a current source text."""
    approved = human.where(
        (F.col("status") == "approved")
        & F.col("stage").isin(*APPROVED_STAGES)
        & non_blank(F.col("translation_text")).isNotNull()
    ).select("lemma_id").distinct()
    return (
        entries.where(~is_true(F.col("quarantined")))
        .join(approved, "lemma_id", "left_semi")
        .join(current_source(versions, need_text=True), "lemma_id")
    )


def focal_pick(runs: DataFrame, versions: DataFrame, statuses: Sequence[str] = SUCCESS_STATUSES) -> DataFrame:
    """Best run per entry: on the current source, approved first, newest, highest id."""
    current = current_source(versions).select("lemma_id", "source_version_id")
    usable = runs.where(
        F.col("status").isin(*statuses) & non_blank(F.col("translation_text")).isNotNull()
    ).join(current.withColumnRenamed("source_version_id", "_current"), "lemma_id", "left")
    on_current = F.coalesce(F.col("source_text_version_id") == F.col("_current"), F.lit(False))
    return best_row(
        usable.withColumn("on_current_source", on_current).drop("_current"),
        ["lemma_id"],
        F.col("on_current_source").cast("int"),
        -tier_lookup(F.col("status"), STATUS_ORDER, 2),
        F.coalesce("reviewed_at", "completed_at", "created_at"),
        F.col("id"),
    )


def latest_completed(runs: DataFrame, key: str = "passage_id") -> DataFrame:
    """Newest successful focal run per passage; a missing completion time sorts last."""
    usable = runs.where(
        is_true(F.col("is_focal"))
        & F.col("status").isin(*SUCCESS_STATUSES)
        & non_blank(F.col("translation_text")).isNotNull()
    )
    return best_row(usable, [key], F.col("completed_at"), F.col("id"))
