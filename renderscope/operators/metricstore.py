"""The long metric store: pivots, roll-ups, means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_int(document: Column, path: str) -> Column:
    return F.get_json_object(document, path).try_cast("int")


def latest_metric_run(runs: DataFrame, prefix: str) -> DataFrame:
    """Newest completed run of a metric set (one row)."""
    return (
        runs.where((F.col("status") == "completed") & F.col("metric_set").startswith(prefix))
        .orderBy(F.desc_nulls_last(F.coalesce("completed_at", "started_at")), F.desc("metric_run_id"))
        .limit(1)
        .select("metric_run_id")
    )


def metric_pivot(
    scores: DataFrame, keys: Sequence[str], names: Sequence[str], metric: str = "metric", score: str = "score"
) -> DataFrame:
    """One column per given metric, without a discovery pass."""
    return scores.groupBy(*keys).agg(
        *[F.max(F.when(F.col(metric) == n, F.col(score))).alias(n) for n in names]
    )


def unpivot(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return df.unpivot([F.col(k) for k in keys], [F.col(n) for n in names], "metric", "score")


def metric_population(
    pivoted: DataFrame, keys: Sequence[str], words: str, names: Sequence[str]
) -> DataFrame:
    """Aligned groups rolled up: count, total words and mean metrics; word-less runs dropped."""
    return (
        pivoted.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("aligned_groups"),
            F.sum(words).alias("reference_words"),
            *[F.avg(n).alias(f"mean_{n}") for n in names],
        )
        .where("reference_words is not null")
    )


def store_population(
    metric_runs: DataFrame,
    scores: DataFrame,
    groups: DataFrame,
    sets: DataFrame,
    *,
    prefix: str,
    names: Sequence[str],
    words: str,
) -> DataFrame:
    """Latest metric run x scores x aligned groups x sets, pivoted and rolled up."""
    run_id = json_int(F.col("response_json"), "$.translation_run_id")
    star = (
        scores.join(F.broadcast(latest_metric_run(metric_runs, prefix)), "metric_run_id", "left_semi")
        .join(groups.where(F.col("alignment_kind") == "aligned"), "alignment_group_id")
        .join(
            sets.select("alignment_set_id", "lemma_id", run_id.alias("translation_run_id")).where(
                "translation_run_id is not null"
            ),
            "alignment_set_id",
        )
    )
    per_group = metric_pivot(star, ["translation_run_id", "lemma_id", "alignment_group_id"], [*names, words])
    return metric_population(per_group, ["translation_run_id", "lemma_id"], words, names)


def profile_summary(
    runs: DataFrame, profile: Sequence[str], metrics: Sequence[str], composite: Sequence[str]
) -> DataFrame:
    """Mean of each metric per profile, their composite and its rank (one row per profile)."""
    means = runs.groupBy(*profile).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in metrics]
    )
    together = sum((F.col(f"mean_{m}") for m in composite[1:]), F.col(f"mean_{composite[0]}"))
    scored = means.withColumn("composite_similarity", F.round(together / len(composite), 9))
    order = Window.orderBy(F.desc("composite_similarity"), *profile)
    return scored.withColumn("lexical_rank", F.row_number().over(order))


def passage_means(runs: DataFrame, passage: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Collapse the profile grid to one row per passage."""
    means = runs.groupBy(*passage).agg(
        F.count(F.lit(1)).alias("profile_count"), *[F.avg(m).alias(f"passage_mean_{m}") for m in metrics]
    )
    together = sum((F.col(f"passage_mean_{m}") for m in metrics[1:]), F.col(f"passage_mean_{metrics[0]}"))
    return means.withColumn("passage_mean_primary", together / len(metrics))


def entry_means(scores: DataFrame, entry: str, score: str, reviewed: DataFrame) -> DataFrame:
    """Mean score and cells per entry, flagged when the entry was reviewed."""
    means = scores.groupBy(entry).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("cells"))
    flagged = reviewed.select(entry).distinct().withColumn("_in", F.lit(True))
    return means.join(flagged, entry, "left").withColumn("reviewer_set", F.col("_in").isNotNull()).drop("_in")


def divergence(similarity: Column) -> Column:
    return 1.0 - similarity


def rated_population(
    ratings: DataFrame, population: DataFrame, selection: DataFrame, run: str, entry: str
) -> DataFrame:
    """Ratings with the metrics of their run (inner) and their selection attributes (left)."""
    return ratings.join(population, run).join(selection, entry, "left")
