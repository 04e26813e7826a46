"""The live rating log as Structured Streaming jobs.

Aggregates with small state (current rating, first evaluation, per-passage
activity) use streaming aggregation in update mode.  Operators that look at the
row before (save gaps, visibility clocks) work micro-batch by micro-batch on
distributed windows and carry the last row per key in a table.  Every output is
written under its batch id, so a batch that runs again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from renderscope.functions.splits import previous_rows
from renderscope.operators.ratings import (
    EVALUATION_KEY,
    RATING_KEY,
    accepted,
    quarantined,
    validated,
)
from renderscope.operators.timing import seconds_between
from renderscope.session import staged

BATCH = "batch_id"


def file_stream(
    spark: SparkSession, folder: str, schema: str, *, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def _start(
    stream: DataFrame, work: Callable[[DataFrame, int], None], folder: str, mode: str, once: bool
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(work).option(
        "checkpointLocation", f"{folder}/_checkpoint"
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest(saves: DataFrame, folder: str, *, once: bool = False) -> StreamingQuery:
    """Append good saves to ``good`` and the others, with a reason, to ``quarantine``."""
    def work(batch: DataFrame, batch_id: int) -> None:
        checked = validated(batch)
        write_batch(accepted(checked), f"{folder}/good", batch_id)
        write_batch(quarantined(checked), f"{folder}/quarantine", batch_id)

    return _start(saves, work, folder, "append", once)


def keep_table(updates: DataFrame, folder: str, *, once: bool = False) -> StreamingQuery:
    """Write the keys an update-mode aggregation changed, batch by batch."""
    return _start(updates, lambda b, i: write_batch(b, f"{folder}/table", i), folder, "update", once)


def read_kept(spark: SparkSession, folder: str, key: Sequence[str]) -> DataFrame:
    """Newest value per key of a kept table."""
    table = spark.read.parquet(f"{folder}/table")
    rest = [c for c in table.columns if c not in key and c != BATCH]
    newest = table.groupBy(*key).agg(F.max_by(F.struct(*rest), BATCH).alias("_v"))
    return newest.select(*key, *[F.col("_v")[c].alias(c) for c in rest])


def _edge_state(log: DataFrame, key: Sequence[str], edge: Callable, columns: Sequence[str]) -> DataFrame:
    state = log.groupBy(*key).agg(edge(F.struct(*columns), F.col("id")).alias("_v"))
    return state.select(*key, *[F.col("_v")[c].alias(c) for c in columns])


def current_ratings(log: DataFrame, columns: Sequence[str] = ("id", "rating", "created_at")) -> DataFrame:
    """Highest id wins, whatever the arrival order; a NULL rating also supersedes."""
    return _edge_state(log, RATING_KEY, F.max_by, columns)


def first_evaluations(log: DataFrame, columns: Sequence[str] = ("id", "variant_id", "rating", "created_at")) -> DataFrame:
    return _edge_state(log, EVALUATION_KEY, F.min_by, columns)


def tag_revisions(log: DataFrame, first: DataFrame) -> DataFrame:
    """Every save as ``first`` or ``revision``, against the kept first evaluations."""
    firsts = first.select(*EVALUATION_KEY, F.col("id").alias("_first"))
    return log.join(firsts, list(EVALUATION_KEY)).withColumn(
        "save_kind", F.when(F.col("id") == F.col("_first"), "first").otherwise("revision")
    ).drop("_first")


def passage_activity(log: DataFrame) -> DataFrame:
    """Running counts per (reviewer, passage); status is their roll-up, so distinct passages are exact."""
    return log.groupBy("reviewer", "passage_id").agg(
        F.count(F.lit(1)).alias("saves"),
        F.count_if(F.col("rating") >= 7).alias("high"),
        F.count_if(F.col("rating") <= 3).alias("low"),
        F.max("updated_at").alias("updated_at"),
    )


def status_from_activity(activity: DataFrame) -> DataFrame:
    return activity.groupBy("reviewer").agg(
        F.sum("saves").alias("transaction_count"),
        F.count("passage_id").alias("passage_count"),
        F.sum("high").alias("high_difference_count"),
        F.sum("low").alias("low_difference_count"),
        F.max("updated_at").alias("updated_at"),
    )


def _recent(rows: DataFrame, key: Sequence[str], order: str, at: str, late: str) -> DataFrame:
    """Rows that a row at most ``late`` behind the newest can still have for a neighbour.

    Those inside the delay, and of each key the last one before it.
    """
    newest = rows.agg((F.max(at) - F.expr(f"interval {late}")).alias("_horizon"))
    marked = rows.crossJoin(F.broadcast(newest))  # one row
    old = marked.where(F.col(at) < F.col("_horizon")).groupBy(*key).agg(F.max(order).alias("_edge"))
    return (
        marked.join(old, list(key), "left")
        .where((F.col(at) >= F.col("_horizon")) | (F.col(order) == F.col("_edge")))
        .drop("_horizon", "_edge")
    )


def with_neighbours(
    batch: DataFrame, folder: str, batch_id: int, key: Sequence[str], order: str, at: str, columns: Sequence[str], late: str
) -> DataFrame:
    """The batch and the kept rows, each once, kept ones marked ``_kept``, staged; keeps the rows for the next batch.

    The kept table is written anew under every batch id and only the one before
    is read, so a batch costs what is inside the delay, not what has gone by.
    A repeated batch finds what it found the first time.  The batch is read once.
    """
    rows = batch.select(*key, order, *columns).dropDuplicates([*key, order]).withColumn("_kept", F.lit(False))
    if batch_id > 0:
        before = batch.sparkSession.read.parquet(f"{folder}/recent/{BATCH}={batch_id - 1}")
        kept = before.select(*key, order, *columns).withColumn("_kept", F.lit(True))
        again = rows.select(*key, order)
        rows = rows.unionByName(kept.join(again, [*key, order], "left_anti"))
    rows = staged(rows)
    write_batch(_recent(rows.drop("_kept"), key, order, at, late), f"{folder}/recent", batch_id)
    return rows


def save_gaps(log: DataFrame, folder: str, *, late: str = "1 day", once: bool = False) -> StreamingQuery:
    """Seconds since the reviewer's previous save, in id order, to ``gaps``.

    Saves may come up to ``late`` after newer ones: the gap of the save that
    follows is then written again under the later batch.  ``read_gaps`` takes
    the last word on each save.
    """
    key, order, columns = ["reviewer"], "id", ["created_at"]

    def work(batch: DataFrame, batch_id: int) -> None:
        rows = with_neighbours(batch, folder, batch_id, key, order, "created_at", columns, late)
        gaps = previous_rows(rows, key, order, {"_before": "created_at", "_before_kept": "_kept"}, on_disk=True)
        # Anew: saves of this batch, and kept ones that now follow a save of this batch.
        changed = gaps.where("not _kept or not _before_kept")
        write_batch(
            changed.select(
                *key, order, seconds_between(F.col("_before"), F.col("created_at")).alias("seconds_since_previous")
            ),
            f"{folder}/gaps",
            batch_id,
        )

    return _start(log, work, folder, "append", once)


def read_gaps(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/gaps")
    return rows.groupBy("reviewer", "id").agg(F.max_by("seconds_since_previous", BATCH).alias("seconds_since_previous"))


VISIBILITY_THRESHOLD = 0.25  # fixed value
CLOCK_KEY = ("save_id", "variant_id")


def visibility_signals(observations: DataFrame) -> DataFrame:
    """Start or stop from the observed share of a card on screen."""
    on = F.col("helpers_visible") & ~F.col("page_hidden") & (F.col("ratio") >= VISIBILITY_THRESHOLD)
    return observations.withColumn("visible", F.coalesce(on, F.lit(False)))


def visibility_intervals(
    rows: DataFrame, order: str = "seq", also: Mapping[str, str] | None = None, *, on_disk: bool = False
) -> DataFrame:
    """Per signal, the visible time that ends with it.

    After any signal the card is visible exactly when that signal was a start,
    so the time since the previous signal counts when that one was a start.
    ``also`` maps names to further columns of the previous signal.
    """
    steps = previous_rows(rows, CLOCK_KEY, order, {"_was": "visible", "_at": "at_ms", **(also or {})}, on_disk=on_disk)
    was = F.coalesce(F.col("_was"), F.lit(False))
    return (
        steps.withColumn("visible_ms", F.when(was, F.greatest(F.lit(0.0), F.col("at_ms") - F.col("_at"))).otherwise(0.0))
        .withColumn("opens", F.col("visible") & ~was)
        .withColumn("last_visible_ms", F.when(was, F.col("at_ms")))
        .drop("_was", "_at")
    )


def visibility_totals(intervals: DataFrame, by: Sequence[str] = CLOCK_KEY, *more: Column) -> DataFrame:
    return intervals.groupBy(*by).agg(
        F.sum("visible_ms").alias("visible_ms"),
        F.count_if("opens").alias("view_count"),
        F.min(F.when(F.col("visible"), F.col("at_ms"))).alias("first_visible_ms"),
        F.max("last_visible_ms").alias("last_visible_ms"),
        F.max(F.when(F.col("visible"), F.col("ratio"))).alias("max_ratio"),
        *more,
    )


def visibility_clock(signals: DataFrame, folder: str, *, late: str = "1 day", once: bool = False) -> StreamingQuery:
    """Visible time that ends with each signal of a (save, variant), to ``clock``; a save's clock starts at zero.

    Signals may come late: the one that follows is then written again.
    """
    key, order, columns = list(CLOCK_KEY), "seq", ["visible", "at_ms", "ratio"]

    def work(batch: DataFrame, batch_id: int) -> None:
        timed = batch.withColumn("_at", F.timestamp_millis(F.col("at_ms").cast("long")))
        rows = with_neighbours(timed, folder, batch_id, key, order, "_at", [*columns, "_at"], late).drop("_at")
        intervals = visibility_intervals(rows, order, {"_before_kept": "_kept"}, on_disk=True)
        changed = intervals.where("not _kept or not _before_kept").drop("_kept", "_before_kept")
        write_batch(changed, f"{folder}/clock", batch_id)

    return _start(signals, work, folder, "append", once)


def read_clock(spark: SparkSession, folder: str, captures: DataFrame | None = None) -> DataFrame:
    """Totals per (save, variant).

    ``captures`` (save_id, captured_ms) are the ends of the saves: a card that
    was visible at its last signal stays so until then.
    """
    rows = spark.read.parquet(f"{folder}/clock")
    rest = [c for c in rows.columns if c not in (*CLOCK_KEY, "seq", BATCH)]
    # Column by column: a struct in the buffer would be sorted.
    intervals = rows.groupBy(*CLOCK_KEY, "seq").agg(*[F.max_by(c, BATCH).alias(c) for c in rest])
    if captures is None:
        return visibility_totals(intervals)
    last = [F.max_by(c, "seq").alias(f"_last_{c}") for c in ("visible", "at_ms")]
    totals = visibility_totals(intervals, CLOCK_KEY, *last)
    closed = totals.join(captures.select("save_id", "captured_ms"), "save_id", "left")
    still = F.col("_last_visible") & (F.col("captured_ms") > F.col("_last_at_ms"))
    open_until = F.when(still, F.col("captured_ms"))
    return (
        closed.withColumn("visible_ms", F.col("visible_ms") + F.coalesce(open_until - F.col("_last_at_ms"), F.lit(0.0)))
        .withColumn("last_visible_ms", F.greatest("last_visible_ms", open_until))
        .select(*[c for c in totals.columns if not c.startswith("_last")])
    )


def sessions(log: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour", by: Column | str = "reviewer") -> DataFrame:
    """Reviewing sessions: saves no further apart than ``gap``."""
    windowed = log.withWatermark("created_at", late) if log.isStreaming else log
    return windowed.groupBy(by, F.session_window("created_at", gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("saves")
    ).select(by, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "saves")


def drop_late(log: DataFrame, folder: str, *, at: str = "created_at", late: str = "1 hour", once: bool = False) -> StreamingQuery:
    """Rows in time to ``timely``, those more than ``late`` behind the newest row of earlier batches to ``late``.

    The same rule as a watermark, with the rows kept that a watermark drops in
    silence. A batch's newest time is written with it, one row, so that a
    repeated batch decides as it did the first time. Rows without a time are late.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        horizon = F.lit(None).cast("timestamp")
        if batch_id > 0:
            newest = batch.sparkSession.read.schema(f"newest timestamp, {BATCH} long").parquet(f"{folder}/newest")
            newest = newest.where(F.col(BATCH) < batch_id).agg((F.max("newest") - F.expr(f"interval {late}")).alias("_horizon"))
            rows, horizon = rows.crossJoin(F.broadcast(newest)), F.col("_horizon")  # one row
        behind = F.coalesce(F.col(at).cast("timestamp") < horizon, F.col(at).isNull())
        write_batch(rows.where(~behind).select(*batch.columns), f"{folder}/timely", batch_id)
        write_batch(rows.where(behind).select(*batch.columns), f"{folder}/late", batch_id)
        write_batch(batch.agg(F.max(at).cast("timestamp").alias("newest")), f"{folder}/newest", batch_id)

    return _start(log, work, folder, "append", once)


def close_sessions(spark: SparkSession, folder: str, like: DataFrame, *, at: str = "created_at", after: str) -> None:
    """End a finished log: a row without a reviewer, ``after`` its last save, moves the watermark past all sessions.

    They come out with the next batch that has rows, so a log is closed twice.
    """
    end = spark.read.schema(like.schema).parquet(folder).agg((F.max(at) + F.expr(f"interval {after}")).alias(at))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != at else F.col(at).cast(f.dataType) for f in like.schema]
    end.where(F.col(at).isNotNull()).select(*rest).write.mode("append").parquet(folder)


def session_stream(log: DataFrame, folder: str, *, gap: str = "30 minutes", late: str = "1 hour", once: bool = False) -> StreamingQuery:
    """Sessions to ``sessions`` once the watermark has passed their end; state holds the open ones alone."""

    def work(batch: DataFrame, batch_id: int) -> None:
        # Here and not in the stream, where the filter would pass below the watermark and hide the closing row from it.
        write_batch(batch.where("reviewer is not null"), f"{folder}/sessions", batch_id)

    return _start(sessions(log, gap=gap, late=late), work, folder, "append", once)


def activity(log: DataFrame, *, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling save counts."""
    windowed = log.withWatermark("created_at", late) if log.isStreaming else log
    return windowed.groupBy(F.window("created_at", width).alias("_w")).agg(
        F.count(F.lit(1)).alias("saves")
    ).select(F.col("_w.start").alias("window_start"), "saves")
