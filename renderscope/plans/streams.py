"""The live log as streams, run to the end of the available files."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from renderscope import schemas
from renderscope.plans import adapters as A
from renderscope.plans.registry import query, rounded
from renderscope.session import shared_folder
from renderscope.sources.readers import read_table
from renderscope.streaming import log as live
from renderscope.streaming import stateful


PARTS, FILES = 5, 4
#: Longer than an event is behind when it comes, shorter than the table.
LATE = "7 days"


def _arrived(spark, sf):
    """The events as a log that arrives in five parts of several files; every seventh event comes one part late."""
    events = read_table(spark, sf, "events")
    folder = f"{shared_folder(spark)}/arriving/{uuid.uuid4().hex}"
    last = events.agg(F.max("event_id").alias("_most"))  # one row
    late = (F.col("event_id") % 7 == 0).cast("int")
    part = F.least(F.lit(PARTS - 1), F.floor(F.col("event_id") * PARTS / (F.col("_most") + 1)) + late)
    events.crossJoin(F.broadcast(last)).withColumn("_part", part).write.partitionBy("_part").parquet(f"{folder}/dealt")
    dealt = spark.read.parquet(f"{folder}/dealt")
    for i in range(PARTS):  # each reads its own part only; files of one write make one batch
        dealt.where(F.col("_part") == i).select(*events.columns).repartition(FILES).write.mode("append").parquet(f"{folder}/log")
    return f"{folder}/log"


def _log(spark, sf):
    events = live.file_stream(spark, _arrived(spark, sf), schemas.EVENTS, files_per_batch=FILES)
    return A.from_events(events, A.document_sets(spark, sf))


def _run(start, stream, spark):
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    start(stream, folder, once=True).awaitTermination()
    return folder


@query("stream_state", f"WITH {A.LATEST} SELECT pack_slug, passage_id, variant_id, reviewer, id, rating, created_at FROM latest")
def stream_state(spark, sf):
    folder = _run(live.keep_table, live.current_ratings(_log(spark, sf)), spark)
    return live.read_kept(spark, folder, live.RATING_KEY)


@query("stream_status", f"""WITH {A.LOG} SELECT reviewer, count(*) AS transaction_count, count(DISTINCT passage_id) AS passage_count,
    count(*) FILTER (rating >= 7) AS high_difference_count, count(*) FILTER (rating <= 3) AS low_difference_count, max(updated_at) AS updated_at FROM log GROUP BY reviewer""")
def stream_status(spark, sf):
    folder = _run(live.keep_table, live.passage_activity(_log(spark, sf)), spark)
    return live.status_from_activity(live.read_kept(spark, folder, ["reviewer", "passage_id"]))


@query("stream_revisions", f"""WITH {A.LOG} SELECT id, reviewer, passage_id,
    CASE WHEN id = min(id) OVER (PARTITION BY reviewer, passage_id) THEN 'first' ELSE 'revision' END AS save_kind FROM log""")
def stream_revisions(spark, sf):
    folder = _run(live.keep_table, live.first_evaluations(_log(spark, sf)), spark)
    first = live.read_kept(spark, folder, live.EVALUATION_KEY)
    return live.tag_revisions(A.rating_log(spark, sf).select("id", "reviewer", "passage_id"), first)


@query("stream_revision_tags", f"""WITH {A.LOG} SELECT id, reviewer, passage_id,
    CASE WHEN id = min(id) OVER (PARTITION BY reviewer, passage_id) THEN 'first' ELSE 'revision' END AS save_kind FROM log""")
def stream_revision_tags(spark, sf):
    """The tag leaves the stream itself; a late lower id takes it over."""
    stateful.use_rocksdb(spark)
    folder = _run(live.keep_table, stateful.tagged_saves(_log(spark, sf)), spark)
    return live.read_kept(spark, folder, ["id"]).select("id", "reviewer", "passage_id", "save_kind")


GAP, SESSION_LATE = "6 hours", "3 days"
#: Parts of the log, and of each row whether it is more than the delay behind the newest of earlier parts.
TIMELY = f"""{A.LOG}, dealt AS (SELECT *, least({PARTS - 1}, floor(id * {PARTS} / (max(id) OVER () + 1)) + (id % 7 = 0)::INT) AS part FROM log),
  newest AS (SELECT part, max(max(created_at)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 3 DAY AS horizon FROM dealt GROUP BY part),
  judged AS (SELECT d.*, coalesce(d.created_at < n.horizon, FALSE) AS behind FROM dealt d JOIN newest n USING (part))"""


def _gated(spark, sf):
    return _run(partial(live.drop_late, late=SESSION_LATE), _log(spark, sf), spark)


@query("stream_late_saves", f"""WITH {TIMELY} SELECT reviewer, count(*) AS saves, count(*) FILTER (behind) AS late FROM judged GROUP BY reviewer""")
def stream_late_saves(spark, sf):
    """Saves behind the watermark, kept in a side table."""
    folder = _gated(spark, sf)
    kinds = [spark.read.parquet(f"{folder}/{k}").select("reviewer", F.lit(k).alias("kind")) for k in ("timely", "late")]
    return kinds[0].unionByName(kinds[1]).groupBy("reviewer").agg(
        F.count("*").alias("saves"), F.count_if(F.col("kind") == "late").alias("late")
    )


@query("stream_sessions", f"""WITH {TIMELY}, m AS (SELECT reviewer, created_at, CASE WHEN created_at - lag(created_at) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
    FROM judged WHERE NOT behind WINDOW w AS (PARTITION BY reviewer ORDER BY created_at)),
  s AS (SELECT reviewer, created_at, sum(fresh) OVER (PARTITION BY reviewer ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS k FROM m)
  SELECT reviewer, min(created_at) AS session_start, max(created_at) + INTERVAL 6 HOUR AS session_end, count(*) AS saves FROM s GROUP BY reviewer, k""")
def stream_sessions(spark, sf):
    """Sessions as they close in the stream; the end of the log closes the open ones."""
    folder = _gated(spark, sf)
    arriving = f"{folder}/ordered"
    timely = spark.read.parquet(f"{folder}/timely")
    for i in range(PARTS):  # in order of the gate's batches
        rows = timely.where(F.col(live.BATCH) == i).drop(live.BATCH)
        rows.withColumn("created_at", F.col("created_at").cast("timestamp")).repartition(FILES).write.mode("append").parquet(arriving)
    like = spark.read.parquet(arriving)
    live.close_sessions(spark, arriving, like, after="30 days")
    log = live.file_stream(spark, arriving, like.schema.simpleString()[7:-1].replace(":", " "), files_per_batch=FILES)
    start = partial(live.session_stream, gap=GAP, late=SESSION_LATE)
    done = _run(start, log, spark)
    live.close_sessions(spark, arriving, like, after="30 days")
    start(log, done, once=True).awaitTermination()  # goes on from its checkpoint
    out = spark.read.parquet(f"{done}/sessions").drop(live.BATCH)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("stream_ingest", f"""WITH {A.LOG} SELECT reviewer, count(*) FILTER (floor(value / 10) <= 10) AS good,
    count(*) FILTER (floor(value / 10) > 10) AS quarantined FROM log GROUP BY reviewer""")
def stream_ingest(spark, sf):
    saves = _log(spark, sf).select(
        "id", "passage_id", "variant_id", "reviewer", F.floor(F.col("value") / 10).cast("string").alias("rating"),
        F.lit("{}").alias("exposure_json"),
    )
    folder = _run(live.ingest, saves, spark)
    parts = [
        spark.read.parquet(f"{folder}/{name}").select("reviewer", F.lit(name).alias("kind")) for name in ("good", "quarantine")
    ]
    return parts[0].unionByName(parts[1]).groupBy("reviewer").agg(
        F.count_if(F.col("kind") == "good").alias("good"), F.count_if(F.col("kind") == "quarantine").alias("quarantined")
    )


@query("stream_gaps", f"""WITH {A.LOG} SELECT id, reviewer,
    round(epoch_us(created_at - lag(created_at) OVER (PARTITION BY reviewer ORDER BY id)) / 1e6, 6) AS seconds_since_previous FROM log""")
def stream_gaps(spark, sf):
    folder = _run(partial(live.save_gaps, late=LATE), _log(spark, sf), spark)
    return rounded(live.read_gaps(spark, folder), "seconds_since_previous")


@query("stream_visibility", f"""WITH {A.LOG}, sig AS (SELECT reviewer AS save_id, variant_id, id, passage_id >= 10 AND value / 100 >= 0.25 AS visible,
    epoch_us(created_at) / 1000 AS at_ms, value / 100 AS ratio FROM log),
  steps AS (SELECT *, coalesce(lag(visible) OVER w, FALSE) AS was, lag(at_ms) OVER w AS prev FROM sig WINDOW w AS (PARTITION BY save_id, variant_id ORDER BY id)),
  captured AS (SELECT save_id, max(at_ms) + 5000 AS captured_ms FROM sig GROUP BY save_id),
  totals AS (SELECT save_id, variant_id, sum(CASE WHEN was THEN greatest(0, at_ms - prev) ELSE 0 END) AS visible_ms, count(*) FILTER (visible AND NOT was) AS view_count,
    min(at_ms) FILTER (visible) AS first_visible_ms, max(at_ms) FILTER (was) AS last_visible_ms, max(ratio) FILTER (visible) AS max_ratio,
    max_by(visible, id) AS still, max_by(at_ms, id) AS last_ms FROM steps GROUP BY ALL)
  SELECT save_id, variant_id, round(visible_ms + CASE WHEN still AND captured_ms > last_ms THEN captured_ms - last_ms ELSE 0 END, 3) AS visible_ms, view_count,
    round(first_visible_ms, 3) AS first_visible_ms,
    round(CASE WHEN still AND captured_ms > last_ms THEN greatest(coalesce(last_visible_ms, captured_ms), captured_ms) ELSE last_visible_ms END, 3) AS last_visible_ms,
    round(max_ratio, 6) AS max_ratio
  FROM totals JOIN captured USING (save_id)""")
def stream_visibility(spark, sf):
    def signals(log):
        return live.visibility_signals(
            log.select(
                F.col("reviewer").alias("save_id"), "variant_id", F.col("id").alias("seq"),
                (F.unix_micros(F.col("created_at").cast("timestamp")) / 1000).alias("at_ms"),
                (F.col("value") / 100).alias("ratio"), F.lit(True).alias("helpers_visible"),
                (F.col("passage_id") < 10).alias("page_hidden"),
            )
        )

    folder = _run(partial(live.visibility_clock, late=LATE), signals(_log(spark, sf)), spark)
    captures = signals(A.rating_log(spark, sf)).groupBy("save_id").agg((F.max("at_ms") + 5000).alias("captured_ms"))
    clock = rounded(live.read_clock(spark, folder, captures), "visible_ms", "first_visible_ms", "last_visible_ms", places=3)
    return rounded(clock, "max_ratio")


@query("stream_activity", """SELECT date_trunc('hour', ts) AS window_start, count(*) AS saves FROM events GROUP BY ALL""")
def stream_activity(spark, sf):
    log = _log(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))
    folder = _run(live.keep_table, live.activity(log), spark)
    kept = live.read_kept(spark, folder, ["window_start"])
    return kept.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("reviewing_sessions", f"""WITH {A.LOG}, m AS (SELECT reviewer, created_at, CASE WHEN created_at - lag(created_at) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
    FROM log WINDOW w AS (PARTITION BY reviewer ORDER BY created_at)),
  s AS (SELECT reviewer, created_at, sum(fresh) OVER (PARTITION BY reviewer ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS k FROM m)
  SELECT reviewer, min(created_at) AS session_start, max(created_at) + INTERVAL 6 HOUR AS session_end, count(*) AS saves FROM s GROUP BY reviewer, k""")
def reviewing_sessions(spark, sf):
    log = A.rating_log(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))
    out = live.sessions(log, gap="6 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
