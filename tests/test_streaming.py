"""Streams over several files, with late ids and repeated batches."""

import random
import tempfile
from datetime import datetime, timedelta
from functools import partial

import pytest
from pyspark.sql import functions as F

from renderscope.operators import ratings, timing
from renderscope.streaming import log as live
from renderscope.streaming import stateful

SCHEMA = (
    "id long, pack_slug string, passage_id long, variant_id string, reviewer string, rating int, "
    "created_at timestamp, updated_at timestamp, treatment string"
)


@pytest.fixture(scope="module")
def saves(spark):
    rng = random.Random(3)
    start = datetime(2026, 1, 1)
    rows = []
    for i in range(240):
        at = start + timedelta(minutes=7 * i)
        rows.append((i, "p", rng.randrange(6), str(rng.randrange(2)), f"r{rng.randrange(4) if rng.random() < .6 else 0}",
                     rng.choice([None, 1, 5, 9]), at, at, "single"))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for part in range(4):
        chunk = rows[part * 60:(part + 1) * 60]
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.createDataFrame(rows, SCHEMA).cache()


def stream(spark, folder):
    return live.file_stream(spark, folder, SCHEMA, files_per_batch=1)


def run(start, df):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    start(df, folder, once=True).awaitTermination()
    return folder


def test_current_state(spark, saves):
    out = run(live.keep_table, live.current_ratings(stream(spark, saves[0])))
    got = {tuple(r[k] for k in live.RATING_KEY): (r.id, r.rating) for r in live.read_kept(spark, out, live.RATING_KEY).collect()}
    want = {tuple(r[k] for k in live.RATING_KEY): (r.id, r.rating) for r in ratings.latest(saves[1]).collect()}
    assert got == want


def test_status_and_first(spark, saves):
    out = run(live.keep_table, live.passage_activity(stream(spark, saves[0])))
    kept = live.read_kept(spark, out, ["reviewer", "passage_id"])
    assert sorted(live.status_from_activity(kept).collect()) == sorted(ratings.reviewer_status(saves[1]).collect())
    out = run(live.keep_table, live.first_evaluations(stream(spark, saves[0])))
    tagged = live.tag_revisions(saves[1], live.read_kept(spark, out, live.EVALUATION_KEY))
    assert tagged.where("save_kind = 'first'").count() == ratings.first(saves[1]).count()


def test_gaps_carry_over_batches(spark, saves):
    out = run(live.save_gaps, stream(spark, saves[0]))
    gaps = {r.id: r.seconds_since_previous for r in live.read_gaps(spark, out).collect()}
    want = {r.id: r.seconds_since_previous for r in timing.save_gaps(saves[1]).collect()}
    assert spark.read.parquet(f"{out}/gaps").select("batch_id").distinct().count() == 4
    assert gaps == want


def late_files(spark, seed):
    """Saves dealt over five files, many of them after newer ones."""
    rng = random.Random(seed)
    start = datetime(2026, 1, 1)
    rows = [
        (i, "p", 1, "1", f"r{rng.randrange(3)}", 5, start + timedelta(minutes=3 * i), start, "single") for i in range(120)
    ]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    files = [[] for _ in range(5)]
    for r in rows:
        files[min(4, r[0] // 30 + rng.randrange(2))].append(r)
    for part in files:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_late_saves_correct_the_gap_that_follows(spark, seed):
    folder, every = late_files(spark, seed)
    out = run(live.save_gaps, stream(spark, folder))
    got = {r.id: r.seconds_since_previous for r in live.read_gaps(spark, out).collect()}
    assert got == {r.id: r.seconds_since_previous for r in timing.save_gaps(every).collect()}
    kept = spark.read.parquet(f"{out}/recent").groupBy("batch_id").count().collect()
    assert len(kept) == 5


def test_a_repeated_batch_changes_nothing(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    at = datetime(2026, 1, 1)
    parts = [[(1, at), (3, at + timedelta(minutes=10))], [(2, at + timedelta(minutes=4))]]
    batches = [spark.createDataFrame([("r", i, t) for i, t in p], "reviewer string, id long, created_at timestamp") for p in parts]
    found = []
    for _ in range(2):
        for n in (0, 1, 1):
            rows = live.with_neighbours(batches[n], folder, n, ["reviewer"], "id", "created_at", ["created_at"], "1 day")
            found.append(sorted((r.id, r["_kept"]) for r in rows.collect()))
    assert found == [[(1, False), (3, False)], [(1, True), (2, False), (3, True)], [(1, True), (2, False), (3, True)]] * 2


def test_a_batch_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("timestamp")
    def seen(second):
        read.add(1)
        return datetime(2026, 1, 1) + timedelta(seconds=second)

    batch = spark.range(40).select(F.lit("r").alias("reviewer"), "id", seen("id").alias("created_at"))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = live.with_neighbours(batch, folder, 0, ["reviewer"], "id", "created_at", ["created_at"], "1 day")
    assert (rows.count(), rows.where("created_at is null").count(), read.value) == (40, 0, 40)


def test_ingest_splits_good_from_bad(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "id long, passage_id string, rating string, exposure_json string"
    rows = [(1, "7", "4", "{}"), (2, "7", "8", '{"v": 1}'), (3, "7", "12", "{}"), (4, "7", "3", "oops"), (5, None, "3", "{}")]
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
    out = run(live.ingest, live.file_stream(spark, folder, schema, files_per_batch=2))
    good = spark.read.parquet(f"{out}/good").orderBy("id").collect()
    assert [(r.id, r.rating, r.exposure_json) for r in good] == [(1, 4, "{}"), (2, 8, '{"v": 1}')]
    bad = spark.read.parquet(f"{out}/quarantine").orderBy("id").collect()
    assert [r.id for r in bad] == [3, 4, 5] and all(r.reason for r in bad)


def test_visibility_clock(spark):
    """Start, a repeated start, stop, start again, and a capture that stops the clock."""
    rows = [  # seq, ms, ratio, helpers visible, hidden
        (1, 0.0, 0.1, True, False), (2, 100.0, 0.3, True, False), (3, 150.0, 0.9, True, False), (4, 400.0, 0.9, True, True),
        (5, 500.0, 0.25, True, False), (6, 700.0, 0.25, False, False),
    ]
    schema = "save_id string, variant_id string, seq long, at_ms double, ratio double, helpers_visible boolean, page_hidden boolean"
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for seq, *rest in rows:
        spark.createDataFrame([("s", "v", seq, *rest)], schema).coalesce(1).write.mode("append").parquet(folder)
    signals = live.visibility_signals(live.file_stream(spark, folder, schema, files_per_batch=1))
    out = run(live.visibility_clock, signals)
    clock = live.read_clock(spark, out).first()
    assert (clock.visible_ms, clock.view_count, clock.first_visible_ms, clock.last_visible_ms, clock.max_ratio) == (500.0, 2, 100.0, 700.0, 0.9)


def test_an_open_interval_lasts_until_the_capture(spark):
    schema = "save_id string, variant_id string, seq long, at_ms double, ratio double, helpers_visible boolean, page_hidden boolean"
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for seq, ms in ((1, 100.0), (3, 400.0), (2, 250.0)):  # the second signal comes last
        row = ("s", "v", seq, ms, 0.9, True, seq == 2)
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
    out = run(live.visibility_clock, live.visibility_signals(live.file_stream(spark, folder, schema, files_per_batch=1)))
    captures = spark.createDataFrame([("s", 1000.0)], "save_id string, captured_ms double")
    clock = live.read_clock(spark, out, captures).first()
    assert (clock.visible_ms, clock.view_count, clock.last_visible_ms) == (150.0 + 600.0, 2, 1000.0)
    assert live.read_clock(spark, out).first().visible_ms == 150.0


def test_sessions_and_activity_as_streams(spark, saves):
    batch = live.sessions(saves[1], gap="20 minutes").agg(F.sum("saves")).first()[0]
    assert batch == 240
    name = "sessions_" + str(random.randrange(10**9))
    query = (
        live.sessions(stream(spark, saves[0]), gap="20 minutes", late="5 minutes")
        .writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    closed = {tuple(r) for r in spark.table(name).collect()}
    assert closed and closed <= {tuple(r) for r in live.sessions(saves[1], gap="20 minutes").collect()}
    out = run(live.keep_table, live.activity(stream(spark, saves[0])))
    assert live.read_kept(spark, out, ["window_start"]).agg(F.sum("saves")).first()[0] == 240


def test_tags_leave_the_stream(spark):
    stateful.use_rocksdb(spark)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "id long, reviewer string, passage_id long"
    batches = [[(5, "a", 1), (7, "a", 1), (6, "a", 2)], [(3, "a", 1), (9, "b", 1), (5, "a", 1)], [(4, "a", 1), (8, None, 1), (None, "a", 1)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    out = run(live.keep_table, stateful.tagged_saves(live.file_stream(spark, folder, schema, files_per_batch=1)))
    rows = spark.read.parquet(f"{out}/table").collect()
    # The late lower id takes the tag over, and the save that held it goes out again.
    assert {(r.id, r.save_kind) for r in rows if r.batch_id == 1} == {(3, "first"), (9, "first"), (5, "revision")}
    newest = {r.id: r.save_kind for r in live.read_kept(spark, out, ["id"]).collect()}
    assert newest == {3: "first", 4: "revision", 5: "revision", 6: "first", 7: "revision", 8: "first", 9: "first"}


def test_keys_of_tags_do_not_follow_the_reviewers(spark):
    stateful.use_rocksdb(spark)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "id long, reviewer string, passage_id long"
    rows = [(i, f"r{i % 50}", i % 3) for i in range(300)]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    tagged = stateful.tagged_saves(live.file_stream(spark, folder, schema), buckets=8)
    query = live.keep_table(tagged, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), once=True)
    query.awaitTermination()
    assert query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 8


def test_sessions_close_and_state_shrinks(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    start, schema = datetime(2026, 1, 1), "reviewer string, created_at timestamp"
    for day in range(4):
        rows = [(f"r{i}", start + timedelta(days=day, minutes=i)) for i in range(40)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    log = live.file_stream(spark, folder, schema, files_per_batch=1)
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    query = live.session_stream(log, out, once=True)
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 80
    assert spark.read.parquet(f"{out}/sessions").count() == 120  # the last day's are open
    for _ in range(2):
        live.close_sessions(spark, folder, spark.read.parquet(folder), after="1 day")
        query = live.session_stream(log, out, once=True)
        query.awaitTermination()
    assert spark.read.parquet(f"{out}/sessions").count() == 160
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 2  # no session is left but the closing rows


def test_late_rows_are_kept_aside(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    start, schema = datetime(2026, 1, 1), "reviewer string, created_at timestamp"
    parts = [[("a", start), ("a", start + timedelta(hours=5))], [("b", start + timedelta(hours=3)), ("b", start + timedelta(hours=9)), ("c", None)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    log = live.file_stream(spark, folder, schema, files_per_batch=1)
    out = run(partial(live.drop_late, late="1 hour"), log)
    late = [(r.reviewer, r.batch_id) for r in spark.read.parquet(f"{out}/late").collect()]
    assert sorted(late) == [("b", 1), ("c", 1)] and spark.read.parquet(f"{out}/timely").count() == 3
