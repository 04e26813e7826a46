"""Readers, sinks and stored tables."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from renderscope import schemas
from renderscope.operators import metricstore, packs, planning
from renderscope.sources import readers, sinks, tables


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_csv_values(spark):
    df = spark.createDataFrame([(1, 0.5, True, "a,b"), (2, float("nan"), False, None), (3, float("inf"), None, "q\"x")],
                               "id int, score double, ok boolean, note string")
    out = folder() + "/csv"
    sinks.write_csv(df, out, ["id", "ok", "score", "absent", "note"])
    back = readers.read_csv(spark, out, "id int, ok boolean, score double, absent string, note string").orderBy("id").collect()
    assert [(r.id, r.ok, r.score, r.absent, r.note) for r in back] == [
        (1, True, 0.5, None, "a,b"), (2, False, None, None, None), (3, None, None, None, 'q"x')]


def test_csv_union_of_columns(spark):
    out = folder() + "/csv"
    sinks.write_csv_union(out, spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2, 3)], "a int, c int"))
    back = readers.read_csv(spark, out, "a int, b string, c int").orderBy("a").collect()
    assert [tuple(r) for r in back] == [(1, "x", None), (2, None, 3)]


def test_rating_log_csv(spark):
    out = folder()
    with open(f"{out}/log.csv", "w") as f:
        f.write("id,pack_slug,passage_id,variant_id,reviewer,rating,most_trusted,least_trusted,notes,exposure_json,created_at,updated_at\n")
        f.write('1,p,7,cc-3,r,,0,1,,"{""a"": 1}",2026-01-01 00:00:00,2026-01-01T00:00:05Z\n')
    row = readers.read_rating_log(spark, out, packs=["p"]).first()
    assert (row.rating, row.least_trusted, row.exposure_json) == (None, 1, '{"a": 1}')
    assert (row.updated_at - row.created_at).total_seconds() == 5


def test_manifest_and_scores(spark):
    out = folder()
    passages = [{"selection_rank": i, "tier": "t1" if i < 2 else "t2", "lemma_id": 10 + i} for i in range(3)]
    with open(f"{out}/m.json", "w") as f:
        json.dump({"selection_slug": "s", "seed": 5, "passages": passages}, f, indent=2)
    assert readers.read_manifest(spark, f"{out}/m.json", tiers=["t1"]).count() == 2
    with open(f"{out}/s.json", "w") as f:
        json.dump({"status": {"m1": "ok"}, "scores": [{"row_index": 0, "m1": 0.5}, {"row_index": 2}]}, f, indent=2)
    rows = sinks.scoring_request(spark.createDataFrame([("b",), ("a",), ("c",)], "key string").withColumn("k", F.ascii("key")), "k")
    merged = readers.merge_scores(rows, readers.read_scores(spark, f"{out}/s.json", ["m1"])).orderBy("row_index").collect()
    assert [(r.key, r.row_index, r.m1) for r in merged] == [("a", 0, 0.5), ("b", 1, None), ("c", 2, None)]
    assert readers.read_score_status(spark, f"{out}/s.json").first().status == "ok"


def test_upsert_and_replace(spark):
    path = folder() + "/t"
    tables.write_version(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, 1)
    tables.upsert(spark, path, spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), ["k"], 2)
    assert sorted(tuple(r) for r in tables.current_version(spark, path).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert spark.read.parquet(path).count() == 5
    items = folder() + "/items"
    tables.replace_partition(spark.createDataFrame([(1, 7), (1, 8), (2, 9)], "s int, i int"), items, "s")
    tables.replace_partition(spark.createDataFrame([(1, 6)], "s int, i int"), items, "s")
    assert sorted((r.s, r.i) for r in spark.read.parquet(items).collect()) == [(1, 6), (2, 9)]


def test_database_scan(spark):
    """The bundled in-memory database stands in for a server."""
    url = "jdbc:derby:memory:reviews;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(50).select("id", (F.col("id") % 5).alias("passage"))
    rows.write.format("jdbc").options(url=url, dbtable="runs", **driver).mode("overwrite").save()
    scan = readers.read_jdbc(spark, url, "runs", partition_column="id", bounds=(0, 50), partitions=4, properties=driver)
    assert scan.count() == 50 and scan.rdd.getNumPartitions() == 4
    picked = readers.read_jdbc(spark, url, "(select * from runs where \"passage\" = 3) q", properties=driver)
    assert picked.count() == 10


def test_completeness_and_grid(spark):
    profiles = spark.createDataFrame([(1, True), (2, True), (3, False)], "profile_id int, active boolean")
    runs = spark.createDataFrame([(7, 1, "completed"), (7, 2, "approved"), (8, 1, "completed"), (8, 2, "failed"), (9, 3, "completed")],
                                 "passage_id int, profile_id int, status string")
    got = {r.passage_id: (r.profiles_done, r.complete) for r in packs.completeness(runs, profiles).collect()}
    assert got == {7: (2, True), 8: (1, False), 9: (0, False)}
    grid = planning.profile_grid(spark.range(3), profiles, ["profile_id"])
    assert grid.count() == 9
    assert "Join" not in grid._jdf.queryExecution().optimizedPlan().toString()


def test_latest_metric_run_only(spark):
    runs = spark.createDataFrame([(1, "completed", "lex_a", "2026-01-01", None), (2, "completed", "lex_b", "2026-01-02", "2026-01-03"),
                                  (3, "failed", "lex_c", "2026-02-01", None), (4, "completed", "other", "2026-03-01", None)],
                                 "metric_run_id int, status string, metric_set string, started_at string, completed_at string")
    assert metricstore.latest_metric_run(runs, "lex").first().metric_run_id == 2


def test_declared_schemas_parse(spark):
    for spec in (schemas.RATING_LOG, schemas.INCOMING_SAVE, schemas.MANIFEST, schemas.BENCHMARK_CELLS, schemas.EVENTS):
        assert spark.createDataFrame([], spec).columns


def test_grid_takes_more_profiles_than_one_array(spark, monkeypatch):
    monkeypatch.setattr(planning, "GRID_PROFILE_LIMIT", 4)
    profiles = spark.range(30).select(F.col("id").alias("profile_id"), F.lit("p").alias("name"))
    grid = planning.profile_grid(spark.range(3), profiles, ["profile_id", "name"])
    assert sorted((r.id, r.profile_id, r["name"]) for r in grid.collect()) == [(i, p, "p") for i in range(3) for p in range(30)]
    assert planning.profile_grid(spark.range(3), profiles.limit(0), ["profile_id"]).collect() == []


def test_migration_keeps_every_row_or_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    old = spark.createDataFrame([(i, i % 3, None if i % 4 == 0 else i) for i in range(50)], "id long, reviewer long, rating int")
    assert tables.migrate_append_only(old, path, ["id", "rating"], 1) == 50
    assert sorted(map(tuple, tables.current_version(spark, path).collect())) == [(i, None if i % 4 == 0 else i) for i in range(50)]
    with pytest.raises(tables.CheckFailed, match="exists"):
        tables.migrate_append_only(old, path, ["id"], 1)
    short = {"rows": (F.count(F.lit(1)), 50)}
    with pytest.raises(tables.CheckFailed, match="49, 50"):
        tables.write_checked(old.where("id > 0"), f"{path}/version=2", short)
    assert tables.current_version(spark, path).count() == 50
    assert sorted(p.name for p in (tmp_path / "log").iterdir()) == ["version=1"]
    empty = old.limit(0)
    assert tables.migrate_append_only(empty, str(tmp_path / "none"), ["id", "rating"], 1) == 0


def test_migration_refuses_swapped_keys(spark, tmp_path):
    """As many rows, but not the same keys."""
    old = spark.createDataFrame([(i,) for i in range(20)], "id long")
    digest = F.sum(F.xxhash64("id").cast("decimal(38,0)"))
    expected = {"rows": (F.count(F.lit(1)), 20), "hashes": (digest, old.agg(digest).first()[0])}
    doubled = old.select(F.when(F.col("id") == 7, 8).otherwise(F.col("id")).alias("id"))
    with pytest.raises(tables.CheckFailed):
        tables.write_checked(doubled, str(tmp_path / "bad"), expected)
    assert list(tmp_path.iterdir()) == []


def test_calibration_counts_finished_runs_and_has_defaults(spark):
    schema = "run_id long, request_body string, input_tokens int, status string, completed_at int"
    rows = [(1, "x" * 40, 10, "completed", 1), (2, "x" * 40, 20, "approved", 2), (3, "x" * 40, 900, "failed", 3), (4, None, 5, "completed", 4), (5, "x", 0, "completed", 5)]
    found = planning.token_calibration(spark.createDataFrame(rows, schema)).first()
    assert (found.sample_runs, found.median_factor, found.p90_factor) == (2, 1.5, 2.0)
    none = planning.token_calibration(spark.createDataFrame(rows[2:], schema)).first()
    assert (none.sample_runs, none.median_factor, none.p90_factor) == (0, 1.0, 1.2)


def test_a_body_is_its_frame_and_its_message(spark):
    texts = ["", None, 'a "quoted" \\ line\n\ttab', "λόγος 漢字", "x" * 1000, "\u0001"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, m string")
    model, prompt = F.lit("m"), F.lit('say "it"')
    whole = planning.request_body(model, prompt, F.col("m"))
    parts = F.length(planning.request_body(model, prompt, F.lit(""))) + planning.message_length(F.col("m"))
    for r in df.select("m", whole.alias("body"), parts.alias("parts")).collect():
        assert r.parts == len(r.body)
        body = json.loads(r.body)
        assert body["messages"] == [{"role": "system", "content": 'say "it"'}, {"role": "user", "content": r.m or ""}]
        assert (body["temperature"], body["top_p"]) == (1.0, 1.0)
