"""Log semantics: append-only, latest by id, validation, migration."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from renderscope.operators import exposure, pool, ratings, sampling, timing
from renderscope.sources import tables

SCHEMA = "id long, pack_slug string, passage_id long, variant_id string, reviewer string, rating int"


def log(spark, rows):
    return spark.createDataFrame([(i, "pack", p, v, r, x) for i, p, v, r, x in rows], SCHEMA)


def test_latest_is_highest_id_and_null_supersedes(spark):
    df = log(spark, [(3, 2330, "3302", "a", 9), (1, 2330, "3302", "a", 2), (2, 2330, "3302", "b", 5), (4, 2330, "9999", "a", 3),
                     (5, 2331, "1", "a", 4), (6, 2331, "1", "a", None)])
    got = {(r.reviewer, r.variant_id): r.rating for r in ratings.latest(df).collect()}
    assert got == {("a", "3302"): 9, ("b", "3302"): 5, ("a", "9999"): 3, ("a", "1"): None}
    assert df.count() == 6
    states = [r.state for r in ratings.with_state(df).orderBy("id").collect()]
    assert states == ["superseded", "latest", "latest", "latest", "superseded", "latest"]


def test_first_evaluation_ignores_the_variant(spark):
    df = log(spark, [(2, 7, "x", "a", 1), (1, 7, "y", "a", 8), (3, 8, "x", "a", 5)])
    assert {(r.passage_id, r.rating) for r in ratings.first(df).collect()} == {(7, 8), (8, 5)}
    audit = ratings.revision_audit(df).first()
    assert (audit.raw_save_rows, audit.unique_reviewer_passages, audit.later_revision_rows_excluded) == (3, 2, 1)


def test_validation(spark):
    cases = [
        (1, "4", "{}", None), (2, "", "", None), (3, "11", "{}", "rating"), (4, "-1", "{}", "rating"), (5, "x", "{}", "rating"),
        (6, "5", "not json", "not JSON"), (7, "5", "[1]", "not an object"), (8, "5", "{\"a\": \"" + "x" * 250_001 + "\"}", "too large"),
        (9, None, None, None),
    ]
    df = spark.createDataFrame([(i, 1, r, e) for i, r, e, _ in cases], "id int, passage_id int, rating string, exposure_json string")
    out = {r.id: r for r in ratings.validated(df).collect()}
    for i, _, _, reason in cases:
        assert (out[i].reason is None) if reason is None else (reason in out[i].reason), (i, out[i].reason)
    assert (out[1].rating, out[2].rating, out[2].exposure_json, out[9].exposure_json) == (4, None, "{}", "{}")


def test_exposure_forms(spark):
    texts = [
        (1, '{"captured_at_ms": 1500, "variants": {"a": {"visible_ms": 1200}, "b": {"visible_ms": 0}, "c": {"visible_ms": 34}}}'),
        (2, ""), (3, "broken"), (4, "[1]"), (5, '{"captured_at_ms": 0}'), (6, '{"variants": {}}'),
    ]
    out = {r.id: r for r in exposure.exposure_summary(spark.createDataFrame(texts, "id int, exposure_json string")).collect()}
    assert (out[1].helper_variants_visible, out[1].helper_visible_seconds, out[1].elapsed_seconds, out[1].peak_visible_ms) == (2, 1.234, 1.5, 1200)
    for i in range(2, 7):
        assert (out[i].helper_variants_visible, out[i].helper_visible_seconds, out[i].elapsed_seconds) == (0, 0.0, None)


def test_gaps(spark):
    rows = [(i, "a", t, datetime(2026, 1, 1, 0, 0, s)) for i, t, s in ((1, "assisted", 0), (2, "single", 10), (3, "single", 25))]
    out = timing.save_gaps(spark.createDataFrame(rows, "id long, reviewer string, treatment string, created_at timestamp"))
    assert [(r.seconds_since_previous, r.successive_single_gap) for r in out.orderBy("id").collect()] == [(None, None), (10.0, None), (15.0, 15.0)]


def test_legacy_scale_and_missing_columns(spark):
    old = spark.createDataFrame([(1, -2), (2, 2), (3, 0)], "id int, rating int")
    new = tables.rescaled_log(tables.with_defaults(old, {"notes": "", "exposure_json": "{}"}))
    assert {(r.id, r.rating, r.notes) for r in new.collect()} == {(1, None, ""), (2, 2, ""), (3, 0, "")}


def test_merge_audit(spark):
    focal = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "passage_id long, translation_run_id long")
    own = spark.createDataFrame([(5, 1, "cc-10", 4), (6, 2, "cc-99", 4), (7, 3, "cc-30", 1), (8, 3, "cc-30", 2)], "id long, passage_id long, variant_id string, rating int")
    assert [r.merge_status for r in ratings.merge_audit(focal, own).orderBy("passage_id").collect()] == [
        "ok", "variant mismatch", "duplicate rating", "missing rating"]


def test_preference_order(spark):
    t = datetime(2026, 1, 2), datetime(2026, 1, 1)
    rows = [
        (1, 1, "a", "reviewed", "approved", t[0], t[0]), (2, 1, "b", "final", "approved", None, None),
        (3, 2, "c", "final", "approved", None, t[0]), (4, 2, "d", "final", "approved", t[1], None),
        (5, 3, "e", "final", "approved", t[0], t[0]), (6, 3, "f", "final", "approved", t[0], t[0]),
        (7, 4, "  ", "final", "approved", t[0], t[0]), (8, 5, "g", "draft", "approved", t[0], t[0]),
    ]
    human = spark.createDataFrame(rows, "id long, lemma_id long, translation_text string, stage string, status string, reviewed_at timestamp, updated_at timestamp")
    assert {r.lemma_id: r.translation_text for r in pool.approved_translations(human).collect()} == {1: "b", 2: "d", 3: "f"}


def test_small_pool_fails(spark):
    with pytest.raises(Exception, match="pool is smaller"):
        sampling.require_pool(spark.range(5), 6).collect()
    assert sampling.require_pool(spark.range(5), 5).count() == 5


def test_sampling_is_repeatable_and_split_in_halves(spark):
    df = spark.range(101).withColumn("g", F.lit("x"))
    draw = [r.id for r in sampling.seeded_sample(df, "id", 20, 7).orderBy("selection_rank").collect()]
    again = [r.id for r in sampling.seeded_sample(df.repartition(13), "id", 20, 7).orderBy("selection_rank").collect()]
    assert draw == again and len(set(draw)) == 20
    out = sampling.seeded_assignment(df, ["g"], "id", 3).collect()
    assert sum(r.treatment == "assisted" for r in out) == 50
    assert sorted(r.display_order for r in out) == list(range(1, 102))
