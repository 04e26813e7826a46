"""Work that grows with the texts is done once a text."""

import hashlib
import itertools
import os
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from renderscope.functions import digests
from renderscope.functions import text as X
from renderscope.operators import association, evidence, exposure, planning, ratings, resampling
from renderscope.session import SPLIT_ROWS_CONF

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_every_character_is_folded(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.range(1, 0x110000).where("id < 55296 or id >= 57344")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "utf-32")
    got = {r.id: r.n for r in rows.select("id", X.nfkc(char).alias("n")).where(F.col("n") != char).collect()}
    assert got == {c: n for c in points if (n := unicodedata.normalize("NFKC", chr(c))) != chr(c)}


def test_apostrophes_become_one(spark):
    assert spark.range(1).select(X.normalized(F.lit("Don’t `X’"))).first()[0] == "don't 'x'"


def test_runs_are_measured_once(spark):
    measured = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def words(body):
        measured.add(1)
        return len(body.split())

    runs = spark.range(200).select(
        F.col("id").alias("run_id"), F.col("id").alias("completed_at"), F.repeat(F.lit("some words "), 5).alias("request_body")
    )
    found = planning.token_calibration(runs.withColumn("input_tokens", words("request_body")), k=100).first()
    assert (found.sample_runs, measured.value) == (100, 200)


@needs_tables
def test_grid_cells_carry_no_text(spark):
    assert "text#" not in plan(entry.queries()["cost_calibrated"](spark, FOLDER))


@needs_tables
def test_counts_are_joined_not_texts(spark):
    assert "text#" not in plan(entry.queries()["token_counts"](spark, FOLDER))


def test_equal_cases_are_enumerated_once(spark):
    """Samples of equal ranks are one case of the enumeration, whatever their number."""
    rows = spark.range(1200).selectExpr("id % 300 AS grp", "id AS row", "id div 300 % 2 * 1.0D AS x", "id div 300 * (1.0D + id % 300) AS y")
    ranked = resampling.doubled_ranks(rows, ["grp"], "row", "x", "y")
    out = resampling._enumerated(ranked, ["grp"], 12, 10_000_000)
    assert "Generate explode" not in plan(out)
    assert {(r.n, r.orderings, round(r.p_one_sided, 9), round(r.p_two_sided, 9)) for r in out.collect()} == {(4, 6, round(2 / 6, 9), round(4 / 6, 9))}
    assert out.count() == 300


def test_a_log_is_spread_before_it_is_combined(spark):
    """However many rows a file's task reads, it combines a share of them, and only the columns that are asked for."""
    log = spark.range(0, 1000, 1, 1).selectExpr(
        "id", "'p' AS pack_slug", "id % 7 AS passage_id", "'v' AS variant_id", "'r' AS reviewer", "CAST(id % 10 AS int) AS rating",
        "CAST(id AS string) AS note",
    )
    found = ratings.latest(log).select("passage_id", "rating")
    steps = found._jdf.queryExecution().executedPlan().toString()
    assert "note" not in steps and "SortAggregate" not in steps
    assert steps.count("Exchange hashpartitioning(id") == 1 and steps.index("partial_max_by") < steps.index("Exchange hashpartitioning(id")
    assert {(r.passage_id, r.rating) for r in found.collect()} == {(i % 7, i % 10) for i in range(993, 1000)}


def test_large_rank_tables_are_not_broadcast(spark):
    rows = spark.range(60_000).selectExpr("CAST(id % 20000 AS string) AS g", "id * 7 % 60000 AS x", "id * 11 % 60000 AS y")
    steps = association.spearman(rows, ["g"], "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in steps and steps.count("SortMergeJoin") == 2
    steps = association.spearman(rows.where("x < 600"), ["g"], "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in steps


@needs_tables
def test_traces_are_parsed_once(spark, monkeypatch):
    parsed, plain = spark.sparkContext.accumulator(0), exposure.parsed

    @F.udf("string")
    def counted(raw):
        parsed.add(1)
        return raw

    monkeypatch.setattr(exposure, "parsed", lambda raw: plain(counted(raw)))
    assert entry.queries()["timing_length_correlation"](spark, FOLDER).count() > 0
    firsts = entry.queries()["ratings_first"](spark, FOLDER).count()
    assert parsed.value == firsts


def test_a_cell_joins_a_node_per_base_4_digit(spark, monkeypatch):
    nodes, plain = [], association.running_totals
    monkeypatch.setattr(association, "running_totals", lambda df, *rest: nodes.append(df.count()) or plain(df, *rest))
    rows = spark.range(4096).selectExpr("1 AS g", "id AS x", "id * 1365 % 4096 AS y")
    found = association.order_accuracy(rows, ["g"], "x", "y").first()
    y = [i * 1365 % 4096 for i in range(4096)]
    assert found.correct == sum(sum(v < w for v in y[:i]) for i, w in enumerate(y))
    assert nodes == [4096 * 6]


@needs_tables
def test_no_pair_is_ordered_without_kendall(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(association, "running_totals", lambda *args: asked.append(args))
    monkeypatch.setattr(association, "pair_order", lambda *args: asked.append(args))
    assert entry.queries()["length_associations"](spark, FOLDER).count() == 8 and not asked


@needs_tables
def test_ratings_are_joined_once(spark):
    """Rows that are ranked and then given their rank are on disk, not found twice."""
    assert "events.parquet" not in str(entry.queries()["rank_error"](spark, FOLDER).inputFiles())


def test_digests_are_those_of_hashlib():
    for first, last in ((1, 120), (95, 1003), (32_769, 33_000)):
        slots = digests.SlotDigests(first, last)
        for heads in ([b"20260720:1:purchase:"], [b"7:10:\xc3\xa9:", b"7:11:\xc3\xa9:"], [b"", ], [b"x" * 49], [b"y" * 60, b"z" * 60]):
            want = [[int(hashlib.md5(h + b"%d" % s).hexdigest()[:15], 16) for s in range(first, last + 1)] for h in heads]
            assert slots.keys(heads).tolist() == want


def test_picks_are_no_calls_of_a_row(monkeypatch):
    """A resample of 2,000 rows asks for no digest of its own."""
    monkeypatch.setattr(digests, "hashlib", None)
    monkeypatch.setattr(resampling, "hashlib", None)
    x = np.arange(2000.0)
    row = {"group_key": "g", "n": 2000, "x": x.tobytes(), "y": (x % 7).tobytes(), "seed": 3, "first": 8, "last": 12, "each": 1000}
    [out] = resampling._resampled_rho([pd.DataFrame([row])])
    assert out.draw.tolist() == [8, 9, 10, 11, 12] and out.rho.abs().max() < 0.1


def test_arrays_travel_as_often_as_tasks_need_them(spark):
    """A large group is streamed, not collected as objects of a row, and goes to a few blocks of each task."""
    rows = spark.range(30_000).selectExpr("'g' AS g", "id", "id % 11 AS x", "id * 7919 % 101 AS y")
    steps = plan(resampling.bootstrap_spearman_ci(rows, ["g"], "id", "x", "y", draws=40))
    assert "collect_list" not in steps
    named = rows.selectExpr("g AS group_key", "id AS row", "x", "y")
    [held] = resampling.gathered(named, ["x", "y"], "double").collect()
    assert held.n == 30_000 and np.frombuffer(held.y, np.float64).tolist() == [i * 7919 % 101 for i in range(30_000)]
    blocks = resampling.draw_blocks(spark.createDataFrame([("g", 460_000), ("h", 460_000)], "group_key string, n long"), 20_000)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert blocks.count() <= resampling.BLOCKS_PER_TASK * width + 2
    assert {r["sum(each)"] for r in blocks.groupBy("group_key").agg(F.expr("sum(last - first + 1) AS `sum(each)`")).collect()} == {20_000}


def test_dealt_draws_are_uniform_permutations():
    """Sums of a small case as often as its 720 orderings have them, whatever the width of the keys."""
    x, y = np.array([1, 1, 4, 4, 4, 7]), np.array([0, 2, 3, 5, 5, 9])
    bounds = np.flatnonzero(x[1:] != x[:-1]) + 1
    law = Counter(int(x @ np.array(p)) for p in itertools.permutations(y))
    for bits in (1, 3, 8):
        rng = np.random.Generator(np.random.SFC64(bits))
        found = Counter(resampling._dealt_sum(rng, x, bounds, y, y + float(1 << 40), bits) for _ in range(20_000))
        assert set(found) <= set(law)
        assert sum((found[s] - w / 720 * 20_000) ** 2 / (w / 720 * 20_000) for s, w in law.items()) < 50  # 19 degrees of freedom


def test_large_groups_are_dealt_not_shuffled():
    """A side of few values needs only the rows around a change of value in order; the law's mean and spread stay."""
    class Counted(np.random.Generator):
        def permuted(self, *_, **__):
            raise AssertionError("every value shuffled")

        permutation = permuted

    x, y = np.arange(30_000) * 7919 % 30_000, np.arange(30_000) % 11
    sums = resampling._permuted(Counted(np.random.SFC64(5)), x, y, 400)
    n, centre = len(x), x.sum() * y.mean()
    spread = np.sqrt(x.var() * y.var() * n * n / (n - 1))
    assert abs(sums.mean() - centre) < 4 * spread / 20 and 0.85 < sums.std() / spread < 1.15


def test_a_reviewers_measures_are_ranked_in_one_task(spark, monkeypatch):
    """No row per measure is written or sent; a key that no task can order has the same figures by ranges."""
    scores = [(None if i % 9 == 0 else i % 4, float("nan") if i % 11 == 0 else None if i % 5 == 0 else i * 7 % 13 / 1.0) for i in range(1, 60)]
    rows = spark.createDataFrame([(f"r{i % 3}", r, i, s, float(i)) for i, (r, s) in enumerate(scores)], "k string, rating int, words int, a double, b double")

    def found(missing):
        out = evidence.reviewer_signal(rows, ["k"], "rating", "words", ["a", "b"], missing=missing)
        return [[v if isinstance(v, str) else pytest.approx(v, rel=1e-9) for v in row] for row in sorted(out.collect())]

    for missing in (False, True):
        spark.conf.set(SPLIT_ROWS_CONF, "0")
        try:
            by_ranges = found(missing)
        finally:
            spark.conf.unset(SPLIT_ROWS_CONF)
        with monkeypatch.context() as patched:
            patched.setattr(evidence, "_long_signs", None)
            out = evidence.reviewer_signal(rows, ["k"], "rating", "words", ["a", "b"], missing=missing)
            assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
            assert [list(row) for row in sorted(out.collect())] == by_ranges


def test_small_samples_are_tested_in_one_task(spark, monkeypatch):
    """A small sample is sent once and goes through no rank table; by ranges it has the same figures."""
    rows = [(f"s{i % 23}", "m", i, i * 5 % 4, float("nan") if i % 41 == 0 else i * 7 % 5 / 2) for i in range(160)]
    rows += [("t", "m", i, i % 3, None if i == 2 else 1.0) for i in range(4)] + [("u", "m", 0, 1, 1.0)]
    rows += [("v", "m", i, i * 7 % 11, i * 5 % 13 / 1.0) for i in range(14)]  # above the size that is held
    long = spark.createDataFrame(rows, "g string, metric string, id long, rating int, score double")

    def found():
        return sorted([tuple(r) for r in evidence.metric_tests(long, ["g"], "id", "rating", draws=99).collect()], key=lambda r: r[0])

    held = found()
    with monkeypatch.context() as patched:
        patched.setattr(evidence, "_always_exact", lambda **_: 1)
        for a, b in zip(held, found(), strict=True):
            for v, w in zip(a, b, strict=True):
                assert v == (pytest.approx(w, rel=1e-9, nan_ok=True) if isinstance(w, float) else w), (a, b)
    with monkeypatch.context() as patched:
        patched.setattr(evidence, "_large_tests", None)
        patched.setattr(association, "value_cells", None)
        few = evidence.metric_tests(long.where("g <> 'v'"), ["g"], "id", "rating")
        assert few.count() == 25
