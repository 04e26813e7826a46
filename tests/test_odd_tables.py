"""Queries beside their SQL on tables with word-less, accented and missing texts."""

import glob
import os
import shutil

import duckdb
import pytest
from driver_check import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from renderscope.operators import association
from renderscope.plans.registry import round_as_sql

SOURCE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SOURCE), reason="no test tables")

WORDLESS = [
    "association", "association_p", "avg_ranks", "badness_percentile", "condition_summary", "length_models", "log2_slope",
    "log2_slope_interval", "metric_divergence", "metric_statistics", "order_accuracy", "partial_rank", "partial_rank_p",
    "residual_badness", "residual_composite", "topk_overlap",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Every 50th documents: no words, a dash, accents and letters without an ASCII form."""
    out = str(tmp_path_factory.mktemp("odd"))
    for table in glob.glob(f"{SOURCE}/*.parquet"):
        if not table.endswith("/documents.parquet"):
            shutil.copy(table, out)
    odd = {7: "!!! ...", 19: "—", 23: "Éclair Ångström", 24: "ßig", 25: "ΣΑΣ", 26: "øre", 27: "Zebra", 28: "éclair"}
    text = " ".join(f"WHEN doc_id % 50 = {k} THEN '{v}'" for k, v in odd.items())
    rows = f"SELECT doc_id, CASE {text} ELSE text END AS text, lang, source, n_chars FROM '{SOURCE}/documents.parquet'"
    duckdb.connect().execute(f"COPY ({rows}) TO '{out}/documents.parquet' (FORMAT parquet)")
    return out


@pytest.mark.parametrize("name", [*WORDLESS, "accent_order", "rater_agreement", "released_rows"])
def test_as_sql(spark, folder, name):
    text, ok = compare(spark, duck(folder), folder, name)
    assert ok, text


@pytest.fixture(scope="module")
def empty_texts(tmp_path_factory, folder):
    """Also texts of length 0, texts without a language and missing ones."""
    out = str(tmp_path_factory.mktemp("empty"))
    for table in glob.glob(f"{folder}/*.parquet"):
        if not table.endswith("/documents.parquet"):
            shutil.copy(table, out)
    rows = f"""SELECT doc_id, CASE WHEN doc_id % 50 = 31 THEN '' WHEN doc_id % 50 <> 32 THEN text END AS text,
        CASE WHEN doc_id % 50 <> 33 THEN lang END AS lang, source,
        CASE WHEN doc_id % 50 = 31 THEN 0 WHEN doc_id % 50 <> 32 THEN n_chars END AS n_chars FROM '{folder}/documents.parquet'"""
    duckdb.connect().execute(f"COPY ({rows}) TO '{out}/documents.parquet' (FORMAT parquet)")
    return out


@pytest.mark.parametrize("name", [*WORDLESS, "rank_error", "reviewer_summary", "length_associations", "length_kendall", "timing_length_correlation"])
def test_empty_texts_as_sql(spark, empty_texts, name):
    text, ok = compare(spark, duck(empty_texts), empty_texts, name)
    assert ok, text


def test_two_reviewers_share_passages(spark):
    [row] = entry.queries()["rater_agreement"](spark, SOURCE).collect()
    assert row.n > 3 and row.spearman_rho is not None


def test_rounding_goes_by_the_binary_product(spark):
    value = 1 - 5.0140625
    got = spark.range(1).select(round_as_sql(F.lit(value)).alias("v")).first().v
    assert got == duckdb.execute("SELECT round(?::DOUBLE, 6)", [value]).fetchone()[0] == -4.014062


@pytest.mark.parametrize("tables", ["folder", "empty_texts"])
def test_signal_as_sql(spark, request, tables):
    """Texts without words have no ttr: their ratings count and rank last."""
    path = request.getfixturevalue(tables)
    text, ok = compare(spark, duck(path), path, "reviewer_signal")
    assert ok, text


def test_missing_scores_rank_after_those_that_are_not_numbers(spark):
    scores = [(1, 1.0), (2, float("inf")), (3, float("nan")), (4, None)]
    df = spark.createDataFrame([("a", *row) for row in scores], "g string, rating int, score double")
    assert association.spearman(df, ["g"], "rating", "score", missing=True).first().spearman_rho == pytest.approx(1)
