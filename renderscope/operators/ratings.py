"""The append-only rating log: current, first and revised judgements, and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATING_KEY = ("pack_slug", "passage_id", "variant_id", "reviewer")
EVALUATION_KEY = ("reviewer", "passage_id")
SECOND_CORPUS_MIN = 900_000  # fixed value: web ids from here on belong to the second corpus
MAX_EXPOSURE_BYTES = 250_000  # fixed value
VARIANT_PREFIX = "cc-"  # fixed value


def _edge_row(df: DataFrame, key: Sequence[str], edge, order: str) -> DataFrame:
    """Rows are spread by ``order`` first, as a task combines all it reads: a file's row group may hold millions.

    Columns are picked one by one, so that those nobody reads are left out.
    """
    rest = [c for c in df.columns if c not in key]
    picked = df.repartition(order).groupBy(*key).agg(*[edge(c, order).alias(c) for c in rest])
    return picked.select(*df.columns)


def latest(df: DataFrame, key: Sequence[str] = RATING_KEY, order: str = "id") -> DataFrame:
    """Row with the highest id per key, combined on the map side."""
    return _edge_row(df, key, F.max_by, order)


def first(df: DataFrame, key: Sequence[str] = EVALUATION_KEY, order: str = "id") -> DataFrame:
    """Row with the lowest id per key."""
    return _edge_row(df, key, F.min_by, order)


def with_state(df: DataFrame, key: Sequence[str] = RATING_KEY) -> DataFrame:
    """Label every row latest or superseded."""
    newest = df.groupBy(*key).agg(F.max("id").alias("_newest"))
    return df.join(newest, list(key)).withColumn(
        "state", F.when(F.col("id") == F.col("_newest"), "latest").otherwise("superseded")
    ).drop("_newest")


def with_corpus(df: DataFrame, passage: str = "passage_id") -> DataFrame:
    """Route by id range."""
    return df.withColumn(
        "corpus", F.when(F.col(passage) >= SECOND_CORPUS_MIN, "second").otherwise("first")
    )


def revision_audit(df: DataFrame, by: Sequence[str] = ("reviewer",)) -> DataFrame:
    """Saves, distinct evaluations and later revisions per group."""
    evaluations = df.groupBy(*by, *[k for k in EVALUATION_KEY if k not in by]).agg(
        F.count(F.lit(1)).alias("_saves")
    )
    return evaluations.groupBy(*by).agg(
        F.sum("_saves").alias("raw_save_rows"),
        F.count(F.lit(1)).alias("unique_reviewer_passages"),
        (F.sum("_saves") - F.count(F.lit(1))).alias("later_revision_rows_excluded"),
    )


def reviewer_status(df: DataFrame, by: Sequence[str] = ("reviewer",), passage: str = "passage_id") -> DataFrame:
    """Activity per reviewer.

    Counts are folded per (reviewer, passage) first: the distinct count then
    costs no second copy of the rows, and a busy reviewer is spread by passage.
    """
    per_passage = df.groupBy(*by, passage).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("rating") >= 7).alias("_high"),
        F.count_if(F.col("rating") <= 3).alias("_low"),
        F.max("updated_at").alias("_updated"),
    )
    return per_passage.groupBy(*by).agg(
        F.sum("_rows").alias("transaction_count"),
        F.count(passage).alias("passage_count"),
        F.sum("_high").alias("high_difference_count"),
        F.sum("_low").alias("low_difference_count"),
        F.max("_updated").alias("updated_at"),
    )


def recent(df: DataFrame, k: int = 80) -> DataFrame:
    """The newest saves; the limit is the report's length."""
    return df.orderBy(F.desc("updated_at"), F.desc("id")).limit(k)


def valid_json_object(raw: Column) -> Column:
    return F.try_parse_json(raw).isNotNull() & F.ltrim(raw).startswith("{")


def validated(df: DataFrame, rating: str = "rating", exposure: str = "exposure_json") -> DataFrame:
    """Parse incoming saves and say what is wrong with them.

    Adds ``reason`` (NULL for a good row), the typed rating and the exposure
    with blanks as an empty object.
    """
    raw = F.trim(F.col(rating).cast("string"))
    text = F.trim(F.coalesce(F.col(exposure), F.lit("")))
    number = raw.try_cast("int")
    blank = raw.isNull() | (raw == "")
    reason = (
        F.when(~blank & (number.isNull() | ~number.between(0, 10)), "rating must be between 0 and 10")
        .when(F.octet_length(text) > MAX_EXPOSURE_BYTES, "exposure too large")
        .when((text != "") & F.try_parse_json(text).isNull(), "exposure is not JSON")
        .when((text != "") & ~valid_json_object(text), "exposure is not an object")
        .when(F.col("passage_id").try_cast("int").isNull(), "passage id missing")
    )
    return (
        df.withColumn("reason", reason)
        .withColumn(rating, F.when(blank, None).otherwise(number))
        .withColumn(exposure, F.when(text == "", "{}").otherwise(text))
    )


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reason").isNull()).drop("reason")


def quarantined(df: DataFrame) -> DataFrame:
    return df.where(F.col("reason").isNotNull())


def released_rows(df: DataFrame) -> DataFrame:
    """Typed release rows: 0/1 to boolean, blanks to NULL, exposure parsed."""
    return df.select(
        F.col("id").cast("long"),
        "pack_slug",
        F.col("passage_id").cast("long"),
        "variant_id",
        "reviewer",
        F.nullif(F.col("rating").cast("string"), F.lit("")).cast("int").alias("rating"),
        F.col("most_trusted").cast("int").cast("boolean").alias("most_trusted"),
        F.col("least_trusted").cast("int").cast("boolean").alias("least_trusted"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        F.parse_json(F.coalesce(F.nullif(F.col("exposure_json"), F.lit("")), F.lit("{}"))).alias("exposure"),
        "created_at",
        "updated_at",
    )


def release_checks(
    df: DataFrame,
    reviewers: Sequence[str],
    expected_rows: int | None = None,
    rows_per_reviewer: int | None = None,
) -> DataFrame:
    """One row of expectations on a release, from one pass.

    The reviewers must be exactly the given ones, each with ``rows_per_reviewer``
    rows where that is given.
    """
    own = [F.count_if(F.col("reviewer") == r) for r in reviewers]
    short = [(c == 0 if rows_per_reviewer is None else c != rows_per_reviewer).cast("int") for c in own]
    checks = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(~F.col("reviewer").isin(*reviewers) | F.col("reviewer").isNull()).alias("unexpected_reviewer_rows"),
        sum((c == 0).cast("int") for c in own).alias("missing_reviewers"),
        sum(short).alias("incomplete_reviewers"),
        F.count_if(F.trim("notes") != "").alias("rows_with_notes"),
        F.count_if(~F.col("rating").between(0, 10)).alias("ratings_out_of_domain"),
        F.max("updated_at").alias("as_of"),
    )
    expected = F.lit(True) if expected_rows is None else F.col("row_count") == expected_rows
    return checks.withColumn(
        "passed",
        expected
        & (F.col("unexpected_reviewer_rows") == 0)
        & (F.col("incomplete_reviewers") == 0)
        & (F.col("rows_with_notes") == 0)
        & (F.col("ratings_out_of_domain") == 0),
    )


def rating_matrix(df: DataFrame, row: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """One column per given reviewer (or variant) with its latest rating."""
    cell = {v: F.max_by(F.col("rating"), F.when(F.col(column) == v, F.col("id"))) for v in values}
    return df.groupBy(*row).agg(*[c.alias(v) for v, c in cell.items()])


def in_domain(rating: Column) -> Column:
    """Out-of-scale ratings become NULL."""
    return F.when(rating.between(0, 10), rating)


def run_id_of(variant: Column) -> Column:
    return F.regexp_replace(variant, f"^{VARIANT_PREFIX}", "").try_cast("long")


def variant_of(run_id: Column) -> Column:
    return F.concat(F.lit(VARIANT_PREFIX), run_id.cast("string"))


def merge_audit(focal: DataFrame, ratings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Join each focal translation to its rating and state any broken expectation.

    ``by`` names further columns that both have, such as the reviewer who was asked.
    """
    per_passage = ratings.groupBy("passage_id", *by).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max_by(F.struct("id", "rating", "variant_id"), "id").alias("_r"),
    )
    status = (
        F.when(F.col("_rows").isNull(), "missing rating")
        .when(F.col("_rows") > 1, "duplicate rating")
        .when(F.col("_r.variant_id") != variant_of(F.col("translation_run_id")), "variant mismatch")
        .otherwise("ok")
    )
    return focal.join(per_passage, ["passage_id", *by], "left").select(
        *focal.columns,
        F.col("_r.id").alias("rating_id"),
        F.col("_r.rating").alias("rating"),
        status.alias("merge_status"),
    )


def pack_filter(df: DataFrame, pack: str, *, exclude_prefix: str | None = None) -> DataFrame:
    rows = df.where(F.col("pack_slug") == pack)
    return rows if exclude_prefix is None else rows.where(~F.col("variant_id").startswith(exclude_prefix))


def tier_lookup(column: Column, table: Mapping[str, object], default: object) -> Column:
    """A short fixed mapping as a CASE expression."""
    out = None
    for key, value in table.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return F.lit(default) if out is None else out.otherwise(default)
