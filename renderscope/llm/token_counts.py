"""Token totals for every context limit from one exact histogram of encoded lengths.

Texts are encoded in Arrow batches and only their lengths leave the task. The
histogram has a row per length that occurs; suffix sums over it answer every
limit at once. The sums run in blocks of neighbouring lengths, so no task sees
more than a block or the list of blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: log2 of the lengths in a block.
BLOCK_BITS = 10


def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def token_lengths(
    docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens of every whole text under a byte-level BPE rank file.

    Null and empty texts have 0 tokens. ``ranks`` is the path of the file, read
    once on the driver; ``pattern`` splits text before the merges.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(rank_file(ranks))  # the vocabulary: a fixed size of a few MB

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), n_tokens(F.col(text_col)).alias("n_tokens"))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, docs."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def by_limit(histogram: DataFrame) -> DataFrame:
    """A row for every limit at which an answer changes, that is for every length that occurs.

    context_limit, docs (of that very length), docs_within, docs_over,
    quantile (share of documents within), tokens_within (of those documents),
    tokens_kept (of all documents when cut at the limit), tokens_total. Answers
    between two lengths follow from the lower row: tokens_kept grows by
    docs_over per token of the limit.
    """
    block = F.shiftright("n_tokens", BLOCK_BITS)
    rows = histogram.withColumn("block", block).withColumn("tokens", F.col("docs") * F.col("n_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = (
        rows.groupBy("block")
        .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        .select(
            F.col("block"),
            F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_later"),
            F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_later"),
            F.sum("docs").over(every).alias("docs_total"),
            F.sum("tokens").over(every).alias("tokens_total"),
        )
    )
    above = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.sum("docs").over(above), F.lit(0)) + F.col("docs_later")
    tokens_over = F.coalesce(F.sum("tokens").over(above), F.lit(0)) + F.col("tokens_later")
    return (
        rows.join(blocks, "block")
        .withColumn("docs_over", over)
        .withColumn("tokens_over", tokens_over)
        .select(
            F.col("n_tokens").alias("context_limit"),
            "docs",
            (F.col("docs_total") - F.col("docs_over")).alias("docs_within"),
            "docs_over",
            ((F.col("docs_total") - F.col("docs_over")) / F.col("docs_total")).alias("quantile"),
            (F.col("tokens_total") - F.col("tokens_over")).alias("tokens_within"),
            (F.col("tokens_total") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("tokens_kept"),
            "tokens_total",
        )
    )
