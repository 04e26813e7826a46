"""Exact deduplication through an extendible-hash index on shared files.

Texts are inserted once: equal bytes under one key become one index entry
(map-side combining first, so a hot text shrinks before it moves). The
directory starts as one bucket; wherever a bucket holds more entries than fit,
it doubles and the bucket splits by one more bit of the key. Buckets are key
ranges; each owner task gets a run of whole buckets, chains the entries that
collide on a key and writes them to the shared folder in key order. Lookups
then carry keys and digests only, never texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renderscope.llm.common import ascii_lower, only_ids, whole_text
from renderscope.session import staged

#: Entries of a bucket: about 100 bytes each, so a bucket is a few MB.
BUCKET_ENTRIES = 50_000


@dataclass
class HashIndex:
    """``directory``: cell, bucket, depth; ``entries``: one row per distinct text."""

    directory: DataFrame
    entries: DataFrame
    global_depth: int


def _keyed(docs: DataFrame, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    norm = ascii_lower(whole_text(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    key = F.xxhash64("norm")
    if key_bits < 64:
        low = F.shiftrightunsigned(key, 64 - key_bits)
        key = F.shiftleft(low, 64 - key_bits)
    return rows.withColumn("key", key)


def _cell(depth: int) -> Column:
    """The leading ``depth`` bits of the key, in the order of signed keys."""
    if depth == 0:
        return F.lit(0).cast("long")
    flipped = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    return F.shiftrightunsigned(flipped, 64 - depth)


def directory_of(entries: DataFrame, total: int, bucket_entries: int) -> tuple[DataFrame, int]:
    """Directory cells with the bucket each one points to.

    A bucket is a key prefix that fits while its parent, one bit shorter, does
    not. Three bits beyond the even share leave room for uneven keys; keys that
    no further bit can part stay together as a long chain.
    """
    deepest = max(0, math.ceil(math.log2(max(total, 1) / bucket_entries)) + 3) if total > bucket_entries else 0
    cells = entries.groupBy(_cell(deepest).alias("cell")).agg(F.count("*").alias("held"))
    prefixes = (
        cells.select("cell", "held", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth"))
        .select("depth", F.expr(f"shiftrightunsigned(cell, {deepest} - depth)").alias("prefix"), "held")
        .groupBy("depth", "prefix")
        .agg(F.sum("held").alias("held"))
    )
    parents = prefixes.select(
        (F.col("depth") + 1).alias("depth"),
        F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"),
        F.col("held").alias("parent_held"),
    )
    fits = (F.col("held") <= bucket_entries) | (F.col("depth") == deepest)
    buckets = (
        prefixes.filter(fits)
        .join(parents, ["depth", "prefix"], "left")
        .filter((F.col("depth") == 0) | (F.col("parent_held") > bucket_entries))
    )
    first = F.expr(f"shiftleft(prefix, {deepest} - depth)")
    width = F.expr(f"shiftleft(1L, {deepest} - depth)")
    directory = buckets.select(
        F.explode(F.sequence(first, first + width - 1)).alias("cell"), first.alias("bucket"), "depth"
    )
    return staged(directory), deepest


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_entries: int = BUCKET_ENTRIES,
    key_bits: int = 64,
) -> HashIndex:
    """Insert every whole text. ``key_bits`` under 64 makes keys collide, for tests."""
    entries = staged(
        _keyed(docs, id_col, text_col, key_bits)
        .groupBy("key", "norm")  # bytes are compared here, key by key
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    directory, depth = directory_of(entries, entries.count(), bucket_entries)
    chain = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    owned = (
        entries.withColumn("cell", _cell(depth))
        .join(directory, "cell")
        .repartitionByRange("bucket", "key")
        .withColumn("chain_at", F.row_number().over(chain))
        .select("bucket", "depth", "key", "chain_at", "text_sha256", "keep_id", "group_size")
    )
    return HashIndex(directory, staged(owned), depth)


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_entries: int = BUCKET_ENTRIES,
    key_bits: int = 64,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain_at.

    Texts are equal when identical after lower-casing A-Z; the largest id of a
    group stays. Null texts count as empty, so all of them form one group.
    Rows that repeat an id share its verdict. A null id loses to any other; a
    group of null ids only has a null keep_id and stays. Empty input gives an
    empty result; other columns of the input are not looked at.
    """
    index = build_index(docs, id_col, text_col, bucket_entries, key_bits)
    probes = _keyed(docs, id_col, text_col, key_bits).select(
        "doc_id", "key", F.sha2("norm", 256).alias("text_sha256")
    )
    return probes.join(index.entries, ["key", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "bucket",
        "chain_at",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents, with all their columns, whose row stays."""
    kept = duplicate_groups(docs, id_col, text_col).filter("kept").withColumnRenamed("doc_id", id_col)
    return only_ids(docs, kept, id_col)
