"""Language-model scores of whole texts by context-tree weighting, distributed.

Documents are put down in blocks. A block sends each distinct gram (a byte and
its contexts) and each distinct word once, packed by shard and already counted,
so hot words cost a block one entry. Shards hold whole subtrees: everything
under the two nearest context bytes. They add up the blocks' counts, weight
their trees and pass the sums of the two shallowest levels up: at most 65,280
nodes, the only part that every shard needs. Each block then gets back the
probability of each of its grams and the count of each of its words, and its
documents are scored in one pass beside that table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renderscope.llm import ctw
from renderscope.llm.common import held_out
from renderscope.session import staged

#: Bytes of context.
DEPTH = 5
#: Documents of this fold of five are not learnt from.
HELD_OUT = 1
#: Context bytes that a shard's trees have in common.
SHARED = 2
#: Blocks whose counts one task adds up before they meet.
FAN_IN = 64
#: Bytes of text that are in hand at a time; 256 documents at most, as their number goes into a byte.
BATCH_BYTES = 1 << 20
BATCH_DOCS = 256
#: Blocks are flushed at so many distinct grams, however long their partition is.
BLOCK_GRAMS = 8_000_000

END_WORD = b"\n"


# --- packing -------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Numbers as a compressed block; sorted ones are kept as differences."""
    if values.dtype == np.uint64:
        values = np.diff(values, prepend=np.uint64(0))
    planes = np.frombuffer(values.tobytes(), np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(values.dtype.str.encode().ljust(4) + planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    kind = np.dtype(raw[:4].decode().strip())
    planes = np.frombuffer(raw, np.uint8, offset=4).reshape(kind.itemsize, -1)
    values = np.frombuffer(planes.T.tobytes(), kind)
    return np.cumsum(values, dtype=np.uint64) if kind == np.uint64 else values


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit keys that tell words apart."""
    values = np.empty(len(words), object)
    values[:] = words
    return pd.util.hash_array(values, categorize=False) if len(words) else np.empty(0, np.uint64)


def gram_shard(code: np.ndarray, shards: int) -> np.ndarray:
    near = (code >> np.uint64(8)) & np.uint64((1 << 8 * SHARED) - 1)
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(shards)


def word_shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (key >> np.uint64(32)) % np.uint64(shards)


# --- blocks --------------------------------------------------------------------


class Piece:
    """Up to BATCH_DOCS texts: their grams in order with the text of each, and their words."""

    def __init__(self, texts: list[str | None], depth: int) -> None:
        done = [ctw.canonical(t) for t in texts]
        code, self.n_bytes = ctw.grams([d for d, _ in done], depth)
        doc = np.repeat(np.arange(len(texts), dtype=np.uint64), self.n_bytes)
        both = (code << np.uint64(8)) | doc if depth < 7 else None
        if both is None:
            order = np.argsort(code, kind="stable")
            self.code, self.doc = code[order], doc[order]
        else:
            both.sort()
            self.code, self.doc = both >> np.uint64(8), (both & np.uint64(0xFF)).astype(np.int64)
        self.first = np.flatnonzero(np.concatenate([[True], self.code[1:] != self.code[:-1]]))
        words = [[*w, END_WORD] for _, w in done]
        self.n_tokens = np.fromiter(map(len, words), np.int64, len(words))
        self.word = word_hashes([w for ws in words for w in ws])
        self.word_doc = np.repeat(np.arange(len(words)), self.n_tokens)

    def gram_counts(self, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.code[self.first], np.add.reduceat(learnt[self.doc].astype(np.int64), self.first)

    def word_counts(self, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ctw.summed(self.word, learnt[self.word_doc].astype(np.int64))

    def scores(self, grams: np.ndarray, logs: np.ndarray) -> np.ndarray:
        each = logs[np.searchsorted(grams, self.code[self.first])]
        times = np.diff(np.append(self.first, len(self.code)))
        return np.bincount(self.doc, weights=np.repeat(each, times), minlength=len(self.n_bytes))


def pieces(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[int, list[str | None]]]:
    start, part, size = 0, [], 0
    for i, x in enumerate(batch.column(text_at)):
        part.append(x.as_py())
        size += len(part[-1] or "")
        if size >= BATCH_BYTES or len(part) == BATCH_DOCS or i == batch.num_rows - 1:
            yield start, part
            start, part, size = i + 1, [], 0


REQUEST = "block long, kind string, shard long, keys binary, counts binary"


def requests(blocked: DataFrame, depth: int, shards: int) -> DataFrame:
    """Of each block, packed by shard: distinct grams and words with their counts in documents learnt from."""
    schema = pa.schema(
        [("block", pa.int64()), ("kind", pa.string()), ("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
    )

    def packed(block: int, kind: str, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = ctw.summed(*map(np.concatenate, zip(*parts, strict=True)))
        shard = (gram_shard if kind == "gram" else word_shard)(keys, shards).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        rows = [
            {
                "block": block,
                "kind": kind,
                "shard": int(shard[order[i]]),
                "keys": pack(keys[order[i:j]]),
                "counts": pack(counts[order[i:j]]),
            }
            for i, j in zip(cuts, np.append(cuts[1:], len(order)), strict=True)
        ]
        return pa.RecordBatch.from_pylist(rows, schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, {"gram": [], "word": []}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    yield packed(block, kind, parts)
                parts.clear()

        for batch in batches:
            blocks, learnt = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for start, texts in pieces(batch, 0):
                # A piece may reach over the end of a block; each block takes its own documents.
                own = blocks[start : start + len(texts)]
                cuts = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
                for i, j in zip(cuts, np.append(cuts[1:], len(texts)), strict=True):
                    if block is not None and own[i] != block:
                        yield from flush()
                    block = int(own[i])
                    piece = Piece(texts[i:j], depth)
                    mine = learnt[start + i : start + j]
                    held["gram"].append(piece.gram_counts(mine))
                    held["word"].append(piece.word_counts(mine))
                for kind, parts in held.items():
                    if sum(len(k) for k, _ in parts[1:]) > BLOCK_GRAMS // 2:
                        parts[:] = [ctw.summed(*map(np.concatenate, zip(*parts, strict=True)))]
                        if len(parts[0][0]) > BLOCK_GRAMS:
                            yield packed(block, kind, parts)
                            parts.clear()
        yield from flush()

    return blocked.select("text", "block", "learnt").mapInArrow(gather, REQUEST)


# --- shards --------------------------------------------------------------------


def _merged(parts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = [unpack(x) for x in parts["keys"]]
    return ctw.summed(np.concatenate(keys), np.concatenate([unpack(x) for x in parts["counts"]]))


def shard_counts(asked: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """kind, shard, keys, counts: the blocks' counts added up, first in groups of blocks, then for good."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(part)
        row = {"kind": part["kind"].iloc[0], "shard": part["shard"].iloc[0]}
        return pd.DataFrame([{**row, "keys": pack(keys), "counts": pack(counts)}])

    shape = "kind string, shard long, keys binary, counts binary"
    part = F.floor(F.col("block") / fan_in).alias("part")
    first = asked.groupBy("kind", "shard", part).applyInPandas(lambda key, x: add(x), shape)
    return first.groupBy("kind", "shard").applyInPandas(lambda key, x: add(x), shape)


def shallow_nodes(counted: DataFrame, depth: int) -> DataFrame:
    """node, zeros, ones, below: sums over the shards of what hangs under one context byte."""
    shape = "node long, zeros double, ones double, below double"

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, counts in zip(batch["keys"], batch["counts"], strict=True):
                levels = ctw.trees(unpack(keys), unpack(counts), depth, SHARED)
                node, zeros, ones, below = levels[-1].parents(SHARED)
                yield pd.DataFrame({"node": node.astype(np.int64), "zeros": zeros, "ones": ones, "below": below})

    grams = counted.filter("kind = 'gram'").select("keys", "counts")
    return (
        grams.mapInPandas(nodes, shape)
        .groupBy("node")
        .agg(*[F.sum(F.col(c).cast("decimal(38,9)")).cast("double").alias(c) for c in ("zeros", "ones", "below")])
    )


def answers(asked: DataFrame, counted: DataFrame, shallow: list[ctw.Level], depth: int) -> DataFrame:
    """block, kind, keys, values: log10 probability of each gram, count of each word that a block asked for.

    Each share of a shard's requests meets the shard's counts: packed rows are
    joined, so a shard asked by very many blocks is dealt over many tasks.
    """
    shared = asked.sparkSession.sparkContext.broadcast(shallow)  # 65,535 nodes at most
    schema = pa.schema([("block", pa.int64()), ("kind", pa.string()), ("keys", pa.binary()), ("values", pa.binary())])
    asked = asked.withColumn("part", F.floor(F.col("block") / FAN_IN))
    parts = asked.select("kind", "shard", "part").distinct()
    dealt = parts.join(counted, ["kind", "shard"]).select("kind", "shard", "part", "keys", "counts", F.lit(-1).cast("long").alias("block"))
    rows = (
        asked.select("kind", "shard", "part", "keys", F.lit(None).cast("binary").alias("counts"), "block")
        .union(dealt.select("kind", "shard", "part", "keys", "counts", "block"))
        .repartition("kind", "shard", "part")
        .sortWithinPartitions("kind", "shard", "part", "block")
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = counts = logs = None
        for batch in batches:
            for i in range(batch.num_rows):
                kind, block, data = (batch.column(batch.schema.names.index(n))[i].as_py() for n in ("kind", "block", "keys"))
                if block < 0:  # the shard itself comes before its requests
                    keys, counts = unpack(data), unpack(batch.column(batch.schema.names.index("counts"))[i].as_py())
                    if kind == "gram":
                        levels = ctw.trees(keys, counts, depth, SHARED) + shared.value
                        logs = np.empty(len(keys), np.float64)
                        for k in range(0, len(keys), 1 << 16):
                            p = ctw.predict(keys[k : k + (1 << 16)], levels, depth)
                            logs[k : k + (1 << 16)] = np.log10(p).sum(axis=0)
                    continue
                wanted = unpack(data)
                values = (logs if kind == "gram" else counts)[np.searchsorted(keys, wanted)]
                row = {"block": block, "kind": kind, "keys": data, "values": pack(values)}
                yield pa.RecordBatch.from_pylist([row], schema)

    return rows.mapInArrow(answer, "block long, kind string, keys binary, values binary")


# --- scores --------------------------------------------------------------------


def scored(blocked: DataFrame, answered: DataFrame, blocks: int, totals: tuple[int, int], depth: int) -> DataFrame:
    """Documents beside the table of their block: the table's rows come first, then the block's documents."""
    n, v = totals
    schema = pa.schema(
        [("doc_id", pa.int64()), ("learnt", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())]
    )
    empty = F.lit(None)
    rows = (
        answered.select("block", F.lit(0).alias("turn"), "kind", "keys", "values", empty.cast("long").alias("doc_id"), empty.cast("boolean").alias("learnt"), empty.cast("string").alias("text"))
        .union(blocked.select("block", F.lit(1).alias("turn"), empty.cast("string").alias("kind"), empty.cast("binary").alias("keys"), empty.cast("binary").alias("values"), "doc_id", "learnt", "text"))
        .repartitionById(blocks, F.col("block").cast("int"))  # a task per block
        .sortWithinPartitions("block", "turn")
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, tables = None, {"gram": [], "word": []}, {}

        def table(kind: str) -> tuple[np.ndarray, np.ndarray]:
            parts = waiting[kind]
            if parts:
                keys, values = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(keys, kind="stable")
                tables[kind] = keys[order], values[order]
                parts.clear()
            return tables[kind]

        for batch in batches:
            blocks, turns = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            run = np.flatnonzero(np.diff(blocks * 2 + turns, prepend=blocks[0] * 2 + turns[0] - 1))
            for i, j in zip(run, np.append(run[1:], batch.num_rows), strict=True):
                part = batch.slice(i, j - i)
                if turns[i] == 0:
                    if blocks[i] != block:
                        block, tables = int(blocks[i]), {}
                    for kind, keys, values in zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                        waiting[kind].append((unpack(keys), unpack(values)))
                    continue
                grams, logs = table("gram")
                words, counts = table("word")
                for start, texts in pieces(part, 7):
                    piece = Piece(texts, depth)
                    c = counts[np.searchsorted(words, piece.word)]
                    size = len(texts)
                    base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(5).slice(start, size),
                            part.column(6).slice(start, size),
                            pa.array(piece.n_tokens),
                            pa.array(np.bincount(piece.word_doc, weights=c > 0, minlength=size).astype(np.int64)),
                            pa.array(np.bincount(piece.word_doc, weights=base, minlength=size)),
                            pa.array(piece.scores(grams, logs)),
                            pa.array(piece.n_bytes),
                        ],
                        schema=schema,
                    )

    return rows.mapInArrow(score, "doc_id long, learnt boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")


def language_scores(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Texts are read as their words (A-Z lower-cased) with one space between and
    one end byte; null and empty texts are the end alone. ``score`` is the log10
    probability of those bytes under trees learnt from the documents that are
    not held out, ``base_score`` that of the words under their counts. Without
    any document to learn from every bit has probability one half. Words are
    told apart by 64-bit keys. Repeated rows are documents of their own, a null
    id counts as empty text for the fold; an empty table gives no rows.
    """
    blocked = staged(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(text_col).alias("text"),
            F.spark_partition_id().cast("long").alias("block"),
            (~held_out(F.col(id_col), HELD_OUT)).alias("learnt"),
        )
    )
    shards = 1 + (blocked.agg(F.max("block")).first()[0] or 0)  # as many as blocks
    asked = staged(requests(blocked, depth, shards))
    counted = staged(shard_counts(asked))

    @F.pandas_udf("struct<n:long, v:long>")
    def word_totals(counts: pd.Series) -> pd.DataFrame:
        arrays = [unpack(x) for x in counts]
        return pd.DataFrame({"n": [int(a.sum()) for a in arrays], "v": [int((a > 0).sum()) for a in arrays]})

    words = counted.filter("kind = 'word'").select(word_totals("counts").alias("t"))
    n, v = words.agg(F.coalesce(F.sum("t.n"), F.lit(0)), F.coalesce(F.sum("t.v"), F.lit(0))).first()
    top = shallow_nodes(counted, depth).orderBy("node").toPandas()  # 65,280 rows at most
    level = ctw.Level(top["node"].to_numpy(np.int64).view(np.uint64), *(top[c].to_numpy(np.float64) for c in ("zeros", "ones", "below")))
    shallow = [level]
    for d in range(SHARED - 1, 0, -1):
        shallow.append(ctw.Level(*shallow[-1].parents(d)))
    answered = answers(asked, counted, shallow, depth)
    train_tokens = F.lit(int(n)).cast("long")
    return scored(blocked, answered, shards, (int(n), int(v)), depth).select(
        "doc_id",
        (~F.col("learnt")).alias("held_out"),
        "n_tokens",
        "n_known",
        train_tokens.alias("train_tokens"),
        "base_score",
        "score",
        "n_bytes",
        (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
