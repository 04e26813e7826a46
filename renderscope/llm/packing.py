"""Packing of documents into sequences of a fixed capacity, through the configuration linear program.

Only the histogram of piece lengths is optimised: at most one entry per token of
the capacity, however many documents there are. A configuration is a multiset of
lengths that fits a sequence; the program covers the histogram with as few
configurations as it can. Multiplicative weights solve it: a length's price falls
with the share of its pieces that are covered, the configuration of greatest
price comes from a knapsack by dynamic programming over the capacity, and it is
taken until a part of its scarcest length is covered. Prices scaled by that
knapsack bound the number of sequences from below, which tells how good the
result is.

Rounding takes whole configurations first. What is left, at most a few pieces
for each configuration, is packed sequence by sequence: the longest piece left,
then the pieces that fill the rest best (bounded subset sums).

The plan is a small table of slots. Pieces are numbered within their length, and
the number says configuration, sequence and offset.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renderscope.functions.hashing import seeded_key
from renderscope.llm.shingles import text_runs
from renderscope.session import staged

CAPACITY = 2048
#: Id after every document.
END = 0
#: The string that the tokenizer takes as one token wherever it occurs, and its id.
SPECIAL = {"<|endoftext|>": 50256}
#: How fast prices fall as a length gets covered.
RATE = 0.05
#: Configurations taken at one set of prices.
TAKEN = 24
#: Runs of the program: how much first prices lean to long pieces, the part of a configuration's scarcest length
#: that one step covers, how near a configuration must be to the best one. The best run counts.
RUNS = ((1.0, 0.5, 0.98), (1.05, 1.0, 0.9995), (1.2, 1.0, 0.9995))
#: Pieces of one length that a task numbers at a time.
RANK_ROWS = 4096


# --- pieces --------------------------------------------------------------------


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """start and length of the pieces of a document; only the first may be shorter than the capacity."""
    head = length % capacity
    bounds = [0] * (head > 0) + list(range(head, length + 1, capacity))
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def pieces(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    capacity: int = CAPACITY,
    end: int = END,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces; with ``with_ids`` also ids.

    A document is the ids of its whole text and one ``end``. Null and empty texts
    are that one id. ``ranks`` is the path of a byte-level BPE rank file, read once
    on the driver, ``pattern`` splits text before the merges; ids are those of the
    tokenizer file of the same vocabulary, its special token included.
    """
    spark: SparkSession = docs.sparkSession
    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    shared = spark.sparkContext.broadcast(table)  # the vocabulary: a fixed size of a few MB
    fields = [(n, pa.int64()) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
    schema = pa.schema([*fields, *[("ids", pa.list_(pa.int64()))] * with_ids])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens=SPECIAL)
        for batch in batches:
            for at, texts in text_runs(batch, 1):
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts, strict=True):
                    ids = encoding.encode_to_numpy(text or "", allowed_special="all")
                    ids = np.append(ids, end).astype("<u4")
                    for i, (start, length) in enumerate(cuts(len(ids), capacity)):
                        own = ids[start : start + length]
                        row = doc, i, start, length, zlib.crc32(own.tobytes())
                        rows.append((*row, own.astype(np.int64)) if with_ids else row)
                columns = zip(*rows, strict=True)
                arrays = [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    result = "doc_id long, piece long, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, result)


# --- the program ---------------------------------------------------------------


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: greatest price of lengths that fit c; last[c]: a length of it, 0 if none.

    ``prices[s]`` is the price of length s (0: none are left). Lengths may repeat.
    """
    capacity = len(prices) - 1
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    priced = np.flatnonzero(prices > 0)
    if not len(priced):
        return best, last
    shortest = priced[0]
    for c in range(shortest, capacity + 1):
        worth = prices[c : shortest - 1 : -1] + best[: c - shortest + 1]  # longest first
        at = int(worth.argmax())
        if worth[at] > best[c - 1]:
            best[c], last[c] = worth[at], c - at
        else:
            best[c] = best[c - 1]
    return best, last


def _traced(last: np.ndarray, c: int, first: int) -> dict[int, int]:
    config: dict[int, int] = {first: 1} if first else {}
    while c > 0:
        if last[c]:
            config[int(last[c])] = config.get(int(last[c]), 0) + 1
            c -= int(last[c])
        else:
            c -= 1
    return config


@dataclass
class Plan:
    """Whole configurations with their numbers, and a lower bound on how many sequences any packing needs."""

    configs: list[tuple[dict[int, int], int]]
    least: float


def fractional(counts: np.ndarray, lean: float, part: float, near: float) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations with fractional numbers that cover ``counts`` (by length), and the dual bound."""
    capacity = len(counts) - 1
    size = np.arange(capacity + 1)
    covered = np.zeros(capacity + 1)
    taken: dict[tuple, float] = {}
    least = 0.0
    open_ = counts > 0
    while open_.any():
        share = np.divide(covered, counts, out=np.zeros(capacity + 1), where=counts > 0)
        prices = np.where(open_, (size / capacity) ** lean * np.exp(-RATE * share), 0.0)
        best, last = knapsack(prices)
        least = max(least, float(prices @ counts) / best[capacity])
        # Best configurations that hold a certain length, for lengths of several kinds.
        held = prices + best[capacity - size]
        held[~open_] = 0
        firsts = size[::-1][np.argsort(-held[::-1], kind="stable")[:TAKEN]]
        for first in firsts.tolist():
            if held[first] < near * best[capacity]:
                break
            config = _traced(last, capacity - first, first)
            if not all(open_[s] for s in config):
                continue
            step = min(max(part * counts[s], 1.0) / a for s, a in config.items())
            step = min(step, max((counts[s] - covered[s]) / a for s, a in config.items()))
            key = tuple(sorted(config.items(), reverse=True))
            taken[key] = taken.get(key, 0.0) + step
            for s, a in config.items():
                covered[s] += a * step
                open_[s] = counts[s] - covered[s] > 1e-9
    return [(dict(k), x) for k, x in taken.items()], least


def filled(left: np.ndarray, room: int) -> dict[int, int]:
    """Lengths of ``left`` (numbers by length) that fill ``room`` best, longer ones first among equals."""
    most = min(room, len(left) - 1)
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    steps = []  # (length, copies, sums reached before)
    for s in np.flatnonzero(left[: most + 1])[::-1].tolist():
        copies, power = min(int(left[s]), room // s), 1
        while copies:
            n = min(power, copies)
            copies, power = copies - n, power * 2
            steps.append((s, n, reach))
            reach = reach.copy()
            reach[s * n :] |= steps[-1][2][: room + 1 - s * n]
        if reach[room]:
            break
    total = int(np.flatnonzero(reach)[-1])
    chosen: dict[int, int] = {}
    for s, n, before in reversed(steps):
        if not before[total]:
            chosen[s] = chosen.get(s, 0) + n
            total -= s * n
    return chosen


def configurations(lengths: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Whole configurations that use up ``lengths`` (numbers by length) exactly: the best of RUNS."""
    counts = np.zeros(capacity + 1)
    for s, n in lengths.items():
        counts[s] = n
    plans = [_rounded(counts, *fractional(counts, *run)) for run in RUNS]
    best = min(plans, key=lambda p: sum(n for _, n in p.configs))
    return Plan(best.configs, max(p.least for p in plans))


def _rounded(counts: np.ndarray, solution: list[tuple[dict[int, int], float]], least: float) -> Plan:
    capacity = len(counts) - 1
    left = counts.astype(np.int64)
    plan: list[tuple[dict[int, int], int]] = []
    waste = {id(c): capacity - sum(s * a for s, a in c.items()) for c, _ in solution}
    for config, x in sorted(solution, key=lambda cx: (waste[id(cx[0])], -cx[1])):
        n = min(int(x + 1e-9), *(int(left[s]) // a for s, a in config.items()))
        if n:
            plan.append((config, n))
            for s, a in config.items():
                left[s] -= a * n
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        config = filled(left, capacity - longest)
        left[longest] += 1
        config[longest] = config.get(longest, 0) + 1
        n = min(int(left[s]) // a for s, a in config.items())
        plan.append((config, n))
        for s, a in config.items():
            left[s] -= a * n
    return Plan(plan, least)


def slots(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """length, first number, end number, pieces a sequence, first sequence, offset: where pieces of a length go."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for config, n in plan.configs:
        offset = 0
        for s, a in sorted(config.items(), reverse=True):
            first = given.get(s, 0)
            rows.append((s, first, first + a * n, a, sequence, offset))
            given[s] = first + a * n
            offset += s * a
        sequence += n
    return rows


# --- placing -------------------------------------------------------------------


def packed(cut: DataFrame, capacity: int = CAPACITY, seed: int = 12) -> DataFrame:
    """``cut`` (of ``pieces``) with sequence_id and offset, gapless from 0 within each sequence.

    Every row is placed, repeated ids included. An empty table gives no rows.
    The histogram (at most ``capacity`` rows) goes to the driver and the slots,
    whose number depends on the histogram's lengths and not on its counts, come
    back as a broadcast table.
    """
    spark = cut.sparkSession
    turn = seeded_key(seed, *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "piece", "ids_crc32")])
    cells = cut.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in cells.collect()}  # a row per length up to the capacity
    plan = configurations(histogram, capacity)
    names = ["s_length", "s_first", "s_end", "a", "s_sequence", "s_offset"]
    table = spark.createDataFrame(slots(plan), ", ".join(f"{n} long" for n in names))
    shares = spark.createDataFrame(
        [(s, -(-n // RANK_ROWS)) for s, n in histogram.items()], "h_length long, h_shares long"
    )
    # Number the pieces of a length: shares of a hot one are numbered apart and start where the ones before end.
    rows = cut.join(F.broadcast(shares), F.col("length") == F.col("h_length")).withColumn("turn", turn)
    rows = rows.withColumn("share", F.col("turn") % F.col("h_shares")).drop("h_length", "h_shares")
    earlier = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        rows.groupBy("length", "share")
        .agg(F.count("*").alias("held"))
        .select(
            F.col("length").alias("a_length"),
            F.col("share").alias("a_share"),
            F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("ahead"),
        )
    )
    within = Window.partitionBy("length", "share").orderBy("turn", "doc_id", "piece", "ids_crc32")
    numbered = (
        rows.withColumn("at", F.row_number().over(within) - 1)
        .join(ahead, (F.col("length") == F.col("a_length")) & (F.col("share") == F.col("a_share")))
        .withColumn("number", F.col("at") + F.col("ahead"))
        .drop("a_length", "a_share", "share", "turn", "at", "ahead")
    )
    mine = (
        (F.col("length") == F.col("s_length"))
        & (F.col("number") >= F.col("s_first"))
        & (F.col("number") < F.col("s_end"))
    )
    place = F.col("number") - F.col("s_first")
    return (
        numbered.join(F.broadcast(table), mine)
        .withColumn("sequence_id", F.col("s_sequence") + F.floor(place / F.col("a")))
        .withColumn("offset", F.col("s_offset") + place % F.col("a") * F.col("length"))
        .select(*cut.columns, "sequence_id", "offset")
    )


def packed_documents(docs: DataFrame, ranks: str, pattern: str, capacity: int = CAPACITY, **names: str) -> DataFrame:
    """Pieces of all documents with their places; the pieces are written once."""
    return packed(staged(pieces(docs, ranks, pattern, capacity, **names)), capacity)
