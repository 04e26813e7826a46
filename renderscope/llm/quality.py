"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates.

Features are n-grams of words and n-grams of word shapes (case, digits, the
marks a word carries, whether it repeats the one before), hashed into a fixed
table and counted per word of the text. Shards of the labelled sample are
trained side by side with follow-the-regularised-leader updates and their
weights averaged. A score is a sparse dot product with that table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renderscope.functions.hashing import seeded_key
from renderscope.llm.common import held_out, only_ids

#: log2 of the size of the feature table; a model is 4 MB.
TABLE_BITS = 20
#: Labelled documents that are learnt from, at most; chosen by a hash of their id.
LABELLED = 20_000
SHARDS = 8
EPOCHS = 4
#: FTRL: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
#: Documents at or over this score pass.
THRESHOLD = 0.3
#: Documents of this fold of five are not learnt from.
HELD_OUT = 0
BATCH_CHARS = 4 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shape_of(word: str) -> str:
    """Runs of capitals, small letters and digits become one sign; other marks stay, once each."""
    out = re.sub(r"[^\W\d_]+", lambda m: "U" if m[0].isupper() and len(m[0]) > 1 else "l", word)
    return re.sub(r"(.)\1+", r"\1", re.sub(r"\d+", "9", out))[:12]


def _hashes(items: list[str]) -> np.ndarray:
    values = np.empty(len(items), object)
    values[:] = items
    return pd.util.hash_array(values, categorize=False)


class Features:
    """Word and shape hashes, each distinct word looked at once per task."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.words = np.empty(0, np.uint64)
        self.shapes = np.empty(0, np.uint64)

    def _learn(self, new: list[str]) -> None:
        start = len(self.at)
        self.at.update(zip(new, range(start, start + len(new)), strict=True))
        self.words = np.concatenate([self.words, _hashes([w.lower() for w in new])])
        self.shapes = np.concatenate([self.shapes, _hashes([f"\0{shape_of(w)}" for w in new])])

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature places of all texts, the text each belongs to, and words per text."""
        cut = [t.split() for t in texts]
        if len(self.at) > 2_000_000:
            self.__init__()
        self._learn(list({w for words in cut for w in words if w not in self.at}))
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        ids = np.fromiter(map(self.at.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        text = np.repeat(np.arange(len(cut)), counts)
        word, shape = self.words[ids], self.shapes[ids]
        again = np.zeros(len(ids), np.uint64)
        again[1:] = (ids[1:] == ids[:-1]) & (text[1:] == text[:-1])
        shape = shape + again
        places, owner = [word, shape], [text, text]
        for n, of in ((2, word), (2, shape), (3, shape)):
            if len(of) < n:
                continue
            gram = np.full(len(of) - n + 1, np.uint64(n))
            for i in range(n):
                gram = _mixed(gram * _MIX + of[i : len(of) - n + 1 + i])
            inside = text[: len(of) - n + 1] == text[n - 1 :]
            places.append(gram[inside])
            owner.append(text[: len(of) - n + 1][inside])
        table = _mixed(np.concatenate(places)) >> np.uint64(64 - TABLE_BITS)
        return table.astype(np.int64), np.concatenate(owner), counts


def scores(texts: list[str], features: Features, weights: np.ndarray, bias: float) -> np.ndarray:
    places, owner, counts = features.of(texts)
    sums = np.bincount(owner, weights=weights[places], minlength=len(texts))
    margin = bias + sums / np.maximum(counts, 1)
    return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def train_shard(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over a shard, document by document: places, weights, bias."""
    size = (1 << TABLE_BITS) + 1  # the last place is the bias
    z, n = np.zeros(size), np.zeros(size)
    features = Features()
    rows = []
    for text in texts:
        places, _, counts = features.of([text])
        at, times = np.unique(places, return_counts=True)
        rows.append((np.append(at, size - 1), np.append(times / max(int(counts[0]), 1), 1.0)))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for (at, x), y in zip(rows, labels, strict=True):
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -60, 60))) - y) * x
            more = np.sqrt(n[at] + g * g)
            z[at] += g - (more - np.sqrt(n[at])) / ALPHA * w
            n[at] = more * more
    every = weights(slice(None))
    used = np.flatnonzero(every[:-1])
    return used, every[used], float(every[-1])


def fit(
    docs: DataFrame, labels: DataFrame, most: int = LABELLED, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[np.ndarray, float]:
    """Weights and bias from at most ``most`` labelled documents outside the held-out fold.

    Of several labels of a document the lowest counts. Without labels every
    score is one half; with labels of one kind all scores tend to it.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), HELD_OUT))
    sample = (
        known.groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .withColumn("turn", seeded_key(9, F.col("doc_id")))
        .orderBy("turn", "doc_id")
        .limit(most)
    )
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(sample), "doc_id")  # at most ``most`` ids
        .withColumn("shard", F.col("turn") % SHARDS)
    )

    def shard(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["turn", "text"])
        at, weight, bias = train_shard(part["text"].tolist(), part["quality"].to_numpy(np.float64))
        return pd.DataFrame({"at": np.append(at, 1 << TABLE_BITS), "weight": np.append(weight, bias)})

    trained = rows.groupBy("shard").applyInPandas(shard, "at long, weight double")
    # Shards that are not there have no say; a place that a shard does not know counts as 0.
    mean = trained.groupBy("at").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).toPandas()  # 2^20 rows at most
    weights = np.zeros(1 << TABLE_BITS, np.float32)
    bias = mean[mean["at"] == 1 << TABLE_BITS]
    shards = max(int(bias["n"].sum()), 1)
    places = mean[mean["at"] < 1 << TABLE_BITS]
    weights[places["at"].to_numpy()] = places["weight"].to_numpy() / shards
    return weights, float(bias["weight"].sum()) / shards


def score(
    docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, score of every whole text; nothing else of a row is looked at. Null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))  # 4 MB
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            start, part, size = 0, [], 0
            for i, x in enumerate(batch.column(1)):
                part.append(x.as_py() or "")
                size += len(part[-1])
                if size >= BATCH_CHARS or i == batch.num_rows - 1:
                    values = pa.array(scores(part, features, *shared.value), pa.float64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), values], schema=schema)
                    start, part, size = i + 1, [], 0

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        scored, "doc_id long, score double"
    )


def classified(
    docs: DataFrame, labels: DataFrame, most: int = LABELLED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document, repeated rows included.

    ``labels``: doc_id, quality. Empty documents get the score of the bias;
    an empty table gives no rows. A null id is scored like any other and never learnt from.
    """
    weights, bias = fit(docs, labels, most, id_col, text_col)
    return score(docs, weights, bias, id_col, text_col).select(
        "doc_id",
        held_out(F.col("doc_id"), HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents, with all their columns, that pass the threshold."""
    kept = classified(docs, labels, id_col=id_col, text_col=text_col).filter("predicted = 1")
    return only_ids(docs, kept.withColumnRenamed("doc_id", id_col), id_col)
