"""Periodic runs of words, found through a dictionary of basic factors.

The dictionary names, for every power of two L, the factors of L words that
occur more than once: equal names mean equal words. A name of length 2L is the
pair of the names of its halves, so a level is one sort of the pairs of the
level below; factors that occur once can't be part of a run's repetition and
drop out, which leaves little of ordinary text above the first levels.

On a level, the next occurrence of a factor at a distance of at most 2L proposes
the distance as a period, and neighbouring positions with one distance form an
arithmetic progression. A progression is extended both ways by comparing the
text with itself shifted by the period, largest factors first. A run of three
periods or more shows in full on the level whose L is the first not below its
period; smaller levels may find it early, and equal findings are told apart by
start and period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renderscope.llm.shingles import text_runs
from renderscope.llm.words import cut

#: Words of the shortest run, and periods that a run has at least.
LEAST_WORDS = 24
LEAST_PERIODS = 3


class Dictionary:
    """Names of repeated factors of 2**level symbols: per level the positions, in order, and their names."""

    def __init__(self, symbols: np.ndarray, text: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.next: list[tuple[np.ndarray, np.ndarray]] = []
        position = np.arange(len(symbols))
        # A name holds its text: factors of two texts, or across two, are never equal.
        key = text.astype(np.int64) * (int(symbols.max(initial=0)) + 1) + symbols
        half = 1
        while len(position):
            position, names = self._add(position, key)
            at = np.searchsorted(position, position + half)
            at[at == len(position)] = 0
            both = position[at] == position + half if len(position) else np.empty(0, bool)
            key = names[both] * (int(names.max(initial=0)) + 1) + names[at[both]]
            position, half = position[both], half * 2

    def _add(self, position: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key, place = key[order], position[order]
        same = key[1:] == key[:-1]
        self.next.append((place[:-1][same], (place[1:] - place[:-1])[same]))
        repeated = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        names = np.cumsum(np.concatenate([[0], ~same]))[repeated]
        place = place[repeated]
        order = np.argsort(place)
        self.levels.append((place[order], names[order]))
        return self.levels[-1]

    def _names(self, level: int, position: np.ndarray) -> np.ndarray:
        places, names = self.levels[level]
        if not len(places):
            return np.full(len(position), -1)
        at = np.minimum(np.searchsorted(places, position), len(places) - 1)
        return np.where(places[at] == position, names[at], -1)

    def common(self, position: np.ndarray, shift: np.ndarray, forward: bool) -> np.ndarray:
        """Symbols that agree from ``position`` and from ``position + shift`` on, or (not ``forward``) before both."""
        found = np.zeros(len(position), np.int64)
        open_ = np.arange(len(position))  # may still agree on a factor of this level
        for level in range(len(self.levels) - 1, -1, -1):
            size, rows = 1 << level, open_
            while len(rows):
                at = position[rows] + found[rows] if forward else position[rows] - found[rows] - size
                a, b = self._names(level, at), self._names(level, at + shift[rows])
                rows = rows[(a >= 0) & (a == b)]
                found[rows] += size
        return found


def runs(
    symbols: np.ndarray, text: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and smallest period of all maximal runs, in order of start, then period.

    ``least_periods`` is 3 at least: shorter repetitions need not show on a level.
    """
    if least_periods < 3:
        raise ValueError("runs have three periods at least")
    factors = Dictionary(symbols, text)
    found = []
    for level, (position, distance) in enumerate(factors.next):
        size = 1 << level
        near = distance <= 2 * size
        position, distance = position[near], distance[near]
        order = np.argsort(position)
        position, distance = position[order], distance[order]
        if not len(position):
            continue
        breaks = np.flatnonzero((np.diff(position) != 1) | (np.diff(distance) != 0)) + 1
        first, last = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(position)]]) - 1
        start, period = position[first], distance[first]
        end = position[last] + size + period
        # From periods within the factor's size on, a progression spans its run.
        may = (end - start >= np.maximum(least_words, least_periods * period)) | (period > size)
        start, period, end = start[may], period[may], end[may]
        start = start - factors.common(start, period, forward=False)
        end = end + factors.common(end - period, period, forward=True)
        long = end - start >= np.maximum(least_words, least_periods * period)
        found.append(np.stack([start[long], period[long], end[long]], axis=1))
    rows = np.unique(np.concatenate([np.empty((0, 3), np.int64), *found]), axis=0)
    return rows[:, 0], rows[:, 2], rows[:, 1]


def repetition(n: int, seed: int) -> tuple[int, int] | None:
    """Where the words of a text start to repeat, and after how many; None for nine texts in ten."""
    if seed % 10 or not n:
        return None
    g = seed // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        *[(name, pa.int64()) for name in ("n_runs", "start", "length", "period", "exponent_milli")],
        ("runs_sha256", pa.string()),
        ("collapsed_sha256", pa.string()),
        ("runs", pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))),
        ("collapsed", pa.string()),
    ]
)


def _texts(ids: list[int | None], texts: list[str | None], planted: bool) -> Iterator[tuple]:
    words = cut(texts)
    size = np.bincount(words.text, minlength=len(texts))
    base = np.cumsum(size) - size
    code = words.code
    if planted:
        source = np.arange(len(code))
        for i, (doc, n) in enumerate(zip(ids, size.tolist(), strict=True)):
            repeat = repetition(n, zlib.crc32(b"" if doc is None else str(doc).encode()))
            if repeat:
                a, p = repeat
                source[base[i] + a : base[i] + n] = base[i] + a + np.arange(n - a) % p
        code = code[source]
    start, end, period = runs(code, words.text)
    dropped = np.zeros(len(code) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, end, -1)
    kept = np.cumsum(dropped)[:-1] == 0
    names = words.distinct.to_pylist()
    cuts = np.searchsorted(start, np.append(base, len(code)))
    for i, doc in enumerate(ids):
        own = slice(cuts[i], cuts[i + 1])
        found = list(zip((start[own] - base[i]).tolist(), (end - start)[own].tolist(), period[own].tolist(), strict=True))
        here = slice(base[i], base[i] + size[i])
        left = b" ".join(map(names.__getitem__, code[here][kept[here]].tolist()))
        best: tuple = (None,) * 4
        for s, n, q in found:  # in order of start, then period: a later one must be strictly better
            if best[0] is None or n * best[2] > best[1] * q:
                best = (s, n, q, 1000 * n // q)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        digests = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()
        yield doc, len(found), *best, *digests, found, left


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False, with_text: bool = False
) -> DataFrame:
    """Runs of every whole text, one row per input row.

    doc_id, n_runs, then start, length, period, exponent_milli of the run with the
    greatest length / period (ties: smallest start, then period), digests of the
    list of runs and of the text without repetitions, and with ``with_text`` those
    themselves: runs (start, length, period), collapsed. Starts count words from 0.

    Null and empty texts have no words: no runs, four nulls, digests of nothing.
    Repeated ids are rows of their own. Texts never share runs. An empty table
    gives no rows; other columns are not looked at. ``planted`` first makes one
    text in ten repeat itself, as ``repetition`` says from the crc32 of the id's
    decimal text (null id: of no text). Texts are taken in runs of some MB; one
    larger than that is alone in memory, with 16 bytes a word and level at most.
    """
    names = RESULT.names if with_text else RESULT.names[:-2]
    schema = pa.schema([RESULT.field(n) for n in names])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_runs(batch, 1):
                ids = batch.column(0).slice(at, len(texts)).to_pylist()
                columns = list(zip(*_texts(ids, texts, planted), strict=True))
                if with_text:
                    keys = RESULT.field("runs").type.value_type.names
                    columns[-2] = [[dict(zip(keys, r, strict=True)) for r in rows] for rows in columns[-2]]
                    columns[-1] = [t.decode("utf-8", "surrogatepass") for t in columns[-1]]
                arrays = [pa.array(c, schema.field(n).type) for n, c in zip(names, columns, strict=False)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    numbers = "n_runs long, start long, length long, period long, exponent_milli long"
    result = f"doc_id long, {numbers}, runs_sha256 string, collapsed_sha256 string"
    if with_text:
        result += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(found, result)
