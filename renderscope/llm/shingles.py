"""Word shingles and minwise signatures, in Arrow batches of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Words of a shingle.
WIDTH = 5
#: Places of a signature.
PLACES = 64
BATCH_CHARS = 4 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


SEEDS = mixed(np.arange(1, PLACES + 1, dtype=np.uint64) * _MIX)


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    gram = np.full(len(words) - width + 1, np.uint64(width))
    for i in range(width):
        gram = mixed(gram * _MIX + words[i : len(words) - width + 1 + i])
    return gram


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64-bit hashes, in order) of all texts one after another, and how many each has."""
    cut = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    flat = np.empty(sum(map(len, cut)), object)
    at = 0
    for words in cut:
        flat[at : at + len(words)] = words
        at += len(words)
    hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)
    sets, at = [], 0
    for words in cut:
        own = hashes[at : at + len(words)]
        at += len(words)
        sets.append(np.unique(_grams(own, min(WIDTH, len(own)))) if len(own) else own)
    return np.concatenate([np.empty(0, np.uint64), *sets]), np.fromiter(map(len, sets), np.int64, len(sets))


def _by_text(values: np.ndarray, counts: np.ndarray, of: np.ufunc) -> np.ndarray:
    """A value per text that has shingles."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    return of.reduceat(values, starts) if len(starts) else np.empty(0, values.dtype)


def set_keys(shingles: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """A 128-bit key of each set; None for empty sets."""
    with np.errstate(over="ignore"):
        parts = [_by_text(mixed(shingles ^ seed), counts, np.add) for seed in SEEDS[:2]]
    raw = np.stack(parts, axis=1).astype("<u8").tobytes() if len(parts[0]) else b""
    out, at = [], 0
    for n in counts:
        out.append(raw[at : at + 16] if n else None)
        at += 16 if n else 0
    return out


def signatures(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts with shingles, PLACES): leading bits of the smallest mixed shingle under each seed."""
    rows = [(_by_text(mixed(shingles ^ seed), counts, np.minimum) >> np.uint64(32)).astype(np.uint32) for seed in SEEDS]
    return np.stack(rows, axis=1) if len(rows[0]) else np.empty((0, PLACES), np.uint32)


def text_runs(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of whole texts of about BATCH_CHARS, with the place of the first."""
    start, part, size = 0, [], 0
    for i, x in enumerate(batch.column(text_at)):
        part.append(x.as_py())
        size += len(part[-1] or "")
        if size >= BATCH_CHARS or i == batch.num_rows - 1:
            yield start, part
            start, part, size = i + 1, [], 0
