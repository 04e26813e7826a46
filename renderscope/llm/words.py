"""Words of many whole texts at once, as numbers into their distinct words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A byte that UTF-8 never holds; it stands after every text.
END = 0xFF
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


@dataclass
class Words:
    """``code`` numbers into ``distinct``, ``text`` and ``piece`` of each word, in order."""

    code: np.ndarray
    distinct: pa.BinaryArray
    text: np.ndarray
    piece: np.ndarray


def cut(texts: list[str | None], blanks: bytes = BLANKS, breaks: bytes = b"", lower: bool = False) -> Words:
    """Words are longest runs of bytes that are neither ``blanks`` nor ``breaks``; both are ASCII.

    A break ends a piece, and so does the end of a text; pieces are numbered
    over all texts. Null counts as empty. ``lower`` lower-cases A-Z.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = bytes([END]).join([*parts, b""])
    if lower:
        joined = joined.lower()
    data = np.frombuffer(joined, np.uint8)
    kind = np.zeros(256, np.uint8)
    kind[list(blanks)] = 1
    kind[[*breaks, END]] = 2
    kind = kind[data]
    word = np.concatenate([[False], kind == 0, [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])  # start and end of each word in turn
    starts = edges[::2]
    if len(edges):
        offsets = pa.array(edges, pa.int64())
        spans = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(edges) - 1, [None, offsets.buffers()[1], pa.py_buffer(joined)]
        )
        encoded = spans.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode()
        code, distinct = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.cast(pa.binary())
    else:
        code, distinct = np.empty(0, np.int64), pa.array([], pa.binary())
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) - 1
    return Words(code, distinct, np.searchsorted(ends, starts), np.searchsorted(np.flatnonzero(kind == 2), starts))
