"""Packing: pieces against the tokenizer library, sequences without gaps, and how many there are."""

import bisect
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm.edge_rows import ROWS, documents
from tokenizers import Tokenizer

from renderscope.llm import packing

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def best_fit(items, capacity):
    """Sequences that best-fit decreasing opens."""
    rooms, opened = [], 0
    for s in sorted(items, reverse=True):
        at = bisect.bisect_left(rooms, s)
        opened += at == len(rooms)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - s)
    return opened


def whole(rows, capacity):
    """Every sequence is filled from 0 on without gaps, up to the capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def expected(rows, capacity):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    out = []
    for r in rows:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        bounds = sorted({0, *range(len(ids), 0, -capacity)})
        out += [(r[0], i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
    return out


def test_documents(spark):
    got = packing.packed_documents(documents(spark, "sequence_id string"), RANKS, PATTERN).collect()
    want = expected(ROWS, 2048)
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert whole(got, 2048) <= best_fit([w[3] for w in want], 2048)


def test_small_capacity_and_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 16)
    rows = [(i, " w" * (i % 23 if i % 3 else 5), "en", "s", 1, "x") for i in range(600)]
    got = packing.packed_documents(documents(spark, rows=rows), RANKS, PATTERN, capacity=20).collect()
    want = expected(rows, 20)
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert whole(got, 20) <= best_fit([w[3] for w in want], 20) + 1
    ids = packing.pieces(documents(spark, rows=rows), RANKS, PATTERN, 20, with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in ids)
    assert packing.packed_documents(documents(spark, rows=rows).limit(0), RANKS, PATTERN).collect() == []


@pytest.mark.parametrize("kind", ["uniform", "short", "thirds", "equal", "few", "halves"])
def test_program(kind):
    rng = np.random.default_rng(5)
    items = {
        "uniform": rng.integers(1, 2049, 30_000),
        "short": np.minimum(2048, rng.lognormal(5, 1, 20_000).astype(int) + 1),
        "thirds": rng.integers(650, 720, 5_000),
        "equal": np.full(1_000, 700),
        "few": rng.integers(1, 2049, 40),
        "halves": rng.integers(1000, 1050, 3_000),
    }[kind].tolist()
    lengths = Counter(items)
    plan = packing.configurations(dict(lengths), 2048)
    used = Counter()
    for config, n in plan.configs:
        assert sum(s * a for s, a in config.items()) <= 2048
        used.update({s: a * n for s, a in config.items()})
    opened = sum(n for _, n in plan.configs)
    assert used == lengths and math.ceil(plan.least - 1e-6) <= opened <= math.ceil(1.001 * best_fit(items, 2048))


def test_filled():
    left = np.zeros(101, np.int64)
    left[[60, 45, 30, 7]] = [1, 2, 3, 1]
    for room in range(1, 101):
        got = packing.filled(left, room)
        sums = {60 * a + 45 * b + 30 * c + 7 * d for a in range(2) for b in range(3) for c in range(4) for d in range(2)}
        assert sum(s * n for s, n in got.items()) == max(x for x in sums if x <= room)
        assert all(n <= left[s] for s, n in got.items())
