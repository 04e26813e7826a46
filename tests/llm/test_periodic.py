"""Periodic runs against all periods and starts tried one by one."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from llm.edge_rows import ROWS, documents, words

from renderscope.llm import periodic


def brute(x, least=24):
    """start, period, end of all runs: for each period the longest stretches that keep it, if no shorter period fits them."""
    n, out = len(x), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, 3 * q) and not any(x[s : e - p] == x[s + p : e] for p in range(1, q)):
                out.append((s, q, e))
    return sorted(out)


def expected(doc, text, planted):
    x = words(text)
    h = zlib.crc32(str(doc).encode() if doc is not None else b"")
    if planted and h % 10 == 0 and x:
        g = h // 10
        a = g % len(x)
        p = 1 + (len(x) - a) // (3 + g % 8)
        x = x[:a] + [x[a + (i - a) % p] for i in range(a, len(x))]
    runs = [(s, e - s, q) for s, q, e in brute(x)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    left = b" ".join(w for i, w in enumerate(x) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest())


def key(row):
    return str(tuple(row))


def test_random_texts_together():
    random.seed(1)
    for _ in range(200):
        flat, text, want = [], [], []
        for d in range(random.randint(1, 4)):
            x = []
            while len(x) < random.randint(0, 200):
                block = [random.randint(0, random.choice([0, 1, 2, 5])) for _ in range(random.randint(1, random.choice([3, 10, 30])))]
                x += block * random.randint(1, random.choice([2, 5, 30]))
            want += [(s + len(flat), e + len(flat), q) for s, q, e in brute(x)]
            flat, text = flat + x, text + [d] * len(x)
        got = periodic.runs(np.array(flat, np.int64), np.array(text, np.int64))
        assert list(zip(*(c.tolist() for c in got), strict=True)) == sorted(want, key=lambda r: (r[0], r[2]))


def test_long_repetition():
    x = np.tile(np.arange(1000), 40)
    start, end, period = periodic.runs(x, np.zeros(len(x), np.int64))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [40_000], [1000])
    with pytest.raises(ValueError):
        periodic.runs(x, np.zeros(len(x), np.int64), least_periods=2)


@pytest.mark.parametrize("planted", [False, True])
def test_documents(spark, planted):
    rows = [(i, "a b " * 30 + "x" + " c d e" * (i % 20), "en", "s", 1, "x") for i in range(100, 140)]
    rows += [r for r in ROWS if len(words(r[1])) < 1000]
    got = periodic.periodic_runs(documents(spark, "n_runs string", rows), planted=planted)
    assert sorted(map(key, got.collect())) == sorted(key(expected(r[0], r[1], planted)) for r in rows)


def test_spans_and_texts(spark):
    docs = documents(spark, rows=[(1, "say  " + "a\tb " * 20 + "end", "en", "s", 1, "x"), (2, None, "en", "s", 1, "x")])
    got = {r.doc_id: r for r in periodic.periodic_runs(docs, with_text=True).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 40, 2)] and got[1].collapsed == "say a b end"
    assert got[2].runs == [] and got[2].collapsed == "" and got[2].n_runs == 0
    long = periodic.periodic_runs(documents(spark).filter("doc_id in (8, 9)")).collect()
    assert [(r.start, r.length, r.period) for r in long] == [(0, 30_000, 977)] * 2
    assert periodic.periodic_runs(docs.limit(0)).collect() == []
