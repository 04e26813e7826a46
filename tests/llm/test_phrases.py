"""Collocations against plain counting; transducers against the grams that they hold."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm.edge_rows import ROWS, ascii_lower, documents

from renderscope.llm import phrases


def brute(rows, least=10, share=50, top=2000):
    counts, total = {}, Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(r[1])):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            own = counts.setdefault(lang, Counter())
            own.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in f.items() if len(q) > len(p) and b >= least and p in (q[:2], q[1:])]
            if not any(100 * b >= share * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def sample_rows():
    random.seed(3)
    rows = []
    for i in range(300):
        text = ""
        for _ in range(random.randint(0, 60)):
            text += random.choice(["the cat", "New York City", "a a a", "état fini", "x", "y", "the"]) + random.choice([" ", " ", "\t", ", ", ".\n", "  "])
        rows.append((i, text, random.choice(["en", "en", "fr", None]), "s", 1, "x"))
    return rows


@pytest.mark.parametrize("grams", [3_000_000, 60])
def test_against_counting(spark, monkeypatch, grams):
    monkeypatch.setattr(phrases, "RANGE_GRAMS", grams)
    rows = sample_rows() + ROWS
    docs = documents(spark, "rank string", rows).repartition(5)
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == brute(rows)
    if grams == 60:
        assert sum(map(len, phrases.cut_points(phrases.shards(docs)).values())) > 5


def test_hot_pair_and_limits(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANGE_GRAMS", 40)
    rows = [(i, f"hot pair w{i % 97} tail, hot pair", "en", "s", 1, "x") for i in range(2000)]
    docs = documents(spark, rows=rows).repartition(4)
    assert sorted(map(tuple, phrases.collocations(docs, least=5, share=90, top=7).collect())) == brute(rows, 5, 90, 7)


def test_empty(spark):
    docs = documents(spark)
    assert phrases.collocations(docs.limit(0)).collect() == []
    assert phrases.collocations(docs.filter("doc_id in (3, 4, 5)")).collect() == []


def test_transducer_holds_its_grams():
    rng = np.random.default_rng(2)
    words = pa.array([f"w{i}".encode() for i in rng.permutation(50)], pa.binary())
    parts = []
    for _ in range(3):
        a, b, c = rng.integers(1, 51, (3, 400))
        key = (a << 42) | (b << 21) | np.where(rng.random(400) < 0.3, 0, c)
        parts.append(phrases.Counts.of(words, key, rng.integers(1, 4, 400)))
    whole = phrases.Counts.union(parts)
    assert whole.n.sum() == sum(p.n.sum() for p in parts)
    grams = [whole.gram(i) for i in range(len(whole.key))]
    assert grams == sorted(set(grams))
    back = phrases.Counts.read(whole.automaton())
    assert (back.key == whole.key).all() and (back.n == whole.n).all() and back.words.equals(whole.words)
    at = whole.place(grams[100])
    cut = [phrases.Counts.read(p.automaton()) for p in (whole.only(0, at), whole.only(at, len(grams)))]
    assert at == 100 and [c.gram(i) for c in cut for i in range(len(c.key))] == grams
    # States with the same arcs are one: many pairs before one word with one weight need one arc.
    a, b = np.divmod(np.arange(2500), 50)
    many = phrases.Counts.of(words, ((a + 1) << 42) | ((b + 1) << 21) | 7, np.ones(2500, np.int64))
    assert len(phrases.unpack(phrases._split(many.automaton())[3])) == 1
