"""CTW, quality classifier and token counts."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm.edge_rows import ROWS, ascii_lower, documents, words

from renderscope.llm import ctw, lm_score, quality, token_counts


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


# --- context trees -------------------------------------------------------------


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Plain:
    """Context trees straight from the definition, one node at a time."""

    def __init__(self, texts, depth):
        self.depth, self.count = depth, Counter()
        for t in texts:
            data = b"\n" * depth + t
            for i in range(depth, len(data)):
                for d in range(depth + 1):
                    for j in range(8):
                        bit = data[i] >> (7 - j) & 1
                        self.count[data[i - d : i], j, data[i] >> (8 - j), bit] += 1
        self.below = {}
        for s, j, prefix, _ in self.count:
            if s:
                self.below.setdefault((s[1:], j, prefix), set()).add(s)
        self.known = {}

    def log_weighted(self, s, j, prefix):
        key = s, j, prefix
        if key not in self.known:
            stop = log_kt(self.count[(*key, 0)], self.count[(*key, 1)])
            if len(s) == self.depth:
                self.known[key] = stop
            else:
                deep = sum(self.log_weighted(c, j, prefix) for c in sorted(self.below.get(key, ())))
                self.known[key] = np.logaddexp(stop, deep) - math.log(2)
        return self.known[key]

    def bit(self, context, d, j, prefix, bit):
        s = context[len(context) - d :]
        zeros, ones = self.count[s, j, prefix, 0], self.count[s, j, prefix, 1]
        if not zeros + ones:
            return 0.5
        p = ((ones if bit else zeros) + 0.5) / (zeros + ones + 1)
        if d == self.depth:
            return p
        w = math.exp(log_kt(zeros, ones) - math.log(2) - self.log_weighted(s, j, prefix))
        return w * p + (1 - w) * self.bit(context, d + 1, j, prefix, bit)

    def log10(self, text):
        data = b"\n" * self.depth + text
        return sum(
            math.log10(self.bit(data[i - self.depth : i], 0, j, data[i] >> (8 - j), data[i] >> (7 - j) & 1))
            for i in range(self.depth, len(data))
            for j in range(8)
        )


def test_trees_from_the_definition():
    texts = [b"abracadabra\n", b"a rabbi\n", "déjà vu\n".encode(), b"\n"]
    asked = [*texts, b"abba\n", b"zzz\n"]
    for depth in (1, 3):
        plain = Plain(texts, depth)
        code, lengths = ctw.grams(asked, depth)
        keys = np.unique(code)
        learnt, _ = ctw.grams(texts, depth)
        count = np.array([(learnt == k).sum() for k in keys])
        logs = np.log10(ctw.predict(keys, ctw.trees(keys, count, depth, 0), depth)).sum(axis=0)
        parts = np.split(logs[np.searchsorted(keys, code)], np.cumsum(lengths)[:-1])
        assert [p.sum() for p in parts] == pytest.approx([plain.log10(t) for t in asked], rel=1e-9)


def test_probabilities_of_a_context_sum_to_one():
    code, _ = ctw.grams([b"abracadabra\n", b"barbara\n"], 2)
    keys, count = np.unique(code, return_counts=True)
    levels = ctw.trees(keys, count, 2, 0)
    every = (np.uint64(ord("a")) << np.uint64(16) | np.uint64(ord("b")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    assert ctw.predict(every, levels, 2).prod(axis=0).sum() == pytest.approx(1)


def test_lgamma_and_packing():
    x = np.array([0.5, 1, 1.5, 7, 100.5, 1e9])
    assert ctw.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
    keys = np.array([3, 9, 2**63 + 5], np.uint64)
    assert (lm_score.unpack(lm_score.pack(keys)) == keys).all()
    assert (lm_score.unpack(lm_score.pack(np.array([1.5, -2.0]))) == [1.5, -2.0]).all()


def test_scores_of_documents(spark, monkeypatch):
    rows = [r for r in ROWS if len(r[1] or "") < 1000]
    depth = 3
    plain = Plain([ctw.canonical(r[1])[0] for r in rows if fold(r[0]) != 1], depth)
    counts = Counter(w for r in rows if fold(r[0]) != 1 for w in [*words(ascii_lower(r[1])), b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        tokens = [*words(ascii_lower(r[1])), b"\n"]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        want.append((r[0], fold(r[0]) == 1, len(tokens), sum(counts[t] > 0 for t in tokens), n, base, plain.log10(ctw.canonical(r[1])[0])))
    for fan_in, most in ((64, 8_000_000), (2, 4)):  # also: many parts of a shard, blocks flushed early
        monkeypatch.setattr(lm_score, "FAN_IN", fan_in)
        monkeypatch.setattr(lm_score, "BLOCK_GRAMS", most)
        docs = documents(spark, "score string", rows).repartition(5)
        got = lm_score.language_scores(docs, depth).collect()
        got = sorted((tuple(r)[:7] for r in got), key=repr)
        for g, w in zip(got, sorted(want, key=repr), strict=True):
            assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_scores_with_nothing_to_learn_from(spark):
    one = [r for r in ROWS if fold(r[0]) == 1 and r[0] is not None][:1]
    assert one
    (got,) = lm_score.language_scores(documents(spark, rows=one), 2).collect()
    assert got.train_tokens == 0 and got.n_known == 0 and got.bits_per_byte == pytest.approx(8)
    assert lm_score.language_scores(documents(spark).limit(0)).collect() == []


# --- quality -------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["the", "of", "thing", "walk", "onree", "heand", "ering"]
    good = lambda: " ".join(rng.choice(vocabulary, 30)) + "."
    bad = lambda: " ".join(f"{w}{m}" for w, m in zip(rng.choice(vocabulary, 30), itertools.cycle(["***", "$$$"]), strict=False))
    rows = [(i, good() if i % 4 else bad(), "en", "s", 1, "x") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(7, None), (None, 1)], "doc_id long, quality int")
    docs = documents(spark, "score string", rows)
    got = {r.doc_id: r for r in quality.classified(docs, labels).collect()}
    assert all(r.held_out == (fold(i) == 0) for i, r in got.items())
    assert all(r.predicted == int(i % 4 > 0) for i, r in got.items())
    again = {r.doc_id: r.score for r in quality.classified(docs.repartition(9), labels).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()}, abs=1e-12)
    # Labels of the held-out fold, and columns other than the text, change nothing.
    other = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end quality")
    plain = docs.selectExpr("doc_id", "text", "'zz' lang", "'zz' source")
    assert {r.doc_id: r.score for r in quality.classified(plain, other).collect()} == pytest.approx(again, abs=1e-12)
    kept = quality.passing(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 300


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(1, 1), (8, 1), (10, 0)], "doc_id long, quality int")
    docs = documents(spark, "predicted string")
    got = quality.classified(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    none = quality.classified(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classified(docs.limit(0), labels).collect() == []


# --- token counts --------------------------------------------------------------


def test_lengths_and_limits(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BITS", 3)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = documents(spark, "n_tokens string")
    lengths = token_counts.token_lengths(docs, path, public_tokenizers.PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_counts.rank_file(path), special_tokens={})
    want = [len(encoding.encode_ordinary(r[1] or "")) for r in ROWS]
    assert sorted(r.n_tokens for r in lengths.collect()) == sorted(want)
    got = {r.context_limit: r for r in token_counts.by_limit(token_counts.length_histogram(lengths)).collect()}
    assert set(got) == set(want)
    for limit, r in got.items():
        assert r.docs == want.count(limit) and r.docs_over == sum(n > limit for n in want)
        assert r.tokens_kept == sum(min(n, limit) for n in want) and r.tokens_total == sum(want)
        assert r.tokens_within == sum(n for n in want if n <= limit)
        assert r.quantile == pytest.approx(sum(n <= limit for n in want) / len(want))
    assert token_counts.by_limit(token_counts.length_histogram(lengths.limit(0))).collect() == []
