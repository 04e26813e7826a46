"""Collocations of words per language, through weighted acyclic automata.

Every word occurrence is one gram: itself and the words that follow it in its
piece, three at most. A shard sorts its grams and builds a transducer from them:
arcs are words, an arc weighs what all grams through it count, and states with
the same arcs are one state (``Counts.automaton``). How often a phrase occurs is
the weight of its last arc, the sum over the grams in its prefix range.

Transducers are cut at prefixes that a bounded sample of grams suggests, so that
ranges hold like numbers of grams however frequent a word or pair is; results do
not depend on the cuts. The owner of a range unites the shards' transducers and
adds their weights. Prefixes that a cut divides are added up afterwards. A phrase
that occurs often enough is composed with the transducers of the ranges its
parts lie in: each range is asked once for the parts of another range's phrases.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renderscope.llm.lm_score import pack, unpack
from renderscope.llm.shingles import text_runs
from renderscope.llm.words import cut
from renderscope.session import staged

BLANKS = b"\x20\x09"
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Words of a gram, and bits of a word's number in a gram's key; number 0 is no word.
LONGEST = 3
BITS = 21
MASK = (1 << BITS) - 1
#: A shard hands over its grams when it holds so many, whatever is left of its partition.
SHARD_GRAMS = 1_000_000
#: Grams of all shards together that one owner of a range unites.
RANGE_GRAMS = 1_500_000
#: Grams looked at to choose the cuts, and those that a shard offers.
SAMPLE, OFFERED = 50_000, 256
#: Occurrences of a candidate.
LEAST = 10
#: A candidate goes if a longer one around it has this share (in hundredths) of its occurrences.
SHARE = 50
TOP = 2000
UNKNOWN = "und"


# --- transducers ---------------------------------------------------------------


@dataclass
class Counts:
    """Sorted grams: ``words`` in byte order, ``key`` three numbers into them from 1 on, ``n`` occurrences."""

    words: pa.BinaryArray
    key: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(words: pa.BinaryArray, key: np.ndarray, n: np.ndarray) -> Counts:
        """From distinct words in any order, and keys in any order, repeated ones too."""
        order = pc.sort_indices(words).to_numpy()
        rank = np.zeros(len(words) + 1, np.int64)
        rank[order + 1] = np.arange(1, len(words) + 1)
        a, b, c = rank[key >> 2 * BITS], rank[(key >> BITS) & MASK], rank[key & MASK]
        return Counts(words.take(pa.array(order)), *_summed((a << 2 * BITS) | (b << BITS) | c, n))

    @staticmethod
    def union(parts: list[Counts]) -> Counts:
        """All grams of ``parts``, weights added."""
        if len(parts) == 1:
            return parts[0]
        encoded = pa.chunked_array([p.words for p in parts], pa.binary()).combine_chunks()
        encoded = (encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded).dictionary_encode()
        if len(encoded.dictionary) > MASK:
            raise ValueError(f"over {MASK} words in a range: lower RANGE_GRAMS")
        number = np.concatenate([[0], encoded.indices.to_numpy().astype(np.int64) + 1])
        keys, base = [], 0
        for p in parts:
            own = np.concatenate([[0], number[base + 1 : base + 1 + len(p.words)]])
            base += len(p.words)
            a, b, c = own[p.key >> 2 * BITS], own[(p.key >> BITS) & MASK], own[p.key & MASK]
            keys.append((a << 2 * BITS) | (b << BITS) | c)
        return Counts.of(encoded.dictionary, np.concatenate(keys), np.concatenate([p.n for p in parts]))

    def only(self, lo: int, hi: int) -> Counts:
        """Grams ``lo`` to ``hi`` with the words that they need."""
        key = self.key[lo:hi]
        a, b, c = key >> 2 * BITS, (key >> BITS) & MASK, key & MASK
        used = np.unique(np.concatenate([a, b, c]))
        used = used[used > 0]
        a, b, c = (np.searchsorted(used, x) + (x > 0) for x in (a, b, c))
        words = self.words.take(pa.array(used - 1))
        return Counts(words, (a << 2 * BITS) | (b << BITS) | c, self.n[lo:hi])

    def gram(self, at: int) -> tuple[bytes, ...]:
        numbers = int(self.key[at]) >> 2 * BITS, (int(self.key[at]) >> BITS) & MASK, int(self.key[at]) & MASK
        return tuple(self.words[i - 1].as_py() if i else b"" for i in numbers)

    def place(self, gram: tuple[bytes, ...]) -> int:
        """How many grams come before ``gram``."""
        lo, hi = 0, len(self.key)
        return bisect.bisect_left(range(hi), True, lo, hi, key=lambda at: self.gram(at) >= gram)

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Prefixes of 1, 2 and 3 words: key without the rest, first gram, weight."""
        for size in range(1, LONGEST + 1):
            prefix = self.key >> (LONGEST - size) * BITS
            first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])[: len(prefix)])
            weight = np.add.reduceat(self.n, first) if len(first) else self.n
            whole = (prefix[first] & MASK) > 0
            yield prefix[first][whole] << (LONGEST - size) * BITS, first[whole], weight[whole]

    def automaton(self) -> bytes:
        """The transducer: words, arcs from the start, arcs of the second states, shared third states.

        Third states are registered by their arcs (word and weight), as the sorted
        grams close them one after another; a state met again is its first number.
        """
        pair = self.key >> BITS
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)])
        size = np.diff(np.append(first, len(pair)))
        arcs = np.stack([self.key & MASK, self.n], axis=1)
        state = np.empty(len(first), np.int64)
        # States of one arc, most of all, are told apart by sorting; larger ones by a register.
        one = size == 1
        singles, state[one] = np.unique(arcs[first[one]], axis=0, return_inverse=True) if one.any() else (arcs[:0], 0)
        register: dict[bytes, int] = {}
        kept = [singles]
        sizes = [np.ones(len(singles), np.int64)]
        for i in np.flatnonzero(~one).tolist():
            own = arcs[first[i] : first[i] + size[i]]
            number = register.setdefault(own.tobytes(), len(register))
            if number == len(kept) - 1:
                kept.append(own)
                sizes.append(np.array([len(own)]))
            state[i] = len(singles) + number
        shared, sizes = np.concatenate(kept), np.concatenate(sizes)
        columns = [pair[first].astype(np.uint64), state, sizes, shared[:, 0], shared[:, 1]]
        return _joined([_words_out(self.words), *[pack(c) for c in columns]])

    @staticmethod
    def read(blob: bytes) -> Counts:
        parts = _split(blob)
        pair, state, sizes, label, weight = (unpack(p) for p in parts[1:])
        start = np.cumsum(sizes) - sizes
        times = sizes[state]
        at = np.repeat(start[state] - np.cumsum(times) + times, times) + np.arange(times.sum())
        key = (np.repeat(pair.astype(np.int64), times) << BITS) | label[at]
        return Counts(_words_in(parts[0]), key, weight[at])


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _words_out(words: pa.BinaryArray) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([words], names=["w"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _words_in(data: bytes) -> pa.BinaryArray:
    return pa.ipc.open_stream(data).read_next_batch().column(0)


def _joined(parts: list[bytes]) -> bytes:
    return b"".join([np.array([len(parts), *map(len, parts)], "<i8").tobytes(), *parts])


def _split(blob: bytes) -> list[bytes]:
    count = int(np.frombuffer(blob, "<i8", 1)[0])
    sizes = np.frombuffer(blob, "<i8", count, 8)
    ends = 8 * (count + 1) + np.cumsum(sizes)
    return [blob[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


# --- shards --------------------------------------------------------------------


def _grams(texts: list[str | None]) -> tuple[Counts, int]:
    words = cut(texts, BLANKS, BREAKS, lower=True)
    a = words.code + 1
    piece = np.concatenate([words.piece, [-1, -2]])
    n = len(a)
    padded = np.concatenate([a, [0, 0]])
    b = np.where(piece[1 : n + 1] == piece[:n], padded[1 : n + 1], 0)
    c = np.where(piece[2 : n + 2] == piece[:n], padded[2 : n + 2], 0)
    key, times = np.unique((a << 2 * BITS) | (b << BITS) | c, return_counts=True)
    return Counts.of(words.distinct, key, times), n


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, words (occurrences), grams, sample, automaton: transducers of each task's texts."""
    schema = pa.schema(
        [("lang", pa.string()), ("words", pa.int64()), ("grams", pa.int64())]
        + [("sample", pa.list_(pa.list_(pa.binary()))), ("automaton", pa.binary())]
    )

    def row(lang: str, parts: list[Counts], words: int) -> pa.RecordBatch:
        counts = Counts.union(parts)
        some = np.linspace(0, len(counts.key) - 1, min(OFFERED, len(counts.key))).astype(np.int64)
        sample = [list(counts.gram(int(at))) for at in some]
        columns = [[lang], [words], [len(counts.key)], [sample], [counts.automaton()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Counts]] = {}
        size: dict[str, list[int]] = {}  # grams, words, distinct words
        for batch in batches:
            for at, texts in text_runs(batch, 1):
                langs = batch.column(0).slice(at, len(texts)).to_pylist()
                by: dict[str, list[str | None]] = {}
                for lang, text in zip(langs, texts, strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, own in by.items():
                    counts, n = _grams(own)
                    if not n:
                        continue
                    held.setdefault(lang, []).append(counts)
                    size[lang] = [x + y for x, y in zip(size.get(lang, [0, 0, 0]), [len(counts.key), n, len(counts.words)], strict=True)]
                    if size[lang][0] >= SHARD_GRAMS or size[lang][2] >= MASK // 2:
                        yield row(lang, held.pop(lang), size.pop(lang)[1])
                if sum(s[0] for s in size.values()) >= 2 * SHARD_GRAMS:  # many languages
                    for lang in list(held):
                        yield row(lang, held.pop(lang), size.pop(lang)[1])
        for lang in list(held):
            yield row(lang, held.pop(lang), size.pop(lang)[1])

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    return docs.select(lang.alias("lang"), F.col(text_col).alias("text")).mapInArrow(
        built, "lang string, words long, grams long, sample array<array<binary>>, automaton binary"
    )


def cut_points(built: DataFrame) -> dict[str, list[tuple[bytes, ...]]]:
    """Grams at which each language's transducers are cut, from a sample of at most SAMPLE of them."""
    total = built.agg(F.sum("grams").alias("grams"), F.count("*").alias("shards")).first()
    ranges = -(-(total.grams or 0) // RANGE_GRAMS)
    if ranges <= 1:
        return {}
    each = F.explode(F.col("sample")).alias("gram")
    weight = F.col("grams") / F.size("sample")
    sample = built.select("lang", weight.alias("weight"), F.monotonically_increasing_id().alias("shard"), each)
    sample = sample.withColumn("turn", F.xxhash64("shard", "lang", "gram")).orderBy("turn").limit(SAMPLE)
    rows = sorted((r.lang, tuple(bytes(w) for w in r.gram), r.weight) for r in sample.select("lang", "gram", "weight").collect())
    scale = total.grams / sum(w for _, _, w in rows)
    points: dict[str, list[tuple[bytes, ...]]] = {}
    room = 0.0
    for lang, gram, weight_ in rows:
        room += weight_ * scale
        if room >= RANGE_GRAMS and (not points.get(lang) or points[lang][-1] < gram):
            points.setdefault(lang, []).append(gram)
            room = 0.0
    return points


# --- counts of phrases ---------------------------------------------------------


def _frame(counts: Counts, keys: np.ndarray, **more: np.ndarray) -> pd.DataFrame:
    words = np.array([None, *counts.words.cast(pa.string()).to_pylist()], object)
    return pd.DataFrame({"w1": words[keys >> 2 * BITS], "w2": words[(keys >> BITS) & MASK], "w3": words[keys & MASK], **more})


def _of_frame(rows: pd.DataFrame, n: np.ndarray | None = None) -> Counts:
    """Grams of rows w1, w2, w3 that differ; ``n`` goes with them."""
    flat = pd.concat([rows.w1, rows.w2, rows.w3]).to_numpy(object)
    some = np.array([isinstance(w, str) for w in flat])
    code = np.zeros(len(flat), np.int64)
    code[some], words = pd.factorize(flat[some])
    code[some] += 1
    a, b, c = code.reshape(3, -1)
    key = (a << 2 * BITS) | (b << BITS) | c
    return Counts.of(pa.array([w.encode("utf-8", "surrogatepass") for w in words], pa.binary()), key, np.zeros(len(key), np.int64) if n is None else n)


def frequent(built: DataFrame, points: dict[str, list[tuple[bytes, ...]]], least: int = LEAST) -> DataFrame:
    """lang, range, w1, w2, w3 (null beyond the phrase), f: phrases of 1 to 3 words with f >= ``least``."""
    shared = built.sparkSession.sparkContext.broadcast(points)  # at most SAMPLE grams

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("range", pa.int64()), ("automaton", pa.binary())])
        for batch in batches:
            for lang, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = Counts.read(blob.as_py())
                bounds = [0, *(counts.place(g) for g in shared.value.get(lang, [])), len(counts.key)]
                for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    if lo < hi:
                        columns = [[lang], [i], [counts.only(lo, hi).automaton()]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def united(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = Counts.union([Counts.read(blob) for blob in rows.automaton])
        edges = counts.key[[0, -1]]
        out = []
        for size, (keys, first, f) in enumerate(counts.levels(), 1):
            rest = (LONGEST - size) * BITS
            divided = np.isin(keys >> rest, edges >> rest)  # a neighbouring range may hold more of it
            keep = (f >= least) | divided
            out.append(_frame(counts, keys[keep], f=f[keep]))
        return pd.concat(out, ignore_index=True).assign(lang=key[0])

    pieces = built.select("lang", "automaton").mapInArrow(cuts, "lang string, range long, automaton binary")
    sums = pieces.groupBy("lang", "range").applyInPandas(united, "lang string, w1 string, w2 string, w3 string, f long")
    whole = sums.groupBy("lang", "w1", "w2", "w3").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)

    @F.pandas_udf("long")
    def range_of(lang: pd.Series, w1: pd.Series, w2: pd.Series, w3: pd.Series) -> pd.Series:
        return pd.Series(_ranges(shared.value, lang, w1, w2, w3), dtype="int64")

    return whole.withColumn("range", range_of("lang", "w1", "w2", "w3"))


def _ranges(points: dict[str, list[tuple[bytes, ...]]], lang, w1, w2, w3) -> list[int]:
    def gram(*words) -> tuple[bytes, ...]:
        return tuple(w.encode("utf-8", "surrogatepass") if isinstance(w, str) else b"" for w in words)

    return [bisect.bisect_right(points.get(g, []), gram(*ws)) if g in points else 0 for g, *ws in zip(lang, w1, w2, w3, strict=True)]


# --- parts ---------------------------------------------------------------------

PARTS = [("w1", None, None), ("w2", None, None), ("w3", None, None), ("w1", "w2", None), ("w2", "w3", None)]


def _parts(rows: pd.DataFrame) -> pd.DataFrame:
    """Distinct parts of the phrases in ``rows``."""
    long = rows[rows.w2.notna()]
    found = [pd.DataFrame({f"w{i + 1}": (long[c] if c else None) for i, c in enumerate(part)}) for part in PARTS]
    found = pd.concat(found, ignore_index=True)
    return found[found.w1.notna()].drop_duplicates()


def with_parts(phrases: DataFrame, points: dict[str, list[tuple[bytes, ...]]]) -> DataFrame:
    """Phrases of 2 and 3 words with f1, f2, f3, f12, f23: how often their parts occur.

    Each range asks each other range once, with a transducer of the parts it needs.
    """
    shared = phrases.sparkSession.sparkContext.broadcast(points)
    ask = "lang string, asker long, range long, wanted binary"

    def asked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wanted = _parts(rows)
        to = np.array(_ranges(shared.value, [key[0]] * len(wanted), wanted.w1, wanted.w2, wanted.w3), np.int64)
        out = [(key[0], key[1], int(r), _of_frame(wanted[to == r]).automaton()) for r in np.unique(to)]
        return pd.DataFrame(out, columns=["lang", "asker", "range", "wanted"])

    def composed(key: tuple, asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """Walk the asked parts and this range's transducer side by side."""
        own = _of_frame(rows, rows.f.to_numpy(np.int64)) if len(rows) else None
        out = []
        for asker, blob in zip(asks.asker, asks.wanted, strict=True):
            wanted = Counts.read(blob)
            number = np.concatenate([[0], pc.index_in(wanted.words, own.words).fill_null(-2).to_numpy().astype(np.int64) + 1])
            a, b, c = number[wanted.key >> 2 * BITS], number[(wanted.key >> BITS) & MASK], number[wanted.key & MASK]
            keys = (a << 2 * BITS) | (b << BITS) | c
            at = np.minimum(np.searchsorted(own.key, keys), len(own.key) - 1)
            if not (own.key[at] == keys).all():
                raise RuntimeError("a part is rarer than its phrase")
            out.append((key[0], asker, Counts(wanted.words, wanted.key, own.n[at]).automaton()))
        return pd.DataFrame(out, columns=["lang", "range", "answer"])

    def met(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        got: dict[tuple, int] = {}
        for blob in answers.answer:
            counts = Counts.read(blob)
            named = _frame(counts, counts.key)
            got.update(zip(zip(named.w1, named.w2, named.w3, strict=True), counts.n.tolist(), strict=True))
        long = rows[rows.w2.notna()].reset_index(drop=True)
        named = {c: [w if isinstance(w, str) else None for w in long[c]] for c in ("w1", "w2", "w3")}
        none = [None] * len(long)
        columns = {}
        for name, part in zip(("f1", "f2", "f3", "f12", "f23"), PARTS, strict=True):
            of = zip(*[named[c] if c else none for c in part], strict=True)
            columns[name] = pd.array([got.get(p) for p in of], dtype="Int64")
        return long[["lang", "w1", "w2", "w3", "f"]].assign(**columns)

    asks = phrases.groupBy("lang", "range").applyInPandas(asked, ask)
    answers = (
        asks.groupBy("lang", "range")
        .cogroup(phrases.groupBy("lang", "range"))
        .applyInPandas(composed, "lang string, range long, answer binary")
    )
    return (
        phrases.groupBy("lang", "range")
        .cogroup(answers.groupBy("lang", "range"))
        .applyInPandas(met, "lang string, w1 string, w2 string, w3 string, f long, f1 long, f2 long, f3 long, f12 long, f23 long")
    )


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    share: int = SHARE,
    top: int = TOP,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to 3 words.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and at
    spaces and tabs into words; n counts word occurrences, a those of the phrase, l
    and r those of the parts of its weakest cut (ties: the first), and score is
    floor(1000000 a a / (l r)), exact. Phrases with at least ``least`` occurrences
    count; those inside a longer one with ``share`` hundredths of their occurrences
    go. Ranks fall by score, then a, then phrase in byte order; ``top`` per language.

    Null texts count as empty, null languages as ``und``. Repeated rows count each
    time. Empty tables and languages without phrases give no rows. Other columns
    are not looked at.
    """
    built = staged(shards(docs, text_col, lang_col))
    totals = built.groupBy("lang").agg(F.sum("words").alias("n"))
    points = cut_points(built)
    phrases = staged(frequent(built, points, least))
    # Longer candidates around each pair.
    around = phrases.filter("w3 is not null").select("lang", "f", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    around = around.groupBy("lang", "p.w1", "p.w2").agg(F.max("f").alias("longer"))
    pair = F.col("w3").isNull()
    big = "decimal(38,0)"
    score = "(cast(f as decimal(19,0)) * f * 1000000) div (cast({} as decimal(19,0)) * {})"
    cuts = F.when(
        pair, F.array(F.struct(F.expr(score.format("f1", "f2")).alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f2").alias("r")))
    ).otherwise(
        F.array(
            F.struct(F.expr(score.format("f1", "f23")).alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f23").alias("r")),
            F.struct(F.expr(score.format("f12", "f3")).alias("score"), F.lit(2).alias("k"), F.col("f12").alias("l"), F.col("f3").alias("r")),
        )
    )
    longer = around.withColumnsRenamed({"lang": "o_lang", "w1": "o_w1", "w2": "o_w2"})
    inside = pair & (F.col("lang") == F.col("o_lang")) & (F.col("w1") == F.col("o_w1")) & (F.col("w2") == F.col("o_w2"))
    ranks = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        with_parts(phrases, points)
        .join(longer, inside, "left")
        .filter(F.col("longer").isNull() | (F.col("longer").cast(big) * 100 < F.col("f").cast(big) * share))
        .withColumn("cut", F.array_min(cuts))
        .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        .withColumn("rank", F.row_number().over(ranks).cast("long"))
        .filter(F.col("rank") <= top)
        .join(F.broadcast(totals), "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
