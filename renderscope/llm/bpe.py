"""BPE encoding over a lexicon automaton, and decoding.

Word frequencies are counted over the whole corpus. The most frequent words are
merged once and compiled into a minimal acyclic transducer: words that end
alike share states, and the numbers on a path add up to the word's place in the
table of id sequences. The compiled file is sent to every executor and
memory-mapped there, so that all Python workers of a machine share its pages.
Distinct words of a batch walk it together, one letter per step; words that it
does not hold are merged exactly, many at a time.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renderscope.session import shared_folder, staged


#: Most words of the automaton.
LEXICON_WORDS = 1 << 17
#: Longer words are merged one at a time with a heap.
LONG_WORD = 48
#: Words that a task remembers, counts or merges at a time.
REMEMBERED = 600_000
MERGED_AT_ONCE = 1 << 15
#: Characters of text that are in hand at a time.
BATCH_CHARS = 1 << 20

#: Letters and digits of Unicode 16.0 that Python's tables may lack.
MORE_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
MORE_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)
#: Lower-case partners that Python's tables may lack, as (first, last, first partner).
MORE_LOWER = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
    (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
#: Fixed value: White_Space of Unicode.
SPACE = r"\t-\r \x85\xa0  -     　"


# --- text to words -------------------------------------------------------------


def _ranges(first: str, more: Iterable[tuple[int, int]]) -> str:
    """A regular expression class of all characters of a category."""
    runs: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == first:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in [*runs, *more])


ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


@lru_cache
def _patterns() -> tuple[re.Pattern, re.Pattern, dict[int, int]]:
    letters, numbers = _ranges("L", MORE_LETTERS), _ranges("N", MORE_NUMBERS)
    word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")
    lower = {c: b + c - a for a, z, b in MORE_LOWER for c in range(a, z + 1)}
    return word, re.compile(f"[{''.join(map(chr, lower))}]"), lower


#: Fixed value: what Python's split takes for white space and Unicode's property does not.
SEPARATORS = re.compile("[\x1c-\x1f]")


def chunks_of(text: str) -> list[str]:
    """Runs without white space; no word crosses their ends."""
    if SEPARATORS.search(text):
        return [x for x in re.split(f"[{SPACE}]+", text) if x]
    return text.split()


def words_of(text: str) -> list[str]:
    """Words as the tokenizer cuts them: composed, each character lower-cased by itself, white space dropped."""
    if text.isascii():
        return [text.lower()] if text.isalpha() else ASCII_WORD.findall(text.lower())
    word, rare, lower = _patterns()
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no word-final sigma
    if rare.search(text):
        text = text.translate(lower)
    text = text.lower()
    return [text] if text.isalpha() else word.findall(text)


# --- the vocabulary ------------------------------------------------------------


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    at = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [at[b] for b in range(256)]


def cut_up(values: np.ndarray, lengths: np.ndarray) -> list[tuple[int, ...]]:
    """Consecutive runs of so many values each."""
    flat, ends = values.tolist(), [0, *np.cumsum(lengths).tolist()]
    return [tuple(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


class Merges:
    """Vocabulary and merge ranks of a BPE file with word ends."""

    def __init__(self, content: str) -> None:
        data = json.loads(content)
        model = data["model"]
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        self.names = {i: n for n, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names |= {i: n for n, i in self.special.items()}
        characters = _byte_characters()
        self.inner = np.array([vocab[c] for c in characters], np.int32)
        self.last = np.array([vocab[c + end] for c in characters], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made
        self.none = np.int32(len(pairs))

    def token_names(self) -> list[str]:
        return [self.names.get(i, "") for i in range(max(self.names) + 1)]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the pair, or ``none``; negative ids are padding."""
        keys = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (b >= 0), self.rank[at], self.none)

    def _merged(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Words of at most LONG_WORD bytes, all at once: each step joins the leftmost pair of lowest rank in every word."""
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        column = np.arange(width)
        ids = np.where(column < lengths[:, None], self.inner[flat], np.int32(-1))
        ids[np.arange(len(words)), lengths - 1] = self.last[flat[np.arange(len(words)), lengths - 1]]
        ids = np.concatenate([ids, np.full((len(words), 2), -1, np.int32)], axis=1)
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        done: list[tuple[int, ...]] = [()] * len(words)
        active = np.arange(len(words))
        while len(active):
            at = rank.argmin(axis=1)
            row = np.arange(len(active))
            best = rank[row, at]
            over = best == self.none
            if over.any():
                ended = ids[over]
                for i, x in zip(active[over].tolist(), cut_up(ended[ended >= 0], (ended >= 0).sum(axis=1)), strict=True):
                    done[i] = x
                keep = ~over
                active, ids, rank, at, best = active[keep], ids[keep], rank[keep], at[keep], best[keep]
                if not len(active):
                    break
                row = np.arange(len(active))
            ids[row, at] = self.made[best]
            shift = np.arange(ids.shape[1] - 1) + (np.arange(ids.shape[1] - 1) > at[:, None])
            ids = np.concatenate([np.take_along_axis(ids, shift, 1), np.full((len(active), 1), -1, np.int32)], axis=1)
            rank = np.take_along_axis(rank, np.minimum(shift, rank.shape[1] - 1), 1)
            rank[row, at] = self.ranks(ids[row, at], ids[row, at + 1])
            before = np.maximum(at - 1, 0)
            rank[row, before] = self.ranks(ids[row, before], ids[row, before + 1])
        return done

    def _merged_long(self, word: bytes) -> tuple[int, ...]:
        """One long word with a heap over its pairs."""
        ids = [*self.inner[list(word[:-1])].tolist(), int(self.last[word[-1]])]
        after, ahead = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        ranks = self.ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != self.none]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] < len(ids):
                ahead[after[j]] = i
            for x, y in ((ahead[i], i), (i, after[i])):
                if x >= 0 and y < len(ids):
                    r = int(self.ranks(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if r != self.none:
                        heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return tuple(x for x in ids if x >= 0)

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word, merged exactly."""
        out: list[tuple[int, ...]] = [()] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        short = [i for i in order if 0 < len(words[i]) <= LONG_WORD]
        for k in range(0, len(short), MERGED_AT_ONCE):
            part = short[k : k + MERGED_AT_ONCE]
            for i, ids in zip(part, self._merged([words[i] for i in part]), strict=True):
                out[i] = ids
        for i in order[::-1]:
            if len(words[i]) <= LONG_WORD:
                break
            out[i] = self._merged_long(words[i])
        return out


def read_vocabulary(path: str) -> Merges:
    with open(path, encoding="utf-8") as f:
        return Merges(f.read())


# --- the lexicon ---------------------------------------------------------------


def compile_lexicon(words: list[bytes], ids: list[tuple[int, ...]]) -> bytes:
    """The minimal acyclic transducer of the words, as the bytes of a file to be mapped.

    Words are added in order; once a branch can't grow it is replaced by an equal
    state if there is one. The number on an edge counts the words that come
    before all those that go over it, so a path adds up to the word's place.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []  # final, edges; children come first
    register: dict[tuple, int] = {}
    letters: list[int] = []
    edges: list[dict[int, int]] = [{}]  # of the root and of the branch that may still grow
    final = [False]

    def close(depth: int) -> None:
        while len(letters) > depth:
            state = (final.pop(), tuple(edges.pop().items()))
            if state not in register:
                register[state] = len(states)
                states.append(state)
            edges[-1][letters.pop()] = register[state]

    before = b""
    for i in order:
        word = words[i]
        close(len(os.path.commonprefix([before, word])))
        for letter in word[len(letters) :]:
            letters.append(letter)
            edges.append({})
            final.append(False)
        final[-1] = True
        before = word
    close(0)
    states.append((final[0], tuple(edges[0].items())))
    below: list[int] = []  # words from each state on
    keys, to, add = [], [], []
    for at, (ends_here, out) in enumerate(states):
        passed = int(ends_here)
        for letter, child in out:
            keys.append(at << 8 | letter)
            to.append(child)
            add.append(passed)
            passed += below[child]
        below.append(passed)
    by_key = np.argsort(np.array(keys, np.int64), kind="stable")
    ends = np.array([f for f, _ in states], np.int64)
    sequences = [ids[i] for i in order]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sequences])]).astype(np.int64)
    arrays = [
        np.array(keys, np.int64)[by_key],
        np.array(to, np.int64)[by_key],
        np.array(add, np.int64)[by_key],
        ends,
        starts,
        np.fromiter(chain.from_iterable(sequences), np.int64),
    ]
    head = np.array([len(states) - 1, *map(len, arrays)], np.int64)
    return b"".join(x.tobytes() for x in [head, *arrays])


class Lexicon:
    """A compiled lexicon, read from a mapped file or from bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.root, sizes = int(data[0]), data[1:7]
        at = 7 + np.concatenate([[0], np.cumsum(sizes)])
        self.keys, self.to, self.add, self.ends, self.starts, self.ids = (data[at[i] : at[i + 1]] for i in range(6))

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, np.int64, "r"))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the table of id sequences, -1 for words that are not held."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        order = np.array(sorted(range(len(words)), key=lambda i: -len(words[i])), np.int64)
        lengths = np.array([len(words[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.full(len(order), self.root, np.int64)
        total = np.zeros(len(order), np.int64)
        for step in range(int(lengths[0])):
            live = np.flatnonzero((state >= 0) & (lengths > step))
            if not len(live):
                break
            key = state[live] << 8 | flat[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[live] = np.where(hit, self.to[at], -1)
            total[live] += self.add[at]
        good = (state >= 0) & (lengths > 0)
        good[good] = self.ends[state[good]] == 1
        out[order[good]] = total[good]
        return out

    def sequences(self, places: np.ndarray) -> list[tuple[int, ...]]:
        """Ids of the words at these places."""
        starts = self.starts[places]
        lengths = self.starts[places + 1] - starts
        shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        return cut_up(self.ids[shift + np.arange(len(shift))], lengths)


# --- Spark ---------------------------------------------------------------------


class Places(dict):
    """Number of each chunk; chunks seen for the first time get the next number and are noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = place = len(self)
        self.new.append(chunk)
        return place


class Encoder:
    """What a task needs: merges, the mapped lexicon and the ids of chunks seen lately."""

    def __init__(self, merges: Merges, lexicon: Lexicon) -> None:
        self.merges, self.lexicon = merges, lexicon
        self.clear()

    def clear(self) -> None:
        self.at = Places()
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)
        self.words: dict[str, tuple[int, ...]] = {}

    def ids_of(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Distinct words: through the lexicon, the rest merged."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        places = self.lexicon.places(raw)
        held = np.flatnonzero(places >= 0)
        out = dict(zip([words[i] for i in held], self.lexicon.sequences(places[held]), strict=True))
        unseen = np.flatnonzero(places < 0)
        out.update(zip([words[i] for i in unseen], self.merges.merge([raw[i] for i in unseen]), strict=True))
        return out

    def _learn(self) -> None:
        special = self.merges.special
        cut = [[c] if c in special else words_of(c) for c in self.at.new]
        ids = self.words
        ids.update(self.ids_of(list({w for words in cut for w in words if w not in ids} - special.keys())))
        ids.update({c: (i,) for c, i in special.items()})
        sequences = list(map(ids.__getitem__, chain.from_iterable(cut)))
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, sequences), np.int64, len(sequences)))])
        lengths = np.diff(ends[np.cumsum([0, *map(len, cut)])])
        flat = np.fromiter(chain.from_iterable(sequences), np.int32, int(ends[-1]))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, flat])
        self.at.new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each."""
        if len(self.at) > REMEMBERED:
            self.clear()
        cut = [special_chunks(t, self.merges.special) for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        chunk = np.fromiter(map(self.at.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        if self.at.new:
            self._learn()
        lengths = self.lengths[chunk]
        ends = np.cumsum(lengths)
        # Id k of the output is id (k - start of its chunk) of that chunk.
        shift = np.repeat(self.starts[chunk] - (ends - lengths), lengths)
        ids = self.ids[shift + np.arange(len(shift))]
        before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(before)


def special_chunks(text: str, special: Iterable[str]) -> list[str]:
    """Chunks, and by themselves the special tokens that the text spells out."""
    if not any(s in text for s in special):
        return chunks_of(text)
    parts = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text)
    return [c for i, part in enumerate(parts) for c in ([part] if i % 2 else chunks_of(part))]


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about BATCH_CHARS, with the place of the first."""
    start, part, size = 0, [], 0
    for i, x in enumerate(texts):
        text = x.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            yield start, part
            start, part, size = i + 1, [], 0
    if part:
        yield start, part


def word_counts(docs: DataFrame, text_col: str = "text", special: Iterable[str] = ()) -> DataFrame:
    """word, n over all whole texts; each task counts before it sends."""
    special = list(special)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words: Counter = Counter()
            for chunk, n in held.items():
                if chunk not in special:
                    for w in words_of(chunk):
                        words[w] += n
            columns = [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for text in batch.column(0):
                held.update(special_chunks(text.as_py() or "", special))
                if len(held) > REMEMBERED:
                    yield rows()
                    held.clear()
        yield rows()

    return docs.select(text_col).mapInArrow(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_file(spark: SparkSession, docs: DataFrame, merges: Merges, text_col: str, most: int) -> str:
    """Compile the most frequent words and hand the file to all executors; its name."""
    counted = staged(word_counts(docs, text_col, merges.special))
    # Words by how often they occur: the least count whose words, with all more frequent ones, still fit.
    from_top = Window.orderBy(F.desc("n"))
    by_count = counted.groupBy("n").agg(F.count("*").alias("words"))
    least = by_count.withColumn("fit", F.sum("words").over(from_top)).filter(F.col("fit") <= most).agg(F.min("n")).first()[0]
    top = counted.filter(F.col("n") >= (least or 0)) if least else counted.limit(0)
    words = [r.word.encode("utf-8") for r in top.select("word").collect()]  # at most ``most`` words
    return shared_file(spark, f"lexicon-{uuid.uuid4().hex}.bin", compile_lexicon(words, merges.merge(words)))


def shared_file(spark: SparkSession, name: str, content: bytes) -> str:
    """Write to the shared folder and have every executor, also later ones, fetch a copy; its name."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/files/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(content))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encode(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lexicon_words: int = LEXICON_WORDS,
) -> DataFrame:
    """doc_id, ids (array<int>) of every whole text.

    ``vocabulary`` is the path of a tokenizer file with word-end BPE, read once
    on the driver. Null and empty texts have no ids; special tokens that a text
    spells out get their own ids; none is added. One row per input row, repeated
    rows included; an empty table gives no rows; other columns are not looked at.
    """
    merges = read_vocabulary(vocabulary)
    name = lexicon_file(docs.sparkSession, docs, merges, text_col, lexicon_words)
    return _encoded(docs, merges, name, id_col, text_col, with_text=False)


def _encoded(
    docs: DataFrame, merges: Merges, lexicon: str, id_col: str, text_col: str, with_text: bool
) -> DataFrame:
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("decoded", pa.string())] * with_text
    shared = docs.sparkSession.sparkContext.broadcast(merges)  # the vocabulary: a fixed size of a few MB

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, Lexicon.mapped(SparkFiles.get(lexicon)))
        names = shared.value.token_names()
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                ids, lengths = encoder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column(0).slice(start, len(texts)), lists]
                if with_text:
                    columns.append(decode(lists, names))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encoded, "doc_id long, ids array<int>" + ", decoded string" * with_text)


def decode(lists: pa.Array, names: list[str]) -> pa.Array:
    """Text of each id sequence: the names of its tokens, joined by spaces."""
    tokens = list(map(names.__getitem__, lists.values.to_numpy().tolist()))
    ends = lists.offsets.to_numpy().tolist()
    known = lists.is_valid().to_numpy(zero_copy_only=False).tolist()
    texts = [" ".join(tokens[a:b]) if ok else None for a, b, ok in zip(ends, ends[1:], known, strict=False)]
    return pa.array(texts, pa.string())


def decoded(spark: SparkSession, ids: Column | str, vocabulary: str) -> Column:
    """Text of a column of id sequences; null stays null."""
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary).token_names())

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        return decode(lists, shared.value)

    return text(F.col(ids) if isinstance(ids, str) else ids)


def round_trip(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS
) -> DataFrame:
    """doc_id, ids, decoded: texts encoded, and the ids decoded again in the same pass."""
    merges = read_vocabulary(vocabulary)
    name = lexicon_file(docs.sparkSession, docs, merges, text_col, lexicon_words)
    return _encoded(docs, merges, name, id_col, text_col, with_text=True)


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``round_trip`` rows."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
