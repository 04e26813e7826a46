import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from llm.edge_rows import ROWS, documents
from tokenizers import Tokenizer

from renderscope.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return bpe.read_vocabulary(PATH)


def lexicon(merges, words):
    return bpe.Lexicon(np.frombuffer(bpe.compile_lexicon(words, merges.merge(words)), np.int64))


def encoded(encoder, texts):
    ids, lengths = encoder.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]


@pytest.mark.parametrize("held", [0, 500])
def test_texts_like_the_library(library, merges, held):
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(32, 127)] * 3 + [*range(0xA0, 0x250)]] + list("ΣİΆ̀　\x1c\x85😀中ﬁ٠½ՙᲉ\U00010d50")
    pool += ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "  ", "\n"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(4000)]
    texts += [" ".join(rng.choices(["the", "of", "theing", "onheer", "déjà", "3.14"], k=50)) for _ in range(50)]
    texts += ["a" * 5000, "ab" * 3000 + "'s", "", "ÀB" * 1000, *[r[1] or "" for r in ROWS]]
    words = sorted({w.encode() for t in texts for w in bpe.words_of(t)})
    encoder = bpe.Encoder(merges, lexicon(merges, words[:held]))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(encoder, texts) == want
    assert encoded(encoder, texts) == want  # now from what the task remembers


def test_every_character_is_cut_like_the_library(library):
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        text = f"a{chr(c)}1"
        want = [t for t, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
        if c % 7 == 0 or c < 0x3000:
            got = bpe.words_of(text)
            assert [len(w.encode()) for w in got] == [len(w) for w in want], hex(c)


def test_automaton_is_minimal_and_complete(merges):
    words = sorted({f"{a}{b}{c}".encode() for a in ("un", "re", "") for b in ("walk", "talk", "do") for c in ("ing", "s", "")})
    held = lexicon(merges, words)
    places = held.places([*words, b"walkin", b"walkings", b"", b"zzz"])
    assert sorted(places[: len(words)].tolist()) == list(range(len(words)))
    assert (places[len(words) :] == -1).all()
    assert held.sequences(places[: len(words)]) == merges.merge(words)
    # A state is minimal if no other has the same right language.
    edges = {}
    for key, to in zip(held.keys.tolist(), held.to.tolist(), strict=True):
        edges.setdefault(key >> 8, []).append((key & 255, to))
    states = [(held.ends[s], tuple(edges.get(s, []))) for s in range(len(held.ends))]
    assert len(set(states)) == len(states) < sum(map(len, words))


def test_round_trip(spark, library):
    docs = documents(spark, "ids string")
    got = bpe.digests(bpe.round_trip(docs, PATH, lexicon_words=20)).collect()
    want = []
    for r in ROWS:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(docs.limit(0), PATH).collect() == []
    again = bpe.encode(docs, PATH).select(bpe.decoded(spark, "ids", PATH).alias("d")).collect()
    assert len(again) == len(ROWS)
