"""URL rules held in a cascade of Bloom filters.

Every key that a url of the corpus can match (host suffix + path prefix, as
long as some rule) is known, so membership can be made exact: the first filter
holds the listed keys, the second the unlisted corpus keys that the first one
lets through, the third the listed keys that the second one lets through, and
so on until nothing slips through. A key is listed exactly if it fails first at
an even level. Judging a url is then a handful of bit tests: no join, no
shuffle. Two cascades answer: is this key a rule, and does that rule block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renderscope.llm.common import UPPER, ascii_lower
from renderscope.session import staged

#: Most bytes of one cascade that goes to every executor; longer lists are held in several, one pass each.
PASS_BYTES = 64 << 20
FIRST_RATE = 1 / 64
NEXT_RATE = 1 / 2
#: Fixed seeds of the two hashes whose sums give the probe places.
SEEDS = (11, 29)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(text, pattern, 2)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), key) for seed in SEEDS]


def _places(a: np.ndarray, b: np.ndarray, level: int, bits: int, probes: int) -> np.ndarray:
    """Probe places, (keys, probes); every level has places of its own."""
    a, b = a.view(np.uint64), b.view(np.uint64) | np.uint64(1)
    step = np.arange(probes, dtype=np.uint64) + np.uint64(level * 64 + 1)
    mixed = a[:, None] + b[:, None] * step[None, :]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return (mixed % np.uint64(bits)).astype(np.int64)


@dataclass
class Level:
    bits: int
    probes: int
    words: np.ndarray = field(repr=False)

    def passes(self, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
        places = _places(a, b, level, self.bits, self.probes)
        return ((self.words[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


@dataclass
class Cascade:
    levels: list[Level]

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe it was built over; ``a``, ``b`` are the keys' hashes."""
        listed = np.zeros(len(a), bool)
        alive = np.arange(len(a))
        for i, level in enumerate(self.levels):
            if not len(alive):
                break
            passed = level.passes(a[alive], b[alive], i)
            # Out at an odd filter: not listed; out at an even one: listed. Those that pass all agree with the last.
            listed[alive] = passed if i % 2 == 0 else ~passed
            alive = alive[passed]
        return listed

    @property
    def size(self) -> int:
        return sum(level.words.nbytes for level in self.levels)


def _shape(n: int, rate: float) -> tuple[int, int]:
    bits = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(n, 1) * math.log(2)))


def _filter_of(keys: DataFrame, n: int, level: int, rate: float) -> Level:
    """The bits of all keys, gathered word by word: the driver sees the finished filter only."""
    bits, probes = _shape(n, rate)
    probes = min(probes, 16)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def places(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(_places(a.to_numpy(), b.to_numpy(), level, bits, probes)))

    at = F.col("at")
    rows = (
        keys.select(F.explode(places("a", "b")).alias("at"))
        .groupBy(F.shiftright(at, 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    )
    words = np.zeros(-(-bits // 64), np.uint64)
    got = rows.toPandas()
    words[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return Level(bits, probes, words)


def _passing(keys: DataFrame, level: Level, at: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)  # bounded by PASS_BYTES

    @F.pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(shared.value.passes(a.to_numpy(), b.to_numpy(), at))

    return keys.filter(passes("a", "b"))


def build_cascade(universe: DataFrame, most_levels: int = 64) -> Cascade:
    """``universe``: distinct key hashes a, b and the flag listed. Rows stay on the executors."""
    sides = [universe.filter("listed").select("a", "b"), universe.filter("not listed").select("a", "b")]
    levels: list[Level] = []
    left = sides[0].count()
    while left:
        if len(levels) == most_levels:
            raise RuntimeError("the cascade does not end: two keys share both hashes")
        i = len(levels)
        mine, other = sides[i % 2], sides[1 - i % 2]
        levels.append(_filter_of(mine, left, i, FIRST_RATE if i == 0 else NEXT_RATE))
        sides[1 - i % 2] = staged(_passing(other, levels[-1], i))
        left = sides[1 - i % 2].count()
    return Cascade(levels)


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Keys that could be rules, longest first: host suffixes of so many labels, path prefixes of so many characters."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    keys = []
    for n in labels:
        suffix = F.when(dots >= n - 1, F.substring_index(host, ".", -n))
        for size in lengths:
            keys.append(F.when(F.length(path) >= size, F.concat(suffix, F.left(path, F.lit(size)))))
    keys = F.array_compact(F.array(*keys))
    return F.array_sort(
        keys,
        lambda x, y: F.when(F.length(x) > F.length(y), F.lit(-1))
        .when(F.length(x) < F.length(y), F.lit(1))
        .when(x < y, F.lit(-1))
        .when(x > y, F.lit(1))
        .otherwise(F.lit(0)),
    )


def _shape_of_rules(rules: DataFrame) -> tuple[list[int], list[int]]:
    """Label counts of the hosts and lengths of the paths among the rules: two short lists."""
    dots = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit("")))
    labels = [r[0] for r in rules.select(dots + 1).distinct().orderBy(F.desc(dots + 1)).collect()]
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().orderBy(F.desc(F.length("path"))).collect()]
    return labels, lengths


def judge_urls(
    urls: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """One row per url: id, host, path, rule, verdict.

    ``rules``: host, path, verdict ('allow' or 'block'), one row per (host, path);
    a rule fits its host and all subdomains where the path starts with the
    rule's, and the longest wins. A url that no rule fits is not listed, hence
    allowed. Null urls and urls without ``://`` have empty host and path and fit
    none. Hosts of rules are lower-cased like those of urls, A-Z only; of rules with
    one key, a blocking one holds. Repeated rows are judged alike, empty input gives no rows, other
    columns are not looked at. A list too long for one cascade of
    ``pass_bytes`` is split by key hash into several, one pass over the urls each.
    """
    host, path = split_url(F.col(url_col))
    parts = urls.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rules = staged(rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict"))
    n_rules = rules.count()
    if not n_rules:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    labels, lengths = _shape_of_rules(rules)
    keyed = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths))
    a, b = _hashes(F.col("key"))
    listed = rules.select(F.concat("host", "path").alias("key"), F.lit(True).alias("listed"), (F.col("verdict") == "block").alias("blocks"))
    corpus = keyed.select(F.explode("keys").alias("key"))
    # The universe: each key of the corpus and of the list once, map-side combined.
    universe = staged(
        corpus.select("key", F.lit(False).alias("listed"), F.lit(False).alias("blocks"))
        .union(listed)
        .groupBy("key")
        .agg(F.max("listed").alias("listed"), F.max("blocks").alias("blocks"))
        .select(a.alias("a"), b.alias("b"), "listed", "blocks")
    )
    # The second filter holds what the first lets through by mistake: a part of the universe, however few the rules.
    mistaken = math.ceil(universe.count() * FIRST_RATE)
    bits = _shape(n_rules, FIRST_RATE)[0] + 2 * _shape(mistaken, NEXT_RATE)[0]  # twice: later filters are smaller
    passes = max(1, math.ceil(bits / 8 / pass_bytes))
    names = ["rule", "blocks"]
    judged = keyed.withColumns({"rule": F.lit(None).cast("string"), "blocks": F.lit(False)})
    for i in range(passes):
        share = universe.filter(F.pmod("a", F.lit(passes)) == i)
        known = build_cascade(share)
        blocking = build_cascade(share.filter("listed").select("a", "b", F.col("blocks").alias("listed")))
        judged = _judged(judged, known, blocking, passes, i)
    if passes > 1:
        judged = judged.select("page_id", "host", "path", *names)
    return judged.select(
        "page_id", "host", "path", "rule", F.when(F.col("blocks"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict")
    )


def _judged(rows: DataFrame, known: Cascade, blocking: Cascade, passes: int, share: int) -> DataFrame:
    """Longest listed key of each row so far, by bit tests in Arrow batches."""
    shared = rows.sparkSession.sparkContext.broadcast((known, blocking))

    @F.pandas_udf("struct<at:int, blocks:boolean>")
    def first_listed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known, blocking = shared.value
        for xs, ys in batches:
            counts = xs.map(len).to_numpy(np.int64)
            a = np.concatenate([np.empty(0, np.int64), *xs]).astype(np.int64)
            b = np.concatenate([np.empty(0, np.int64), *ys]).astype(np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
            mine = known.contains(a, b) & (a % passes == share)
            row, place, hit = row[mine], place[mine], np.flatnonzero(mine)
            first = np.unique(row, return_index=True)[1] if len(row) else np.empty(0, np.int64)
            at = np.full(len(counts), -1, np.int32)
            blocks = np.zeros(len(counts), bool)
            at[row[first]] = place[first]
            blocks[row[first]] = blocking.contains(a[hit[first]], b[hit[first]])
            yield pd.DataFrame({"at": at, "blocks": blocks})

    hashes = [F.transform("keys", lambda k: _hashes(k)[0]), F.transform("keys", lambda k: _hashes(k)[1])]
    found = F.col("found")
    key = F.when(found["at"] >= 0, F.get("keys", found["at"]))
    longer = key.isNotNull() & (F.col("rule").isNull() | (F.length(key) > F.length("rule")))
    return (
        rows.withColumn("found", first_listed(*hashes))
        .withColumn("blocks", F.when(longer, found["blocks"]).otherwise(F.col("blocks")))
        .withColumn("rule", F.when(longer, key).otherwise(F.col("rule")))
        .drop("found")
    )
