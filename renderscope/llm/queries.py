"""Registered queries of the training-data operators, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renderscope.llm import (
    bpe,
    exact_dedup,
    lm_score,
    mixing,
    near_dedup,
    neighbours,
    packing,
    periodic,
    phrases,
    quality,
    token_counts,
    url_filter,
    warc,
)
from renderscope.session import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op1_exact_dedup",
    f"""
    WITH t AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS norm FROM documents),
    g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
    SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
    FROM t JOIN g ON t.norm = g.norm
    """,
)
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.duplicate_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query(
    "op2_url_filter",
    f"""
    WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
    parts AS (
        SELECT page_id,
            {LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
        FROM pages
    ),
    judged AS (
        SELECT p.page_id, p.host, p.path, (
            SELECT arg_max({{'rule': r.host || r.path, 'verdict': r.verdict}}, length(r.host || r.path)) FROM rules r
            WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        ) AS hit
        FROM parts p
    )
    SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM judged
    """,
)
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, folder, "pages"), rules)


@query(
    "op4_warc_round_trip",
    """
    WITH t AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS bytes FROM pages),
    g AS (SELECT html, max(page_id) AS newest FROM t WHERE bytes >= 1000 GROUP BY html)
    SELECT t.page_id, t.bytes AS payload_bytes, sha1(t.html) AS payload_digest,
        CASE WHEN t.page_id < g.newest THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN t.page_id < g.newest THEN g.newest END AS refers_to
    FROM t LEFT JOIN g ON t.html = g.html
    """,
)
def op4_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    back = warc.round_trip(table(spark, folder, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _nearer_sql(cells: str, out: str) -> str:
    return f"""{out}_gap AS (SELECT source, any_value(target) - sum((n * base + more) * size) AS gap FROM {cells} GROUP BY source),
    {out}_best AS (
        SELECT c.source, min({{'off': abs(c.size - abs(gap)), 'size': c.size}}).size AS size
        FROM {cells} c JOIN {out}_gap g ON c.source IS NOT DISTINCT FROM g.source
        WHERE abs(c.size - abs(gap)) < abs(gap) AND CASE WHEN gap > 0 THEN more < n AND base < 3 ELSE more > 0 END
        GROUP BY c.source
    ),
    {out} AS (
        SELECT c.* REPLACE (more + CASE WHEN c.size = b.size THEN sign(gap)::BIGINT ELSE 0 END AS more)
        FROM {cells} c JOIN {out}_gap g ON c.source IS NOT DISTINCT FROM g.source
            LEFT JOIN {out}_best b ON c.source IS NOT DISTINCT FROM b.source
    )"""


@query(
    "op8_source_mix",
    rf"""
    WITH RECURSIVE sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
    ),
    cells AS (SELECT source, size, count(*) AS n FROM sized GROUP BY ALL),
    ranked AS (
        SELECT source, sum(n * size) AS c, max(size) AS largest,
            [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM cells GROUP BY source
    ),
    ordered AS (SELECT *, 3.0::DOUBLE * c / weight AS full_at FROM ranked),
    levels AS (
        SELECT *, (sum(c) OVER () - coalesce(sum(3.0::DOUBLE * c) OVER before, 0)) / sum(weight) OVER rest AS level FROM ordered
        WINDOW before AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            rest AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ),
    aims AS (
        SELECT source, c, largest, CASE WHEN full_at <= lambda0 THEN 3.0::DOUBLE * c ELSE weight * lambda0 END AS target
        FROM levels, (SELECT max(level) AS lambda0 FROM levels WHERE level <= full_at)
    ),
    lists AS (
        SELECT a.*, a.c = 0 OR a.target >= 3.0::DOUBLE * a.c AS is_full, l.sizes, l.ns
        FROM aims a JOIN (SELECT source, list(size ORDER BY size) AS sizes, list(n ORDER BY size) AS ns FROM cells GROUP BY source) l
            ON a.source IS NOT DISTINCT FROM l.source
    ),
    halving AS (
        SELECT source, 0 AS k, least(0.0::DOUBLE, largest * ln(target / c)) AS lo, largest * ln(3.0::DOUBLE) AS hi FROM lists WHERE NOT is_full
        UNION ALL
        SELECT source, k + 1, CASE WHEN over THEN lo ELSE mid END, CASE WHEN over THEN mid ELSE hi END FROM (
            SELECT h.source, h.k, h.lo, h.hi, (h.lo + h.hi) / 2 AS mid,
                list_sum(list_transform(range(1, len(l.sizes) + 1),
                    lambda j: l.ns[j] * l.sizes[j] * least(3.0::DOUBLE, exp((h.lo + h.hi) / 2 * l.sizes[j] / l.largest)))) > l.target AS over
            FROM halving h JOIN lists l ON h.source IS NOT DISTINCT FROM l.source WHERE h.k < 90
        )
    ),
    rates AS (
        SELECT c.*, a.c AS source_size, a.target,
            CASE WHEN a.is_full THEN 3.0::DOUBLE WHEN c.size > 0 THEN least(3.0::DOUBLE, exp((h.lo + h.hi) / 2 * c.size / a.largest)) ELSE 0.0::DOUBLE END AS rate
        FROM cells c JOIN lists a ON c.source IS NOT DISTINCT FROM a.source
            LEFT JOIN (SELECT * FROM halving WHERE k = 90) h ON c.source IS NOT DISTINCT FROM h.source
    ),
    due AS (
        SELECT *, floor(rate)::BIGINT AS base,
            floor(sum(((rate - floor(rate)) * n)::DECIMAL(38, 12)) OVER (PARTITION BY source ORDER BY size) + 0.5)::BIGINT AS due FROM rates
    ),
    first_plan AS (SELECT * EXCLUDE (due), due - coalesce(lag(due) OVER (PARTITION BY source ORDER BY size), 0) AS more FROM due),
    {_nearer_sql("first_plan", "second_plan")},
    {_nearer_sql("second_plan", "plan")},
    placed AS (
        SELECT d.doc_id, d.size, p.source_size, p.target, p.base, p.more, row_number() OVER (PARTITION BY d.source, d.size ORDER BY turn % ceil(n / {mixing.RANK_ROWS})::BIGINT, turn, doc_id) AS place
        FROM (SELECT *, ('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS turn FROM sized) d
            JOIN plan p ON d.source IS NOT DISTINCT FROM p.source AND d.size = p.size
    )
    SELECT doc_id, size, source_size::BIGINT AS source_size, target,
        CASE WHEN size > 0 THEN (base + (place <= more)::BIGINT) * size ELSE 0 END::BIGINT AS taken FROM placed
    """,
)
def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    lengths = token_counts.token_lengths(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return token_counts.by_limit(staged(token_counts.length_histogram(lengths)))  # texts are encoded once


@query("op10_bpe_round_trip")
def op10_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    rows = bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(rows)


@query("op9_quality")
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_near_dedup")
def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op3_lm_score")
def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.language_scores(table(spark, folder, "documents"))


@query(
    "op7_nearest",
    """
    WITH v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.e, c.e) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored QUALIFY rank <= 5
    """,
)
def op7_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, folder, "documents"), planted=True)


@query("op12_best_fit_packing")
def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query(
    "op13_phrase_collocations",
    rf"""
    WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, {LOWER.format("coalesce(text, '')")} AS t FROM documents),
    pieces AS (
        SELECT d, lang, generate_subscripts(p, 1) AS j, unnest(p) AS piece
        FROM (SELECT d, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS p FROM docs)
    ),
    pieced AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    grams AS (
        SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, w[i : i + k - 1] AS ws
        FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieced), (VALUES (1), (2), (3)) AS ks(k)
        WHERE i + k - 1 <= len(w)
    ),
    counts AS (SELECT lang, k, phrase, any_value(ws) AS ws, count(*) AS f FROM grams GROUP BY lang, k, phrase),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
    often AS MATERIALIZED (SELECT * FROM counts WHERE f >= 10),
    parted AS MATERIALIZED (
        SELECT lang, phrase, k, f AS a, j, array_to_string(ws[1 : j], ' ') AS head, array_to_string(ws[j + 1 :], ' ') AS rest
        FROM (SELECT *, unnest(range(1, k)) AS j FROM often WHERE k >= 2)
    ),
    cuts AS (
        SELECT c.lang, c.phrase, c.k, c.a, x.f AS l, y.f AS r, c.j, ((c.a::HUGEINT * c.a * 1000000) // (x.f::HUGEINT * y.f))::BIGINT AS score
        FROM parted c JOIN often x ON x.lang = c.lang AND x.phrase = c.head JOIN often y ON y.lang = c.lang AND y.phrase = c.rest
    ),
    scored AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS worst FROM cuts QUALIFY worst = 1),
    inside AS (
        SELECT lang, array_to_string(ws[s : s + 1], ' ') AS phrase, max(f) AS longer
        FROM often, (VALUES (1), (2)) AS starts(s) WHERE k = 3 GROUP BY ALL
    )
    SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score
    FROM scored s JOIN totals USING (lang) LEFT JOIN inside i ON s.lang = i.lang AND s.phrase = i.phrase
    WHERE i.longer IS NULL OR 100 * i.longer < 50 * a
    QUALIFY rank <= 2000
    """,
)
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))
