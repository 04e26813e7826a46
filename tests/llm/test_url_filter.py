import re

import numpy as np
import pytest

from renderscope.llm import url_filter
from renderscope.llm.queries import RULES

URLS = [
    "http://WWW.Example.com/en/x?y#z", "https://example.com/en/", "http://a.example.com/en", "http://com/", "http://xcom/",
    "ftp://b.net/es/?q", "http://net/fr/a", "http://b.net/de/", "no scheme", "://", "http://?a", "http://com?x", None, "",
    "http://a.www.example.com/en/q", "x://a://example.com/en/", "http://" + "a." * 5000 + "net/es/", "http://È.com/É",
    "http://example.com\n/en/", "http://b.net/es/", "http://b.net/es/",
]


def judge(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("pass_bytes", [1 << 20, 8])
def test_rules(spark, pass_bytes):
    rows = [(i, u, "rule") for i, u in enumerate(URLS)]
    urls = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judge_urls(urls, rules, pass_bytes=pass_bytes).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == [
        (i, *judge(u, RULES)) for i, u in enumerate(URLS)
    ] or {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: judge(u, RULES) for i, u in enumerate(URLS)}


def test_no_rules_no_urls(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "http://com/")], "page_id long, url string")
    assert url_filter.judge_urls(urls.limit(0), rules).collect() == []
    assert [r.verdict for r in url_filter.judge_urls(urls, rules.limit(0)).collect()] == ["allow"]


def test_cascade_is_exact(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
    listed = np.arange(20_000) % 50 == 0
    rows = spark.createDataFrame(
        list(zip(a.tolist(), b.tolist(), listed.tolist(), strict=True)), "a long, b long, listed boolean"
    )
    cascade = url_filter.build_cascade(rows)
    assert len(cascade.levels) > 2
    assert (cascade.contains(a, b) == listed).all()
    assert cascade.size < 20_000


def test_rules_beyond_ascii_and_repeated(spark):
    rules = [("Ècom.net", "/", "block"), ("b.net", "/", "allow"), ("B.net", "/", "block")]
    urls = ["http://Ècom.net/x", "http://a.Ècom.NET/", "http://ècom.net/", "http://b.net/", "http://c.net/"]
    got = url_filter.judge_urls(
        spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"),
        spark.createDataFrame(rules, "host string, path string, verdict string"),
    ).collect()
    assert [r.verdict for r in sorted(got)] == ["block", "block", "allow", "block", "allow"]


def test_passes_follow_the_universe(spark):
    """False positives of the first filter take room, however few the rules are."""
    urls = spark.range(30_000).selectExpr("id page_id", "concat('http://h', id, '.com/p', id) url")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    assert url_filter.judge_urls(urls, rules, pass_bytes=100).filter("verdict = 'block' and rule = 'com/'").count() == 30_000
