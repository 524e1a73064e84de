"""Verdicts on urls against a plain version; the Bloom filter's own promises."""

import re

import pytest
from pyspark.sql import functions as F

from sparkeval.llm import url_filter
from sparkeval.llm.common import stage

SCHEMA = "page_id long, url string, host string, path string, rule string, verdict string, kind string, name string, key string, block long, names string, id int, size int"
URLS = [
    None, "", "no scheme", "http://", "://", "https://EXAMPLE.com/en/1", "http://www.Example.com/en/2?x=1#y", "http://a.www.example.com/en/", "http://example.com/en", "http://badexample.com/en/3",
    "http://deep.net/es/1", "http://net/fr/", "http://x.net/en/", "http://host.com", "http://host.com?q=/en/", "ftp://u:p@host.org:80/a/", "http://host.org/a", "http://host.org/a?utm_source=f&ref=x", "http://host.org/a?b=2&a=1#z",
    "https://host.org/a/?a=1&b=2&utm_medium=m", "http://host.org/A", "http://one://two.com/en/", "http://example.com/en/\nline", "http://" + "a." * 2000 + "com/" + "en/" * 20_000, "http://ü.example.com/en/é", "http://net.com:8080/es/",
]
LISTED = ["https://host.org/a", "http://host.org/a?a=1&b=2", None, "nothing", "http://example.com/en/1", "http://HOST.ORG/a/"]


def rows_of(spark, urls):
    return spark.createDataFrame([(i % 7 if i else None, u, *["x"] * 7, 1, "x", 2, 3) for i, u in enumerate(urls)], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (lower(m[1]), m[2]) if m else ("", "")


def canonical(url):
    if not url or "://" not in url:
        return None
    host, path = parts(url)
    host = re.sub(r"\.?(:80|:443)?\Z", "", host.rpartition("@")[2], count=1)
    query = re.match(r"(?s)[^?#]*\?([^#]*)", url)
    fields = sorted({x for x in (query[1] if query else "").split("&") if x and not re.match(url_filter.TRACKING, x)})
    return host + path.rstrip("/") + ("?" + "&".join(fields) if fields else "")


def brute(urls, rules, listed):
    on_list = {canonical(u) for u in listed} - {None}
    out = []
    for url in urls:
        host, path = parts(url)
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, None))
        out.append((url, host, path, best[2], best[3] or ("block" if canonical(url) in on_list else "allow")))
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [url_filter.MOST_BLOCKS, 1])
def test_against_plain_version(spark, blocks, monkeypatch):
    """With one block the filter lets everything through in the end, and the exact join alone decides; without broadcasts it shuffles."""
    rules = [*url_filter.RULES, ("allow", "host.org", "/a/b"), ("block", "b.c", "/xx"), ("allow", "a.b.c", "/"), ("block", "net.com:8080", "")]
    rules += [("block", f"h{i}.org", f"/p{i}/") for i in range(200)]
    urls = [*URLS, *URLS[5:9], "http://a.b.c/xx", "http://z.a.b.c/xx", "http://h7.org/p7/x", "http://h7.org/p8/x"]
    if blocks == 1:
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", -1)
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    source = rows_of(spark, urls)
    got = url_filter.judge(source, table, listed, most_blocks=blocks).collect()
    want = brute(urls, rules, LISTED)
    assert sorted(((r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted((w[1:] for w in want), key=str)
    assert {v for *_, v in want} == {"allow", "block"} and sorted(str(r.id) for r in got) == sorted(str(r.page_id) for r in source.collect())


def test_empty_tables(spark):
    rules, none = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string"), spark.createDataFrame([], "url string")
    assert url_filter.judge(rows_of(spark, []), rules, none).count() == 0
    assert {r.verdict for r in url_filter.judge(rows_of(spark, URLS), rules.limit(0), none).collect()} == {"allow"}
    every = url_filter.judge(rows_of(spark, URLS), rules.limit(0), rows_of(spark, URLS))
    assert {(r.host == "", r.verdict) for r in every.where("host not like '%com%'").collect()} >= {(False, "block")}


def test_filter_forgets_no_key_and_lets_few_others_through(spark):
    """False positives are about 1 in 700 at 16 bits a key; with a smaller bound there are more, and still no key is lost."""
    keys, others = (spark.range(20_000).select(F.concat(F.lit(p), F.col("id")).alias("key")) for p in ("k", "o"))
    for most, limit in ((url_filter.MOST_BLOCKS, 60), (300, 20_000)):
        held, blocks = url_filter.bloom_filter(keys, 20_000, most_blocks=most)
        held = stage(held, "bloom")
        assert held.count() <= blocks <= most
        assert url_filter.may_hold(keys, held, blocks).count() == 20_000
        assert url_filter.may_hold(others, held, blocks).count() <= limit


def test_shapes_follow_how_rules_are_written(spark):
    rules = spark.createDataFrame([("block", f"h{i}.org", f"/{i % 10}/") for i in range(500)] + [("allow", "a.b.c", "/x"), ("allow", "", "/"), ("allow", "x", None)], "verdict string, host string, path string")
    assert url_filter.rule_shapes(rules) == [(2, 3), (3, 2)]
