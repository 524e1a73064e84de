"""Verdicts on urls from lists, by a blocked Bloom filter and an exact join.

A url stands for a few keys: its canonical form, and a host suffix with the start of its path for each shape that the rules have. A blocked Bloom filter
of all listed keys (a key's eight bits lie in one block of 256) lets through the keys that may be listed; an exact hash join on the key
itself removes its false positives. The filter is at most MOST_BLOCKS blocks, which bounds what is broadcast: a list that outgrows it makes the
filter let through more, never less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeval.llm.common import BROADCAST_BYTES, read, small, stage

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^[^?#]*\?([^#]*)"
TRACKING = r"^(utm_[^=]*|gclid|fbclid|msclkid|ref)(=|$)"
BITS_A_KEY, MOST_BLOCKS = 16, 1 << 18  # blocks of 256 bits: 8 MB
WORDS = 8  # words of 32 bits in a block, one bit of each for a key
FACTORS = [pow(0x9E3779B1, 2 * i + 1, 1 << 31) for i in range(1, WORDS + 1)]  # odd, and no steps of each other

# fixed rules of the query: verdict, host, path
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
# words of a host's names that put its urls on the query's list
LISTED_HOSTS = r"(^|[.-])(spam|pills|casino|viagra)([.-]|$)"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? or #, A-Z in lower case; empty without any."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), *LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def canonical(url: Column) -> Column:
    """A url's host without user, standard port and last dot, its path without last slashes, and its query without tracking fields, sorted; no scheme,
    no fragment. Null for a null url or one without ://."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^.*@", ""), r"\.?(:80|:443)?$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    fields = F.split(F.regexp_extract(url, QUERY, 1), "&")
    kept = F.array_sort(F.array_distinct(F.filter(fields, lambda x: (x != "") & ~x.rlike(TRACKING))))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, query))


def _bits(key: Column, blocks: int) -> list[Column]:
    """The block of a key's hash and its masks: two words of 32 bits in each of four longs, a bit set in either."""
    h = F.xxhash64(key)
    low = F.shiftrightunsigned(h, 32)
    block = F.shiftrightunsigned(h.bitwiseAND(0xFFFFFFFF) * F.lit(blocks).cast("long"), 32)
    one = F.lit(1).cast("long")
    at = [F.shiftright((low * F.lit(f)).bitwiseAND(0xFFFFFFFF), 27).cast("int") for f in FACTORS]
    masks = [F.call_function("shiftleft", one, at[i]).bitwiseOR(F.call_function("shiftleft", one, at[i + 1] + 32)) for i in range(0, WORDS, 2)]
    return [block.alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(masks)]]


def bloom_filter(keys: DataFrame, n: int, bits: int = BITS_A_KEY, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, int]:
    """The blocks that hold bits (block and four longs of two words each) and the number of blocks, for the n rows of `key`; blocks are filled where keys are and then merged."""
    blocks = min(most_blocks, max(1, n * bits // 256 + 1))
    held = keys.select(*_bits(F.col("key"), blocks)).groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"f{i}") for i in range(WORDS // 2)])
    return held, blocks


def may_hold(rows: DataFrame, held: DataFrame, blocks: int) -> DataFrame:
    """The rows whose `key` may be in the filter, each once; rows without are left out."""
    names = [f"m{i}" for i in range(WORDS // 2)]
    probed = rows.select(*rows.columns, *_bits(F.col("key"), blocks)).join(F.broadcast(held), "block")  # at most MOST_BLOCKS rows of 40 bytes
    for i, m in enumerate(names):
        probed = probed.where(F.col(f"f{i}").bitwiseAND(F.col(m)) == F.col(m))
    return probed.select(*rows.columns)


def listed_keys(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """kind, name, host_size, size and verdict of every rule (kind rule, name host and path) and of every listed url (kind url, name its canonical form), each once.

    Of rules with one host and path the block stays.
    """
    host = F.translate(F.col("host"), *LOWER)
    host_size = F.char_length(host)
    r = rules.where("host <> '' and path is not null").select(F.lit("rule").alias("kind"), F.concat(host, "path").alias("name"), host_size.alias("host_size"), "verdict")
    r = r.groupBy("kind", "name", "host_size").agg(F.max("verdict").alias("verdict"))
    u = listed.select(F.lit("url").alias("kind"), canonical(F.col("url")).alias("name"), F.lit(0).alias("host_size"), F.lit("block").alias("verdict"))
    return r.unionByName(u.where("name is not null").distinct()).withColumn("size", F.char_length("name"))


def rule_shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """The different pairs of names in a host and characters in a path that rules have: a property of how rules are written, not of how many there are."""
    r = rules.where("host <> '' and path is not null").select(F.size(F.split("host", r"\.")).alias("names"), F.char_length("path").alias("start"))
    return sorted((x.names, x.start) for x in r.distinct().collect())


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", bits: int = BITS_A_KEY, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """id, host, path, rule, verdict and listed of every row of pages.

    rules: verdict (allow or block), host, path. A rule fits its host and all its subdomains where the path starts with the rule's; the longest one
    decides, of equally long ones that of the longer host. Where none fits, a url whose canonical form is in `listed` (column url) is blocked, any other
    allowed. Null urls and those without :// have empty host and path and are allowed. Repeated rows are judged each; empty tables of pages, rules or
    listed urls are in order; other columns are not looked at.
    """
    url = F.col(f"`{url_col}`")
    source = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    keys = stage(listed_keys(rules, listed), "url_keys")
    sums = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("name") + 64), F.lit(0)).alias("bytes")).first()
    whole = F.concat_ws(" ", "kind", "host_size", "name").alias("key")
    held, blocks = bloom_filter(keys.select(whole), sums.n, bits, most_blocks)
    held = stage(held, "url_bloom")

    names = F.split("host", r"\.")
    own = [F.struct(F.lit("url").alias("kind"), canonical(F.col("url")).alias("name"), F.lit(0).alias("host_size"))]
    for n, start in rule_shapes(rules):
        suffix = F.array_join(F.slice(F.col("names"), -n, n), ".")
        fits = (F.size("names") >= n) & (F.char_length("path") >= start)
        own.append(F.struct(F.lit("rule").alias("kind"), F.when(fits, F.concat(suffix, F.substring("path", 1, start))).alias("name"), F.char_length(suffix).alias("host_size")))
    asked = source.where("host <> ''").withColumn("names", names).select("url", F.inline(F.array(*own)).alias("kind", "name", "host_size")).where("name is not null")
    asked = may_hold(asked.select("*", whole), held, blocks)
    exact = small(keys, 1, sums.bytes) if sums.bytes <= BROADCAST_BYTES else keys.hint("shuffle_hash")
    hits = asked.join(exact, ["kind", "name", "host_size"])
    rule = F.col("kind") == "rule"
    best = hits.groupBy("url").agg(
        F.max(F.when(rule, F.struct("size", "host_size", F.col("name").alias("rule"), "verdict"))).alias("best"), F.max(~rule).alias("listed"))
    best = stage(best.select("url", "best.rule", F.col("best.verdict").alias("ruled"), "listed"), "url_verdicts")
    found = best.agg(F.coalesce(F.sum(F.octet_length("url") + 128), F.lit(0)).alias("bytes")).first().bytes
    out = source.join(small(best, 1, found), "url", "left")
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"))


def hosts_with(pages: DataFrame, words: str, url_col: str = "url") -> DataFrame:
    """url of the pages whose host has one of the words as a name or a part of one."""
    return pages.select(F.col(f"`{url_col}`").alias("url")).where(host_of(F.col("url")).rlike(words))


def op13_url_filter(spark, sf_dir: str) -> DataFrame:
    """No table holds a list of urls: it is that of the pages on hosts with words of spam in their names."""
    pages = read(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    out = judge(pages, rules, hosts_with(pages, LISTED_HOSTS))
    return out.withColumnRenamed("id", "page_id")


_CANONICAL = r"""CASE WHEN instr(url, '://') > 0 THEN regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:80|:443)?$', '') || regexp_replace(path, '/+$', '')
  || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(list_sort(list_distinct(fields)), '&') ELSE '' END END"""
OP13_SQL = rf"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{LOWER[0]}', '{LOWER[1]}') AS host, regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path,
  list_filter(string_split(regexp_extract(coalesce(url, ''), '{QUERY}', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}')) AS fields FROM pages),
c AS (SELECT *, {_CANONICAL} AS canonical FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '{LISTED_HOSTS}')),
r AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}) AS t(ruled, rule_host, rule_path)),
f AS (SELECT page_id, url, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(ruled, length(rule_host || rule_path)) AS ruled
      FROM (SELECT DISTINCT page_id, url, host, path FROM c) JOIN r ON suffix('.' || host, '.' || rule_host) AND starts_with(path, rule_path) GROUP BY page_id, url)
SELECT c.page_id, host, path, rule, coalesce(ruled, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canonical IS NOT NULL AS listed
FROM c LEFT JOIN l ON c.canonical = l.canonical LEFT JOIN f ON f.page_id IS NOT DISTINCT FROM c.page_id AND f.url = c.url
"""
