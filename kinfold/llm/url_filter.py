"""URL filtering: host and path rules, then a blocked Bloom filter before an exact hash join.

The list of blocked canonical URLs becomes a blocked Bloom filter: a table of 64-bit
blocks, one row a block, where each URL sets four bits of the one block that its hash
names. Only URLs whose four bits are set go on to the exact join with the list, so the
filter saves the shuffle of all others and its false positives never show in a verdict.

Size: the filter takes 16 bits a listed URL, in blocks of 16 bytes (number and word). It is
broadcast up to ``BROADCAST_BLOCKS`` blocks (16 MB); a longer list gets a filter that is
joined by block number instead.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and
the verdict ``allow``; repeated rows are judged each; an empty list allows all that no
rule blocks. Only ``page_id`` and ``url`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stage, table

BROADCAST_BLOCKS = 1_000_000
URLS_PER_BLOCK = 4

#: The rules of the contract (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Query parameters that do not name a page.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=.*)?$"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without last slashes, sorted query without tracking; null if no URL."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    whole = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(url.contains("://"), whole)


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, by host length and then path length."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _mask(key: Column) -> Column:
    """Four bits of a 64-bit word, from a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def bloom_table(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    return keys.groupBy(_block(F.col(key), n_blocks).alias("_block")).agg(F.bit_or(_mask(F.col(key))).alias("_word"))


def listed(urls: DataFrame, url: str, blocked: DataFrame, key: str) -> DataFrame:
    """``urls`` and a boolean ``_listed``: its canonical URL is one of ``blocked[key]``."""
    want = stage(blocked.select(F.col(key).alias("_key")).where("_key is not null").distinct(), "url-list")
    n = want.count()
    n_blocks = max(1, -(-n // URLS_PER_BLOCK))
    bloom = bloom_table(want, "_key", n_blocks)
    if n_blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    keyed = urls.withColumn("_ckey", canonical(F.col(url))).withColumn("_block", _block(F.col("_ckey"), n_blocks))
    maybe = F.col("_ckey").isNotNull() & F.coalesce(F.col("_word").bitwiseAND(_mask(F.col("_ckey"))) == _mask(F.col("_ckey")), F.lit(False))
    tested = keyed.join(bloom, "_block", "left").withColumn("_maybe", maybe).drop("_word", "_block")
    hits = tested.where("_maybe").join(want.withColumn("_in", F.lit(True)), F.col("_ckey") == F.col("_key"), "left")
    hits = hits.withColumn("_listed", F.coalesce("_in", F.lit(False))).drop("_in", "_key")
    return hits.unionByName(tested.where(~F.col("_maybe")).withColumn("_listed", F.lit(False))).drop("_ckey", "_maybe")


def judge(pages: DataFrame, blocked: DataFrame, key: str = "curl", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url)."""
    rows = listed(pages.select("page_id", "url"), "url", blocked, key)
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "_listed")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"), F.col("_listed").alias("listed"))


def toxic_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs of pages whose document (the number that ends the path) is labelled toxic."""
    bad = labels.where("toxic = 1").select(F.col("doc_id").alias("_doc")).distinct()
    number = F.regexp_extract("url", r"/(\d{1,18})(\.html)?/?([?#].*)?$", 1)
    return pages.select(canonical(F.col("url")).alias("curl"), F.when(number != "", number.cast("long")).alias("_doc")).join(bad, "_doc", "left_semi").select("curl")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, toxic_urls(pages, table(spark, sf_dir, "labels")))


SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's') AS q,
    regexp_extract(url, '/(\d{1,18})(\.html)?/?([?#].*)?$', 1) AS num FROM pages),
k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=.*)?$'))) AS kept FROM p),
c AS (SELECT *, CASE WHEN url LIKE '%://%' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') ||
    CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS curl FROM k),
bad AS (SELECT DISTINCT curl FROM c WHERE num <> '' AND TRY_CAST(num AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1)),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    curl IS NOT NULL AND curl IN (SELECT curl FROM bad) AS listed FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""
