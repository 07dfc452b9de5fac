"""URL filter: a blocked Bloom filter in front of an exact hash join. DataFrame functions only.

A listed entry is a canonical host and path prefix with an action. An entry
fits its host and all subdomains when the path starts with the entry's; the
longest fitting entry decides. Each URL yields the few (host suffix, path
prefix) keys that could be listed, the Bloom filter drops nearly all that
aren't, and an exact hash join on the rest removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Blocks of the Bloom filter: 64 bits each, 8 MB at most; a longer list makes more false positives, which the join removes.
MAX_WORDS = 1 << 20
#: Bytes of the list up to which the exact join broadcasts it; beyond, it is a shuffled hash join.
MAX_BROADCAST = 16 << 20
BITS = 4


def host_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: host up to `/`, `?`, `#` or end, A-Z lower-cased; path then up to `?`, `#` or end. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _mask(h: Column) -> Column:
    """BITS bits of a 64-bit block, from the upper bits of the hash."""
    out = F.lit(0).cast("bigint")
    for k in range(BITS):
        bit = F.shiftrightunsigned(h, 34 + 6 * k).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return out


def _block(h: Column, words: int) -> Column:
    return F.pmod(h, F.lit(words)).cast("int")


def bloom_blocks(keys: DataFrame, words: int) -> DataFrame:
    """(b, m): the blocks of the filter that a key of the column `key` sets bits in, `words` at most."""
    h = F.xxhash64("key")
    return keys.select(_block(h, words).alias("b"), _mask(h).alias("m")).groupBy("b").agg(F.bit_or("m").alias("m"))


def maybe_listed(keys: DataFrame, blocks: DataFrame, words: int) -> DataFrame:
    """keys with `key` null where the filter says that it isn't listed. The blocks are broadcast: MAX_WORDS rows of 12 bytes at most."""
    h = F.xxhash64("key")
    met = keys.join(F.broadcast(blocks), _block(h, words) == F.col("b"), "left")
    return met.withColumn("key", F.when(F.col("m").bitwiseAND(_mask(h)) == _mask(h), F.col("key"))).drop("b", "m")


def judge(pages: DataFrame, listed: DataFrame, id_col="page_id", url_col="url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    listed: (host, path, action). Entries with a null are ignored; of entries
    with equal host and path `block` wins. Null URLs and those without `://`
    have an empty host and path, fit no entry and get `default`. Equal rows
    (same id, host and path) are all returned. Other columns of pages are not
    looked at, so their names can't clash. Hot hosts: rows are pre-aggregated
    before the only shuffle of pages, and the exact join broadcasts the list
    while it is at most MAX_BROADCAST bytes, else Spark splits a hot key.
    """
    host, path = host_path(F.col(url_col).cast("string"))
    pages = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rules = (
        listed.select(ascii_lower(F.col("host")).alias("rhost"), F.col("path").alias("rpath"), "action")
        .where("rhost IS NOT NULL AND rpath IS NOT NULL AND action IS NOT NULL")
        .groupBy("rhost", "rpath")
        .agg(F.max("action").alias("action"))
        .select(F.concat("rhost", "rpath").alias("key"), "rhost", "rpath", "action")
    )
    # Bounded facts of the list: its size, how many labels its hosts have, how long its paths are.
    n, size, labels, lengths = rules.agg(F.count("key"), F.coalesce(F.sum(F.octet_length("key") + 24), F.lit(0)), F.array_sort(F.collect_set(F.size(F.split("rhost", r"\.")))), F.array_sort(F.collect_set(F.length("rpath")))).first()
    if not n:
        return pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    words = min(MAX_WORDS, 1 << max(4, (n * 2 - 1).bit_length() - 2))
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -c) for c in labels]))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= c, F.substring("path", 1, c)) for c in lengths]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    tried = pages.select("page_id", "host", "path", F.posexplode_outer(keys).alias("pos", "key"))
    hits = maybe_listed(tried, bloom_blocks(rules.select("key"), words), words)
    if size <= MAX_BROADCAST:
        exact = hits.join(F.broadcast(rules.select("key", "action")), "key", "left")
    else:
        # Keys that can't be listed are spread by page; a hot listed key is one partition that Spark splits, as no state is held for it.
        spread = F.coalesce("key", F.concat(F.lit("\0"), F.xxhash64("page_id", "host", "path", "pos").cast("string")))
        named = rules.select(F.col("key").alias("listed"), "action").hint("shuffle_hash")
        exact = hits.withColumn("spread", spread).join(named, F.col("spread") == F.col("listed"), "left").drop("spread", "listed").withColumn("action", F.when(F.col("key").isNotNull(), F.col("action")))
    found = F.when(F.col("action").isNotNull(), F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), "action"))
    judged = exact.groupBy("page_id", "host", "path").agg(F.max(found).alias("best"), F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("copies"))
    judged = judged.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))


#: The rules of the query, fixed by its contract.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

SQL = """
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, q, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT u.page_id, u.host, u.path,
  (SELECT arg_max(r.h || r.q, length(r.h || r.q)) FROM r WHERE (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.q)) AS rule,
  coalesce((SELECT arg_max(r.action, length(r.h || r.q)) FROM r WHERE (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.q)), 'allow') AS verdict
FROM u
"""
