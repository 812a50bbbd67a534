"""URL filters: host and path rules, then a listed-URL lookup.

The listed canonical URLs fill a blocked Bloom filter: a URL hashes to one
block of eight 64-bit words and sets one bit in each.  The filter is a table
with one row per block, so probing is one join on the block and eight bit
tests, all in Spark expressions.  Only possible hits go on to an exact hash
join with the list, which removes false positives.  The number of blocks
follows the list up to ``max_blocks``, so the broadcast has a fixed bound
(72 bytes a block); a longer list only raises the share of possible hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (host, path, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
BITS_PER_URL = 16
BLOCK_BITS = 512
MAX_BLOCKS = 1 << 16
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, path without ``.html`` and a
    closing slash; scheme, query and fragment do not count.  Null without a host."""
    short = F.regexp_replace(path, r"(\.html?|/+)$", "")
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), short))


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; null without one."""
    text = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the longest is tested first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _bits(url: Column) -> list[Column]:
    h = F.xxhash64(url, F.lit("bits"))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(8)]


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """``block, b0..b7`` from a table with a ``canonical`` column."""
    rows = listed.filter("canonical is not null") \
        .select(F.pmod(F.xxhash64("canonical"), F.lit(n_blocks)).alias("block"),
                *[b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("canonical")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(8)])


def probe(urls: DataFrame, blocks: DataFrame, n_blocks: int, broadcast: bool) -> DataFrame:
    """Adds ``possible`` (never false for a listed ``canonical``)."""
    named = blocks.withColumnRenamed("block", "_block")
    asked = urls.withColumn("_at", F.pmod(F.xxhash64("canonical"), F.lit(n_blocks)))
    joined = asked.join(F.broadcast(named) if broadcast else named, F.col("_at") == F.col("_block"), "left")
    hits = [F.col(f"b{i}").bitwiseAND(b) != 0 for i, b in enumerate(_bits(F.col("canonical")))]
    possible = F.coalesce(reduce(lambda a, b: a & b, hits), F.lit(False)) & F.col("canonical").isNotNull()
    return joined.withColumn("possible", possible).drop("_at", "_block", *[f"b{i}" for i in range(8)])


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``page_id, host, path, rule, verdict, canonical, listed`` for every row.

    ``listed`` has a ``canonical`` column (nulls and repeats are ignored; it
    may be empty).  A rule's verdict wins; without a rule a listed URL is
    blocked and any other allowed.  Null urls and urls without ``://`` have an
    empty host and path, no rule, and are allowed.  Null ids, repeated rows
    and other columns make no difference.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"),
                       canonical(F.col("host"), F.col("path")).alias("canonical"))
    distinct = listed.select("canonical").filter("canonical is not null").distinct()
    wanted = -(-distinct.count() * BITS_PER_URL // BLOCK_BITS)
    n_blocks = max(1, min(max_blocks, wanted))
    asked = probe(rows, bloom_blocks(distinct, n_blocks), n_blocks, broadcast=True)
    clear = asked.filter(~F.col("possible")).withColumn("listed", F.lit(False))
    exact = distinct.select(F.col("canonical").alias("_c"))
    hits = asked.filter("possible").join(exact, F.col("canonical") == F.col("_c"), "left") \
        .withColumn("listed", F.col("_c").isNotNull()).drop("_c")
    both = clear.unionByName(hits)
    return both.select("page_id", "host", "path", "rule",
                       F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
                       "canonical", "listed")


def listed_hosts(pages: DataFrame, pattern: str) -> DataFrame:
    """Canonical URLs of the pages whose host matches ``pattern``: the list a
    crawl's own host blocklist implies."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return pages.select(host.alias("h"), path.alias("p")).filter(F.col("h").rlike(pattern)) \
        .select(canonical(F.col("h"), F.col("p")).alias("canonical"))
