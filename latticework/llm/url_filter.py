"""URL filter: a blocked Bloom filter before an exact hash join.

Listed URLs are canonical: host and path, lower-case host, no scheme, query or
fragment; an entry also covers the host's subdomains and all longer paths. A
page's candidates are its host suffixes with its path prefixes; user names, ports
and a dot at the end of the host are left out of them. Every listed URL sets a few
bits in one 64-bit block of a filter of bounded size, which is a constant of the
plan: candidates that miss it are dropped where they are made. The possible hits,
each once, go to an exact hash join with the list, which removes the false
positives. All of it is JVM expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, fresh, light

#: (action, host, path) as agreed; the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Bits set for an entry, blocks per entry.
BITS, BLOCKS_PER_ENTRY = 4, 1 / 4
#: Filter blocks at most (8 MB): a list of many more than four times as many entries lets more pass, and the exact join more to do.
MOST_BLOCKS = 1 << 20


def host_path(url: Column | str) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and path; both empty without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    tail = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    before = F.regexp_extract(tail, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(before, r"(?s)^([^/]*)", 1)
    return ascii_lower(host), before.substr(F.length(host) + 1, F.length(before))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its action, null if none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, action = F.when(fits, own + start).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def canonical_host(host: Column) -> Column:
    """A host as lists name it: without user name, port and the dot of the root."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(?::[0-9]*)?$", "")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _bits(key: Column) -> list[Column]:
    """The bits of its block that a key sets."""
    other = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftright", other, F.lit(6 * i)).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS)]


def bloom(listed: DataFrame, blocks: int) -> bytes:
    """The filter of the entries (url), eight bytes a block."""
    mask = reduce(lambda a, b: a.bitwiseOR(b), (F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in _bits(F.col("url"))))
    out = bytearray(8 * blocks)
    # at most MOST_BLOCKS rows of two numbers
    for r in listed.groupBy(_block(F.col("url"), blocks).alias("block")).agg(F.bit_or(mask).alias("word")).collect():
        out[8 * r["block"] : 8 * r["block"] + 8] = (r["word"] % (1 << 64)).to_bytes(8, "little")
    return bytes(out)


def may_contain(filled: bytes, key: Column) -> Column:
    """Whether the filter has all the bits of a key."""
    words, start = F.lit(filled), 8 * _block(key, len(filled) // 8) + 1

    def has(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(words, (start + F.call_function("shiftright", bit, F.lit(3))).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1

    return reduce(lambda a, b: a & b, map(has, _bits(key)))


def candidates(host: Column, path: Column, labels_most: int, steps_most: int) -> Column:
    """Every canonical URL that could cover a page: host suffixes x path prefixes.

    Prefixes end at a slash, and the whole path is one. Entries of more labels or
    steps than any listed URL has cannot match and are not made.
    """
    labels, steps = F.split(host, r"\."), F.split(path, "/", steps_most + 1)
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(labels_most))), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))
    starts = F.transform(F.sequence(F.lit(1), F.least(F.size(steps), F.lit(steps_most))), lambda i: F.concat(F.array_join(F.slice(steps, F.lit(1), i), "/"), F.when(i < F.size(steps), F.lit("/")).otherwise(F.lit(""))))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda p: F.concat(h, p)))))


def listed_pages(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """(_page, listed) for those of ``pages`` (host, path) that an entry of ``listed`` (url) covers."""
    listed = listed.where("url is not null").select("url").distinct()
    n, labels, steps = listed.agg(F.count("*"), F.max(F.size(F.split(F.substring_index("url", "/", 1), r"\."))), F.max(F.size(F.split("url", "/")))).first()
    blocks = min(MOST_BLOCKS, 1 << max(6, int(n * BLOCKS_PER_ENTRY).bit_length()))
    filled = bloom(listed, blocks)
    near = F.filter(candidates(canonical_host(F.col("host")), F.col("path"), labels or 1, steps or 1), lambda c: may_contain(filled, c))
    possible = pages.select(F.struct("host", "path").alias("_page"), F.explode(near).alias("_url"))
    # each possible hit once against the list: a page that is met often is not looked up often
    hits = cut(possible.select("_url").distinct().join(light(listed.withColumnRenamed("url", "_url"), n, 256), "_url"), "hits")
    found = possible.join(light(hits, hits.count(), 256), "_url")
    return found.groupBy("_page").agg(F.max_by("_url", F.struct(F.length("_url"), F.col("_url"))).alias("listed"))


def judge(pages: DataFrame, listed: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Add host, path, rule, listed and verdict to ``pages`` (url and any others).

    A fitting rule decides; without one a page that the list covers is blocked
    and any other allowed. Null URLs and URLs without ``://`` have an empty host
    and path, fit nothing and are allowed. Equal rows get equal verdicts.
    """
    named = [c for c in pages.columns if c not in ("host", "path", "rule", "listed", "verdict")]
    host, path = host_path("url")
    found = pages.select(*[F.col(f"`{c}`") for c in named], host.alias("host"), path.alias("path"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    done, own_host, own_path = (fresh(pages, c) for c in ("_action", "_host", "_path"))
    found = found.withColumn("rule", rule).withColumn(done, action)
    # pages that share host and path share their verdict: a common one is looked up once
    open_urls = found.where(F.col(done).isNull() & (F.col("host") != "")).select("host", "path").distinct()
    hits = cut(listed_pages(open_urls, listed).select(F.col("_page.host").alias(own_host), F.col("_page.path").alias(own_path), "listed"), "listed")
    joined = found.join(light(hits, hits.count(), 512), (F.col("host") == F.col(own_host)) & (F.col("path") == F.col(own_path)) & F.col(done).isNull(), "left")
    verdict = F.coalesce(F.col(done), F.when(F.col("listed").isNotNull(), "block").otherwise("allow"))
    return joined.select(*[F.col(f"`{c}`") for c in named], "host", "path", "rule", "listed", verdict.alias("verdict"))
