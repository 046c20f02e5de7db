"""URL filter: host and path rules, then a blocked Bloom filter in front of an exact join.

Rules come first: a rule fits its host and every subdomain when the path starts with the
rule's path; the longest fitting rule decides. Other pages are blocked if their canonical
URL is on the list. The list is folded into a blocked Bloom filter: each URL belongs to one
64-bit block and sets four bits there. Pages whose bits are all set are possible hits; only
they take part in the exact join on the canonical URL, which removes the false positives.

The filter is a table with one row per block (about six list entries to a block), joined on the
block number: Catalyst broadcasts it while it is small and shuffles it when the list is
large, so no size is assumed. Rules are a bounded parameter (MAX_RULES).

Defined cases: null url, or a url without "://", has empty host and path, fits no rule, is on
no list and is allowed; repeated pages are judged alike; an empty list blocks nothing; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.common import ROW, carried

MAX_RULES = 1000
ENTRIES_PER_BLOCK, BITS = 6, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., path without a trailing slash; no scheme, query or fragment. Null without a host."""
    return F.when(
        host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))
    )


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null. Rules are (verdict, host, path)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; keep longer lists as a table of URLs")
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _block(url: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(url), blocks)


def _bits(url: Column) -> Column:
    """Four bits of the 64 of a block, from a second hash."""
    h = F.xxhash64(url, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")))
    return mask


def bloom_filter(listed: DataFrame, blocks: int, url: str = "url") -> DataFrame:
    """(block, mask): the non-empty blocks of the filter."""
    return (
        listed.where(F.col(url).isNotNull())
        .groupBy(_block(F.col(url), F.lit(blocks)).alias("block"))
        .agg(F.bit_or(_bits(F.col(url))).alias("mask"))
    )


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """(__row, host, path, canonical_url, maybe_listed, listed, rule, verdict) for every page.

    `listed` has a column `url` of canonical URLs.
    """
    listed = listed.select("url").where("url is not null").distinct()
    blocks = -(-listed.count() // ENTRIES_PER_BLOCK) or 1
    mask = bloom_filter(listed, blocks)
    out = pages.select(carried(pages), pages[url].cast("string").alias("u"))
    out = out.select(ROW, host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    out = out.withColumn("canonical_url", canonical(F.col("host"), F.col("path")))
    out = out.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    probe = out.withColumn("block", _block(F.col("canonical_url"), F.lit(blocks))).join(mask, "block", "left")
    need = _bits(F.col("canonical_url"))
    probe = probe.withColumn("maybe_listed", F.coalesce(F.col("mask").bitwiseAND(need) == need, F.lit(False)))
    exact = listed.select(F.col("url").alias("hit_url"))
    # rows that the filter rules out carry a null key: they can't match and aren't compared
    probe = probe.withColumn("probe_url", F.when(F.col("maybe_listed"), F.col("canonical_url")))
    joined = probe.join(exact, F.col("probe_url") == F.col("hit_url"), "left")
    hit = F.col("hit_url").isNotNull()
    return joined.select(
        ROW,
        "host",
        "path",
        "canonical_url",
        "maybe_listed",
        hit.alias("listed"),
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(hit, "block").otherwise("allow")).alias("verdict"),
    )
