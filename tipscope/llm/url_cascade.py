"""Exact URL rules by a cascade of Bloom filters.

The keys a URL can match are its host and parent domains, each with the beginnings of its path that
are as long as some rule's path. Over the universe of all such keys of the corpus, a cascade tells
listed keys from the rest without error: the first filter holds the listed keys, the second the
keys of the universe that the first takes in wrongly, the third the listed keys that the second
takes in wrongly, and so on until nothing is wrong. Testing a page is arithmetic on a few words of
bits in the plan: no join and no shuffle of pages.

A filter's size follows from the number of listed keys (and, for the first, the logarithm of the
universe); the universe itself is only ever counted and filtered in place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipscope.session import materialize


@dataclass(frozen=True)
class Level:
    """A Bloom filter: its bits in 64-bit words, and the number of its hashes."""

    seed: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.bits))
                for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        # One constant string in the plan; the optimizer folds it to an array of numbers.
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        hit = F.lit(True)
        for place in self.places(key):
            word = F.get(words, F.floor(place / 64).cast("int"))
            hit = hit & (F.call_function("getbit", word, F.pmod(place, F.lit(64)).cast("int")) == 1)
        return hit


def build_level(keys: DataFrame, count: int, chance: float, seed: int) -> Level:
    """A filter of ``count`` keys that takes in other keys with about the given chance."""
    hashes = max(1, math.ceil(-math.log2(chance)))
    bits = max(64, math.ceil(count * hashes / math.log(2)))
    empty = Level(seed, bits, hashes, ())
    place = F.explode(F.array(*empty.places(F.col("key")))).alias("place")
    rows = (
        keys.select(place).distinct()
        .groupBy(F.floor(F.col("place") / 64).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(place, 64) AS INT))")).alias("bits"))
        .collect()  # as many words as the filter has: bounded by the listed keys
    )
    words = dict((row["word"], row["bits"]) for row in rows)
    return Level(seed, bits, hashes, tuple(words.get(k, 0) for k in range(-(-bits // 64))))


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that separate ``listed`` from the rest of ``universe`` (both: key) without error.

    The first level's chance of error is chosen so that its false positives are about as many as
    the listed keys; the others err in half of the cases, which makes the sum of sizes least.
    """
    inside = materialize(listed.select("key").where(F.col("key").isNotNull()).distinct(), "listed")
    outside = universe.select("key").where(F.col("key").isNotNull()).distinct().join(
        inside, "key", "left_anti")
    n_inside = inside.count()
    if not n_inside:
        return []
    ratio = max(1, outside.count()) / n_inside
    levels, wrong, right, n = [], inside, outside, n_inside
    while n:
        chance = min(0.5, 1.0 / (ratio * math.sqrt(2.0))) if not levels else 0.5
        level = build_level(wrong, n, chance, len(levels))
        levels.append(level)
        taken = materialize(right.where(level.holds(F.col("key"))), "taken")
        wrong, right, n = taken, wrong, taken.count()
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Membership of a key of the universe."""
    result = F.lit(False)
    for level in reversed(levels):
        result = level.holds(key) & ~result
    return result


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, host and path of each url; both empty without "://"."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of a page, longest first (of equal length: longer host first)."""
    parts = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(
        F.slice(parts, i, F.size(parts)), "."))
    heads = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n))
                               for n in lengths]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(domains, lambda d: F.transform(heads, lambda p: F.struct(
        F.length(F.concat(d, p)).alias("n"), F.length(d).alias("m"), F.concat(d, p).alias("key")))))
    longest = F.sort_array(keys, asc=False)
    return F.when(host != "", F.transform(longest, lambda k: k["key"])).otherwise(
        F.array().cast("array<string>"))


def url_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule and verdict for each row of ``pages`` (page_id, url).

    ``rules`` (host, path, verdict "allow" or "block") is a list a person keeps: its distinct path
    lengths are collected and the filters grow with it. A rule fits its host and all subdomains if
    the path starts with the rule's; the longest rule wins. Pages that no rule fits are allowed.
    Runs jobs while it is built. Defined cases: a null url, or one without "://", has empty host
    and path and is allowed; a path is only what the url spells, so "http://a.net" has none and a
    rule for "net/" does not fit; repeated pages come back each; an empty table gives no rows; no
    rules allow everything; rows of ``rules`` with a null are ignored; if a rule is given with both
    verdicts, block wins; other columns are ignored.
    """
    given = rules.select(F.concat("host", "path").alias("key"), F.length("path").alias("n"),
                         "verdict").where(F.col("key").isNotNull() & F.col("verdict").isNotNull())
    lengths = sorted(row["n"] for row in given.select("n").distinct().collect())
    parts = with_parts(pages)
    if not lengths:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    keys = candidates(F.col("host"), F.col("path"), lengths)
    universe = parts.select("host", "path").distinct().select(F.explode(keys).alias("key"))
    listed = build_cascade(given, universe)
    blocked = build_cascade(given.where("verdict = 'block'"), given)
    found = parts.withColumn("_keys", keys).withColumn("rule", F.get(
        F.filter("_keys", lambda k: is_listed(k, listed)), F.lit(0)))
    verdict = F.when(F.col("rule").isNotNull() & is_listed(F.col("rule"), blocked), "block")
    return found.select("page_id", "host", "path", "rule", verdict.otherwise("allow").alias("verdict"))
