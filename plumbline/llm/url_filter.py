"""URL rules looked up in a cascade of Bloom filters.

A cascade answers exactly whether a key is listed, for every key of a known universe and
without a join: the first filter holds the listed keys, the second the keys of the universe
that the first one lets through wrongly, the third the listed keys that the second one holds
wrongly, and so on until no wrong key is left.

A filter is an array of 64-bit words inside the expression that asks it. Filters larger than
``MAX_BITS`` don't go into expressions: the keys found by the last filter that fits are then
settled by a semi join.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lower_ascii, written

BITS_PER_KEY = 10
HASHES = 5
# 8 MB a filter; about 6.7 million keys.
MAX_BITS = 1 << 26


@dataclass(frozen=True)
class BloomFilter:
    level: int
    bits: int
    words: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")

        def is_set(place: Column) -> Column:
            word = F.get(words, F.floor(place / 64).cast("int"))
            return F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1

        # One function over all places, so the plan has the words once.
        return F.forall(F.array(*_places(key, self.level, self.bits)), is_set)


def _places(key: Column, level: int, bits: int) -> list[Column]:
    first, second = F.xxhash64(key, F.lit(level)), F.xxhash64(F.lit(level), key)
    first, second = F.pmod(first, F.lit(bits)), F.pmod(second, F.lit(bits))
    return [F.pmod(first + F.lit(i) * second, F.lit(bits)) for i in range(HASHES)]


def bloom_filter(keys: DataFrame, level: int) -> BloomFilter | None:
    """The filter over ``keys(key)``, or None where it would pass ``MAX_BITS``."""
    n = keys.count()
    bits = 64 * max(1, math.ceil(n * BITS_PER_KEY / 64))
    if bits > MAX_BITS:
        return None
    place = F.explode(F.array(*_places(F.col("key"), level, bits)))
    rows = (
        keys.select(place.alias("place"))
        .groupBy(F.expr("place div 64").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("set"))
        .collect()  # at most MAX_BITS / 64 rows
    )
    words = [0] * (bits // 64)
    for row in rows:
        words[row.word] = row.set
    return BloomFilter(level, bits, tuple(words))


@dataclass(frozen=True)
class Cascade:
    """Exact membership for the keys of one universe."""

    levels: tuple[BloomFilter, ...]

    def holds(self, key: Column) -> Column:
        found = F.lit(False)
        for level in reversed(self.levels):
            found = level.holds(key) & ~found
        return found


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """The cascade of ``listed(key)`` over ``universe(key)``; both may repeat keys.

    None if a filter would be too large for an expression.
    """
    inside = written(listed.select("key").where("key is not null").distinct(), "listed")
    levels: list[BloomFilter] = []
    first = bloom_filter(inside, 1)
    if first is None:
        return None
    levels.append(first)
    wrong = universe.select("key").where(first.holds(F.col("key"))).distinct()
    outside = written(wrong.join(inside, "key", "left_anti"), "let-through")
    sides = [outside, inside]
    while not sides[0].isEmpty():
        level = bloom_filter(sides[0], len(levels) + 1)
        if level is None:
            return None
        levels.append(level)
        left = sides[1].where(level.holds(F.col("key")))
        sides = [written(left, "let-through"), sides[0]]
    return Cascade(tuple(levels))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` to ``/ ? #`` or the end, A-Z lower-cased; then to
    ``? #`` or the end. Both empty for null and where there is no ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every page's url by ``rules(host, path, verdict)``, verdict being allow or block.

    A rule fits its host and all subdomains where the url's path starts with its path; the rule
    with the longest text wins, of equally long ones that with more host labels. Returns page_id,
    host, path, rule and verdict for every row; repeated pages give repeated rows. Null urls and
    urls without ``://`` have an empty host and path. Rules with null parts fit nothing; a rule
    listed both ways blocks. Without a fitting rule the keys are in no list: ``default``.
    """
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = written(
        rules.where("host is not null and path is not null").select(
            F.concat("host", "path").alias("key"),
            F.size(F.split("host", r"\.")).alias("labels"),
            F.char_length("path").alias("length"),
            "verdict",
        ),
        "rules",
    )
    # A url has as many labels and characters as it has, so the shapes of rules are few. They are
    # data of one array column: the plan is the same for any number of them.
    shapes = [(s.labels, s.length) for s in keyed.select("labels", "length").distinct().collect()]
    if not shapes:
        nothing = F.lit(None).cast("string").alias("rule")
        return urls.select("page_id", "host", "path", nothing, F.lit(default).alias("verdict"))
    universe = urls.select(F.explode(_candidates(shapes)).alias("candidate")).select("candidate.key")
    block = keyed.where("verdict = 'block'")
    listed = build_cascade(keyed, universe)
    blocked = build_cascade(block, keyed) if listed else None
    if listed is None or blocked is None:
        return _judge_by_join(urls, keyed, shapes, default)
    # The longest candidate that is listed.
    best = urls.withColumn("best", F.array_max(F.filter(_candidates(shapes), lambda x: listed.holds(x["key"]))))
    verdict = F.when(blocked.holds(F.col("best.key")), "block").otherwise("allow")
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("best.key").alias("rule"),
        F.when(F.col("best").isNull(), default).otherwise(verdict).alias("verdict"),
    )


def _candidates(shapes: list[tuple[int, int]]) -> Column:
    """The keys that a rule may have to fit the row's host and path: (length, labels, key) each."""
    listed = F.from_json(F.lit(json.dumps(shapes)), F.lit("array<array<int>>"))

    def candidate(shape: Column) -> Column:
        host = F.call_function("substring_index", F.col("host"), F.lit("."), -shape[0])
        key = F.concat(host, F.left(F.col("path"), shape[1]))
        return F.struct(F.char_length(key).alias("length"), shape[0].alias("labels"), key.alias("key"))

    return F.transform(listed, candidate)


def _judge_by_join(urls, keyed, shapes, default):
    """The same for lists beyond ``MAX_BITS``: distinct urls meet the rules in a join."""
    known = keyed.groupBy("key").agg(F.max(F.struct("verdict")).alias("v"))
    distinct = urls.select("host", "path").distinct()
    keys = distinct.select("host", "path", F.inline(_candidates(shapes)))
    best = (
        keys.join(known, "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct("length", "labels", "key", "v.verdict")).alias("best"))
    )
    return urls.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.key").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
