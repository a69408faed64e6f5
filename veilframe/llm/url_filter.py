"""URL filter lists as Bloom filter cascades, with built-in functions only.

A rule names a host and a path prefix.  The keys that can match a url are its host's suffixes of the
rules' label counts, each with the path's prefixes of the rules' lengths.  Those keys of all urls are the
*universe*.  Level 1 of a cascade holds the listed keys; level 2 the universe's keys that level 1
wrongly admits; level 3 the listed keys that level 2 admits; and so on until a level admits none wrongly.  A
key of the universe is listed if the first level that rejects it has an even number, or if it passes all
of an odd number of levels.  So membership is exact, with no join when urls are judged.

Each verdict has its own cascade.  A level's bits reach the expressions as one array of longs by a scalar
subquery.  A level is made so large that it admits no more wrong keys than it holds right ones: its bits grow with the list, and
only with the sixth root of the universe.  A list whose levels would be larger than ``BROADCAST_LIMIT`` is not sent to anyone: keys are
looked up in it by a join.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, materialize

BITS_PER_KEY = 16
HASHES = 6
MAX_LEVELS = 40


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @staticmethod
    def parse(verdict: str, text: str) -> Rule:
        """``example.net/en/``: the host up to the first ``/``, the path from there on."""
        host, slash, rest = text.partition("/")
        return Rule(verdict, host.lower(), slash + rest)

    @property
    def key(self) -> str:
        return self.host + self.path


#: The list that the registered query applies.
RULES = (Rule.parse("block", "net/"), Rule.parse("allow", "example.net/en/"), Rule.parse("block", "example.com/de/"), Rule.parse("allow", "org/fr/"))

#: ASCII capitals and their small letters (other letters stay).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def candidate_keys(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The keys that could be rules matching the url, longest first.

    Only the shapes (labels of the host, characters of the path) that occur among the rules are made.
    """
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    if not shapes:
        return F.array().cast("array<string>")
    # one literal, so that the plan does not grow with the shapes
    listed = F.from_json(F.lit(json.dumps([{"n": n, "k": k} for n, k in shapes])), "array<struct<n:int,k:int>>")
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    fitting = F.filter(listed, lambda s: (labels >= s["n"]) & (F.length(path) >= s["k"]))
    keys = F.transform(fitting, lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["n"]), F.substring(path, F.lit(1), s["k"])))
    return F.transform(F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("longest"), k.alias("key")))), lambda x: x["key"])


def _places(key: Column, bits: int, level: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(HASHES)]


def _words(keys: DataFrame, bits: int, level: int) -> DataFrame:
    """One row: the filter's bits as an array of longs.  Aggregated by word before they meet."""
    places = keys.select(F.explode(F.array(*_places(F.col("key"), bits, level))).alias("p"))
    words = places.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(words, "w", "left")
    rows = every.agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("r"))
    return rows.select(F.col("r").getField("b").alias("bits"))


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    table: DataFrame

    def admits(self, key: Column, words: Column | None = None) -> Column:
        words = self.table.scalar() if words is None else words
        tests = [F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1 for p in _places(key, self.bits, self.number)]
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def words(self) -> Column:
        """The bits of all levels, an array of longs for each."""
        return F.array(*(level.table.scalar() for level in self.levels)) if self.levels else F.array().cast("array<array<long>>")

    def contains(self, key: Column, words: Column | None = None) -> Column:
        """True for the universe's listed keys."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.admits(key, None if words is None else F.get(words, F.lit(level.number - 1))), out).otherwise(F.lit(level.number % 2 == 0))
        return out


def level_bits(inside: int, outside: int, bits_per_key: int = BITS_PER_KEY) -> int:
    """Bits of a level with so many keys, such that of ``outside`` others no more are expected to be admitted; a power of two."""
    wanted = max(inside * bits_per_key, HASHES * inside * (max(1, outside) / inside) ** (1 / HASHES))
    return max(1024, 1 << (int(wanted) - 1).bit_length())


def build_cascade(spark: SparkSession, listed: DataFrame, universe: DataFrame, bits_per_key: int | None = None, limit: int = BROADCAST_LIMIT) -> Cascade | None:
    """``listed`` and ``universe``: distinct strings in a column ``key``.

    The levels' keys are tables in the shared folder; only the bits, at most ``limit`` bytes a level, are sent to
    executors.  None where a level would need more.  ``bits_per_key`` fixes the levels' sizes, which else follow ``level_bits``.
    """
    inside, outside, levels = listed, universe.join(listed, "key", "left_anti"), []
    while (n := inside.count()) and len(levels) < MAX_LEVELS:
        bits = level_bits(n, outside.count() if bits_per_key is None else 0, bits_per_key or BITS_PER_KEY)
        if bits // 8 > limit:
            return None
        level = Level(len(levels) + 1, bits, materialize(_words(inside, bits, len(levels) + 1), "bloom"))
        levels.append(level)
        admitted = materialize(outside.where(level.admits(F.col("key"))), "bloom-keys")
        inside, outside = admitted, inside
    if inside.count():
        raise ValueError("the cascade did not end: a key is both listed and not")
    return Cascade(tuple(levels))


def judged_by_join(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(id, host, path, best)`` for lists of any size: urls' keys meet the list in a join; the longest that is listed counts."""
    listed = urls.sparkSession.createDataFrame([(r.key, r.verdict) for r in rules], "rule string, verdict string")
    rows = materialize(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    keys = rows.select("row", F.posexplode("keys").alias("place", "rule"))
    best = keys.join(listed, "rule").groupBy("row").agg(F.min_by(F.struct("rule", "verdict"), "place").alias("best"))
    return rows.join(best, "row", "left").select("id", "host", "path", "best")


def filter_urls(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow", limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Judge every url by the longest rule that fits its host (or a parent domain) and path.

    One row per input row: the id column, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``
    (the rule's, else ``default``).  Urls are judged without join or shuffle, but for lists that need more than ``limit`` bytes a level.

    A null url or one without ``://`` has an empty host and path and fits no rule.  Null and repeated ids pass
    through; further columns are ignored, so their names cannot clash.  A rule listed twice counts once;
    of rules with one key and different verdicts the first listed counts, of rules of equal length the one that sorts first.
    """
    spark = df.sparkSession
    first: dict[str, Rule] = {}
    for rule in rules:
        first.setdefault(rule.key, rule)
    rules = tuple(first.values())
    host, path = url_parts(F.col("u"))
    urls = df.select(df[id_col].alias("id"), df[url_col].alias("u")).select("id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
    universe = materialize(urls.select(F.explode("keys").alias("key")).distinct(), "url-keys")
    cascades = {}
    for verdict in sorted({r.verdict for r in rules}):
        listed = spark.createDataFrame([(r.key,) for r in rules if r.verdict == verdict], "key string")
        cascades[verdict] = build_cascade(spark, listed, universe, limit=limit)

    def judged(bits: Column) -> Column:
        def verdict_of(key: Column) -> Column:
            out = F.lit(None).cast("string")
            for i, cascade in enumerate(cascades.values()):
                out = F.when(cascade.contains(key, F.get(bits, F.lit(i))), F.lit(list(cascades)[i])).otherwise(out)
            return out

        verdicts = F.transform("keys", lambda k: F.struct(k.alias("rule"), verdict_of(k).alias("verdict")))
        return F.get(F.filter(verdicts, lambda v: v["verdict"].isNotNull()), F.lit(0))

    if any(c is None for c in cascades.values()):
        named = judged_by_join(urls, rules)
        return named.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

    every = F.array(*(c.words() for c in cascades.values())) if cascades else F.array().cast("array<array<array<long>>>")
    # a column of its own, as no subquery may stand in a function over arrays
    named = urls.withColumn("bits", every).select("id", "host", "path", F.get(F.transform(F.array("bits"), judged), F.lit(0)).alias("best"))
    return named.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
