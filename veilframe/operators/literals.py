"""Many literals at once: which terms of a table can stand in which texts, found by an equality join.

Every term has an anchor around the one of its groups of three characters that texts hold the fewest times, as counted in ``BUCKETS`` by the
groups' hashes: ten or six characters where the term has as many, as groups of three are in too many texts.  Only texts that hold the anchor meet
the term; a term with a group whose bucket is empty meets none, and goes before anything is shuffled.  No pattern of all terms is made, and neither terms nor texts are collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, occurrences, settled
from ..shared import materialize, spread
from .detectors import CANDIDATES, folded

#: Characters of a group; shorter terms are a group of their own.
GROUP = 3
#: Characters of the anchor of a term that has as many, widest first.
WIDE = (10, 6)


def _groups(text: Column, size: int) -> Column:
    """All groups of ``size`` characters, found in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


#: Groups are counted in so many buckets, which is all of them that the driver and plans hold.
BUCKETS = 1 << 16
#: Anchors are looked for in so many.
ANCHOR_BUCKETS = 1 << 20


def _bucket(group: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(group), F.lit(buckets)).cast("int")


def _levels(counts: DataFrame) -> bytes:
    """For every bucket the bits of its count; 0 where nothing has fallen into it."""
    levels = bytearray(BUCKETS)
    for row in counts.collect():
        levels[row["bucket"]] = row["count"].bit_length()
    return bytes(levels)


def _level(levels: bytes, group: Column) -> Column:
    return F.substring(F.lit(levels), _bucket(group, len(levels)) + 1, F.lit(1))


def _present(groups: DataFrame, group: str) -> bytes:
    """For every bucket of anchors whether a group has fallen into it; bits come to the driver."""
    place = _bucket(F.col(group), ANCHOR_BUCKETS).cast("long") + 1  # the bitmap functions count from 1
    maps = groups.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    levels, size = bytearray(ANCHOR_BUCKETS), 1 << 15
    for row in maps:
        bits = f"{int.from_bytes(row['bits'], 'little'):0{size}b}"[::-1]
        levels[(row["n"] - 1) * size : row["n"] * size] = bytes(map(int, bits))
    return bytes(levels)


def terms_by_text(texts: DataFrame, terms: DataFrame, ids: tuple[str, ...] = ("scope_id", "ord"), scope: str | None = None, text: str = "text", term: str = "text") -> DataFrame:
    """``(*ids, found)``: for each text that may hold terms, those terms as an array of rows of ``terms``, sorted.

    Case is ignored.  What is found is a superset of what stands in the text, to be verified there.  With ``scope`` (a column of both
    tables) terms only meet texts of their scope.  Null and empty terms and null texts meet nothing; repeated terms are kept;
    the columns of ``terms`` should start with what orders them.  Rows of ``texts`` are told apart by ``ids``.
    """
    by = [scope] if scope else []
    shape = F.struct(*terms.columns)
    wanted = terms.where(F.length(term) > 0).select(*by, shape.alias("_term"), folded(F.col(term)).alias("_folded")).withColumn("_size", F.least(F.length("_folded"), F.lit(GROUP)))
    wanted = materialize(spread(wanted), "terms")
    sizes = sorted(r["_size"] for r in wanted.select("_size").distinct().collect())
    if not sizes:
        return texts.select(*ids, F.array().cast(f"array<{terms.schema.simpleString()}>").alias("found")).where("false")

    def sized(of: Column, s: int) -> Column:
        return F.transform(_groups(of, s), lambda g: F.concat(F.lit(f"{s:02}"), g))

    def groups(of: Column, size: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.concat(*(F.when(size == s, sized(of, s)).otherwise(none) for s in sizes))

    if scope:  # texts of scopes without terms are not taken apart
        texts = texts.join(wanted.select(scope).distinct(), scope, "left_semi")
    texts = texts.where(F.col(text).isNotNull())

    def held(sizes: list[int], *keep: str) -> DataFrame:
        """The texts' groups, as often as they stand there."""
        every = bound(folded(F.col(text)), lambda t: F.array(*(F.struct(F.lit(f"{s:02}").alias("size"), _groups(t, s).alias("groups")) for s in sizes)))
        apart = texts.select(*keep, F.explode(every).alias("_g")).select(*keep, F.col("_g.size").alias("_of"), F.explode("_g.groups").alias("_group"))
        return apart.select(*keep, F.concat("_of", "_group").alias("_group"))

    often = _levels(held(sizes).groupBy(_bucket(F.col("_group")).alias("bucket")).count())
    rated = F.transform(groups(F.col("_folded"), F.col("_size")), lambda g: F.struct(_level(often, g).alias("level"), g.alias("group")))
    # rated once, however often the best group is used
    best = settled(wanted.select(*by, "_term", "_folded", F.array_min(rated).alias("_best"))).where(F.col("_best.level") != F.lit(b"\0"))
    group, length = F.col("_best.group"), F.length("_folded")
    place, anchor = F.instr("_folded", F.substring(group, 3, GROUP)), group
    for s in sorted(WIDE):
        around = F.substring("_folded", F.least(place, length - (s - 1)), F.lit(s))
        anchor = F.when(length >= s, F.concat(F.lit(f"{s:02}"), around)).otherwise(anchor)
    anchors = materialize(best.select(*by, anchor.alias("_group"), "_term"), "anchors")
    # only groups that may be an anchor leave their text
    present = _present(anchors, "_group")
    looked = sorted(int(r["s"]) for r in anchors.select(F.substring("_group", 1, 2).alias("s")).distinct().collect())
    if not looked:
        return texts.select(*ids, F.array().cast(f"array<{terms.schema.simpleString()}>").alias("found")).where("false")
    kept = held(looked, *ids, *[c for c in by if c not in ids]).where(_level(present, F.col("_group")) != F.lit(b"\0")).distinct()
    pairs = kept.join(anchors, [*by, "_group"])
    return pairs.groupBy(*ids).agg(F.sort_array(F.collect_list("_term")).alias("found"))


def table_candidates(texts: DataFrame, terms: DataFrame, ids: tuple[str, ...] = ("scope_id", "ord"), text: str = "text", scope: str | None = None) -> DataFrame:
    """``texts`` with ``term_candidates``: candidates at all occurrences, in any case, of a table of terms ``(seq, text)``.

    The same candidates as ``detectors.term_candidates`` with the terms in the order of ``seq``, for tables of any size.
    """
    trimmed = terms.select(*([scope] if scope else []), "seq", F.trim("text").alias("text"))
    found = terms_by_text(texts, trimmed, ids, scope, text).select(*(F.col(c).alias(f"_{c}") for c in ids), "found")
    same = [texts[c].eqNullSafe(found[f"_{c}"]) for c in ids]
    joined = texts.join(found, [*same], "left")

    def places(term: Column) -> Column:
        starts = occurrences(F.col(text), term["text"], "(?iU)")
        length = F.length(term["text"])
        return F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), length.alias("len"), F.substring(F.col(text), s + 1, length).alias("original"), F.lit("term").alias("category"), F.lit(0).alias("priority"), F.lit(0).cast("long").alias("seq")))

    # most of what shares an anchor does not stand in the text: no pattern is made for it
    standing = bound(folded(F.col(text)), lambda whole: F.filter("found", lambda t: F.contains(whole, folded(t["text"]))))
    every = F.flatten(F.transform(standing, places))
    numbered = F.transform(every, lambda c, i: c.withField("seq", i.cast("long"))).cast(CANDIDATES)
    return joined.select(*(texts[c] for c in texts.columns), F.coalesce(numbered, F.array().cast(CANDIDATES)).alias("term_candidates"))
