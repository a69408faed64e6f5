"""Which candidates are accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, exploded, normalize
from ..shared import materialize
from .detectors import CANDIDATES


def without_allowed(candidates: Column, allowed: tuple[str, ...]) -> Column:
    """Candidates whose value is not allowed (case and white space are ignored).  Runs before overlaps are resolved."""
    wanted = sorted({" ".join(a.split()).lower() for a in allowed if a.strip()})
    if not wanted:
        return candidates
    return F.filter(candidates, lambda c: ~F.lower(normalize(c["original"])).isin(*wanted))


def without_allowed_table(spans: DataFrame, allowed: DataFrame, value: str = "value") -> DataFrame:
    """The same for rows of candidates and a table of allowed values: an anti-join."""
    keys = allowed.select(F.lower(normalize(F.col(value))).alias("_allowed")).where("_allowed <> ''").distinct()
    return spans.join(keys, F.lower(normalize(spans["original"])) == keys["_allowed"], "left_anti")


def resolve_overlaps(candidates: Column) -> Column:
    """Greedy selection by priority, then length, then start, then order of detection; returned by start.

    Candidates are cut into runs that overlap, one of which the next cannot reach, so only those of a run are compared.
    """

    def end(c: Column) -> Column:
        return c["start"] + c["len"]

    def take(accepted: Column, c: Column) -> Column:
        clash = F.exists(accepted, lambda a: (c["start"] < end(a)) & (a["start"] < end(c)))
        plain = F.struct(c["start"], c["len"], c["original"], c["category"], c["priority"], c["seq"])
        return F.when(clash, accepted).otherwise(F.concat(accepted, F.array(plain)))

    def chosen(run: Column) -> Column:
        ranked = F.array_sort(F.transform(run, lambda c: F.struct(c["priority"], (-c["len"]).alias("neg"), c["start"], c["seq"], c["len"], c["original"], c["category"])))
        return F.when(F.size(run) == 1, run).otherwise(F.array_sort(F.aggregate(ranked, F.array().cast(CANDIDATES), take)))

    def by_runs(ordered: Column) -> Column:
        def reach(acc: Column, c: Column) -> Column:
            cuts = F.when(c["start"] >= acc["end"], F.concat(acc["cuts"], F.array(acc["i"]))).otherwise(acc["cuts"])
            return F.struct(F.greatest(acc["end"], end(c)).alias("end"), (acc["i"] + 1).alias("i"), cuts.alias("cuts"))

        start = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("cuts"))
        cuts = F.aggregate(ordered, start, reach, lambda acc: acc["cuts"])
        runs = bound(cuts, lambda at: F.transform(at, lambda b, k: bound(F.slice(ordered, b + 1, F.coalesce(F.get(at, k + 1), F.size(ordered)) - b), chosen)))
        # where no candidate reaches the next one, all are taken
        meets = F.exists(F.sequence(F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(1))), lambda i: F.get(ordered, i)["start"] < end(F.get(ordered, i - 1)))
        return F.when(F.coalesce(meets, F.lit(False)), F.flatten(runs)).otherwise(ordered)

    wanted = candidates.cast(CANDIDATES)
    return bound(wanted, lambda c: F.when(F.size(c) < 2, c).otherwise(bound(F.sort_array(c), by_runs)))


def _nodes(start: Column, end: Column, height: int) -> Column:
    """The binary intervals that make up ``[start, end)``: at most two of every size ``2 ** level`` up to ``height``."""

    def node(level: int, i: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), i.alias("i"))

    def ends(level: int) -> tuple[Column, Column]:
        return -F.floor(-start / (1 << level)).cast("long"), F.floor(end / (1 << level)).cast("long")

    sides = []
    for level in range(height):
        low, high = ends(level)
        sides += [F.when((low < high) & (low % 2 == 1), node(level, low)), F.when((low < high) & (high % 2 == 1), node(level, high - 1))]
    low, high = ends(height)
    # of the largest size any number may stand side by side
    top = F.when(low < high, F.transform(F.sequence(low, high - 1), lambda i: node(height, i)))
    none = F.array().cast("array<struct<level:int,i:bigint>>")
    return F.concat(F.filter(F.array(*sides), lambda n: n.isNotNull()) if sides else none, F.coalesce(top, none))


#: Spans of a text that are decided in one row.
FEW = 256


def _resolve_few(spans: DataFrame, columns: list[str]) -> DataFrame:
    """The greedy selection by ``_rank`` for texts (``_text``) whose spans are one array, cut into runs that overlap."""
    span = F.struct("start", (F.col("start") + F.col("len")).alias("end"), "_rank", F.struct(*columns).alias("row"))

    def run(every: Column) -> Column:
        def take(acc: Column, c: Column) -> Column:
            clash = F.exists(acc, lambda a: (c["start"] < a["end"]) & (a["start"] < c["end"]))
            return F.when(clash, acc).otherwise(F.concat(acc, F.array(F.struct(c["start"], c["end"], c["row"]))))

        ranked = F.sort_array(F.transform(every, lambda c: F.struct(c["_rank"], c["start"], c["end"], c["row"])))
        none = F.transform(F.slice(every, F.lit(1), F.lit(0)), lambda c: F.struct(c["start"], c["end"], c["row"]))
        return F.when(F.size(every) == 1, F.transform(every, lambda c: c["row"])).otherwise(F.transform(F.aggregate(ranked, none, take), lambda c: c["row"]))

    def runs(ordered: Column) -> Column:
        def reach(acc: Column, c: Column) -> Column:
            cuts = F.when(acc["end"].isNull() | (c["start"] >= acc["end"]), F.concat(acc["cuts"], F.array(acc["i"]))).otherwise(acc["cuts"])
            return F.struct(F.greatest(acc["end"], c["end"].cast("long")).alias("end"), (acc["i"] + 1).alias("i"), cuts.alias("cuts"))

        start = F.struct(F.lit(None).cast("long").alias("end"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("cuts"))
        cuts = F.aggregate(ordered, start, reach, lambda acc: acc["cuts"])
        return F.flatten(bound(cuts, lambda at: F.transform(at, lambda b, k: bound(F.slice(ordered, b + 1, F.coalesce(F.get(at, k + 1), F.size(ordered)) - b), run))))

    texts = spans.groupBy("_text").agg(F.collect_list(span).alias("spans"))
    sorted_spans = F.array_sort("spans", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    return exploded(texts.select(bound(sorted_spans, runs).alias("kept")), "kept", "s").select("s.*")


def resolve_spans(spans: DataFrame, keys: tuple[str, ...] = ("scope_id", "ord"), rank: tuple[str, ...] = ("priority", "-len", "start", "seq"), few: int = FEW) -> DataFrame:
    """The greedy selection over a table of spans ``(*keys, start, len, ...)``; texts may have any number of spans.

    The same rule as ``resolve_overlaps``: spans are taken by ``rank`` (SQL expressions, smaller first; equal ones in any
    order) unless they overlap one that was taken.  Texts of up to ``few`` spans are decided in one row each, larger ones in
    rounds: a span that is the best of all undecided spans
    that overlap it is taken, what overlaps a span taken is dropped.  No pairs of spans are made: each span falls into
    binary intervals, an interval knows the best span that covers it and the best within it, and spans overlap where one's
    interval is the other's or lies in it.  So a round is two aggregations and two equality joins, whatever lies on top of one
    another; the number of rounds is that of the longest chain in which each span waits for the next.  Spans without length
    are dropped, null keys are a text of their own, repeated rows are taken once.
    """
    columns = spans.columns
    order = F.struct(*(F.expr(r).alias(f"r{i}") for i, r in enumerate(rank)), F.col("_id").alias("id"))
    text = F.struct(*keys)
    left = spans.where("len > 0").withColumn("_id", F.monotonically_increasing_id())
    left = materialize(left.select("*", order.alias("_rank"), text.alias("_text")), "undecided")
    many = materialize(left.groupBy("_text").count().where(F.col("count") > few).select("_text"), "many")
    if many.isEmpty():
        return _resolve_few(left, columns)
    decided = _resolve_few(left.join(many, "_text", "left_anti"), columns)
    left = left.join(many, "_text", "left_semi")
    height = max(0, int(left.agg(F.max("len")).first()[0] or 1).bit_length() - 1)
    taken: list[DataFrame] = []
    while not left.isEmpty():
        nodes = left.select("_text", "_id", "_rank", F.explode(_nodes(F.col("start").cast("long"), (F.col("start") + F.col("len")).cast("long"), height)).alias("n"))
        # an interval and all that it lies in
        up = nodes.select("_text", "_id", "_rank", "n.level", "n.i", F.explode(F.sequence(F.col("n.level"), F.lit(height))).alias("above"))
        up = up.select("_text", "_id", "_rank", F.col("above").alias("level"), F.expr("shiftright(i, above - level)").alias("i"), (F.col("above") == F.col("level")).alias("own"))
        place = ["_text", "level", "i"]
        best = up.groupBy(place).agg(F.min(F.when(F.col("own"), F.col("_rank"))).alias("covers"), F.min("_rank").alias("within"))
        beaten = (F.col("covers") < F.col("_rank")) | (F.col("own") & (F.col("within") < F.col("_rank")))
        won = up.join(best, place).groupBy("_id").agg(F.bool_or(F.coalesce(beaten, F.lit(False))).alias("lost")).where("not lost").select("_id")
        won = materialize(won, "taken")
        taken.append(left.join(won, "_id").select(columns))
        marks = up.join(won, "_id").groupBy(place).agg(F.bool_or("own").alias("covered"))
        hit = up.join(marks, place).where("covered or own").select("_id").distinct()
        left = materialize(left.join(hit, "_id", "left_anti"), "undecided")
    out = decided
    for part in taken:
        out = out.unionByName(part)
    return out
