"""Placeholders for values: the same value has the same placeholder everywhere in its scope.

A value is identified by its category and normal form.  Values are numbered per scope and category in the order
of their first appearance ``(ord, start)``.  Only distinct values are numbered.  The order is cut into ranges
with about as many values, each numbered by itself from the count before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..categories import placeholder
from ..functions.text import bound, normalize
from ..shared import materialize


def seed_numbers(seed: DataFrame) -> DataFrame:
    """The largest number per scope and category among existing placeholders, whatever their label.

    A number that is no long is none that numbering could reach; it is left out.
    """
    number = F.regexp_extract("placeholder", r"_(\d+)\]\s*$", 1)
    return seed.where(number != "").groupBy("scope_id", "category").agg(F.max(number.try_cast("long")).alias("largest"))


def seed_values(seed: DataFrame) -> DataFrame:
    """``(scope_id, category, norm, placeholder, largest)``: what an earlier mapping calls a value, and the largest number among its placeholders."""
    number = F.regexp_extract("placeholder", r"_(\d+)\]\s*$", 1).try_cast("long")
    if "pos" in seed.columns:
        latest = F.max_by("placeholder", "pos")
    else:
        several = F.min("placeholder") != F.max("placeholder")
        latest = F.when(several, F.raise_error(F.lit("a seed repeats a value with another placeholder; give it a column pos"))).otherwise(F.max("placeholder"))
    return seed.withColumn("norm", normalize(F.col("original"))).groupBy("scope_id", "category", "norm").agg(latest.alias("placeholder"), F.max(number).alias("largest"))


def seed_rows(seed: DataFrame) -> DataFrame:
    """``(scope_id, known, largest)``: a scope's earlier mapping as two maps, placeholders by ``value_name`` and the largest number by category."""
    rows = seed_values(seed).where("category is not null").groupBy("scope_id").agg(F.collect_list(F.struct("category", "norm", "placeholder", "largest")).alias("e"))
    known = F.map_from_entries(F.transform(F.filter("e", lambda x: x["norm"].isNotNull()), lambda x: F.struct(value_name(x["category"], x["norm"]), x["placeholder"])))
    categories = F.array_distinct(F.col("e.category"))
    largest = F.map_from_arrays(categories, F.transform(categories, lambda c: F.array_max(F.transform(F.filter("e", lambda x: x["category"] == c), lambda x: x["largest"]))))
    return rows.select("scope_id", known.alias("known"), largest.alias("largest"))


def first_appearances(spans: DataFrame) -> DataFrame:
    """``(scope_id, category, norm, ord, start, original)``: each distinct value where it appears first."""
    keyed = spans.withColumn("norm", normalize(F.col("original")))
    first = keyed.groupBy("scope_id", "category", "norm").agg(F.min(F.struct("ord", "start", "original")).alias("f"))
    return first.select("scope_id", "category", "norm", "f.ord", "f.start", "f.original")


def number_values(values: DataFrame, slices: int | None = None) -> DataFrame:
    """Adds ``number``: 1, 2, ... per scope and category by ``(ord, start)``; ``ord`` may be of any type that has an order.

    Rows are dealt to ranges of about equal size by that order (``slices``, or as many as shuffles have partitions), and written; each range is numbered by itself from the counts of
    those before it.  So neither a scope as large as the corpus nor one huge text is a single task's work.
    """
    order = ["scope_id", "category", "ord", "start"]
    ranged = values.repartitionByRange(*order) if slices is None else values.repartitionByRange(slices, *order)
    dealt = materialize(ranged.withColumn("slice", F.spark_partition_id()), "values")
    counts = dealt.groupBy("scope_id", "category", "slice").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("scope_id", "category").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("scope_id", "category", "slice", before.alias("offset"))
    place = F.row_number().over(Window.partitionBy("scope_id", "category", "slice").orderBy("ord", "start"))
    return dealt.withColumn("place", place).join(offsets, ["scope_id", "category", "slice"]).withColumn("number", (F.col("place") + F.col("offset")).cast("int")).drop("slice", "place", "offset")


def build_mapping(spans: DataFrame, language: str = "de", seed: DataFrame | None = None) -> DataFrame:
    """``(scope_id, category, norm, placeholder, original, ord, start)`` for all values of ``spans(scope_id, ord, start, original, category)``.

    With a seed (an earlier mapping) a known value keeps its placeholder, shown with this pass's spelling, and new
    values are numbered on from the largest number; of repeated seed values the last by ``pos`` counts.  A seed without
    ``pos`` must not repeat a value with another placeholder: rows of a table have no order, so this fails.
    """
    values = first_appearances(spans)
    if seed is None:
        return number_values(values).withColumn("placeholder", placeholder(F.col("category"), F.col("number"), language)).drop("number")
    known = seed_values(seed)
    joined = values.join(known, ["scope_id", "category", "norm"], "left")
    new = number_values(joined.where("placeholder is null").drop("placeholder", "largest")).join(seed_numbers(seed), ["scope_id", "category"], "left")
    number = F.col("number") + F.coalesce("largest", F.lit(0))
    new = new.withColumn("placeholder", placeholder(F.col("category"), number, language)).drop("number", "largest")
    return new.unionByName(joined.where("placeholder is not null").drop("largest"))


def value_key(span: Column) -> Column:
    return F.struct(span["category"].alias("category"), normalize(span["original"]).alias("norm"))


def row_mapping(spans: Column, language: str = "de") -> Column:
    """The mapping of one row's accepted spans (its own scope), without a shuffle: by category, then first appearance.

    ``array<struct<placeholder, original, category, norm, first>>``; ``first`` is the place of the value's first span.
    """

    def of(keys: Column) -> Column:
        def numbered(category: Column, places: Column) -> Column:
            own = F.filter(places, lambda p: F.get(keys, p)["category"] == category)
            return F.transform(own, lambda p, i: F.struct(placeholder(category, i + 1, language).alias("placeholder"), F.get(spans, p)["original"].alias("original"), category.alias("category"), F.get(keys, p)["norm"].alias("norm"), p.alias("first")))

        categories = F.array_distinct(F.transform(keys, lambda k: k["category"]))
        # the first place of every different key: keys with their places, sorted, where the key changes
        placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k["category"].alias("category"), k["norm"].alias("norm"), i.alias("place"))))
        firsts = bound(placed, lambda a: F.array_sort(F.transform(F.filter(a, lambda x, i: (i == 0) | ~_same_key(x, F.get(a, i - 1))), lambda x: x["place"])))
        return bound(firsts, lambda places: F.flatten(F.transform(categories, lambda c: numbered(c, places))))

    return bound(F.transform(spans, value_key), of)


def _same_key(a: Column, b: Column) -> Column:
    return (a["category"] == b["category"]) & (a["norm"] == b["norm"])


def value_name(category: Column, norm: Column) -> Column:
    return F.concat_ws("\u0001", category, norm)


def row_labels(spans: Column, mapping: Column) -> Column:
    """The placeholder of every span of a row, by its mapping."""
    keys = F.transform(mapping, lambda m: value_name(m["category"], m["norm"]))
    lookup = F.map_from_arrays(keys, F.transform(mapping, lambda m: m["placeholder"]))
    return bound(lookup, lambda known: F.transform(spans, lambda s: F.try_element_at(known, value_name(s["category"], normalize(s["original"])))))


def scope_mapping(spans: Column, language: str = "de", known: Column | None = None, largest: Column | None = None) -> Column:
    """The mapping of one scope's accepted spans, in the order of their appearance, and the placeholder of each of them.
    With an earlier mapping's maps (``seed_rows``) known values keep their placeholders, and others are numbered on.

    ``(values, labels)``: ``row_mapping``'s entries and an array as long as ``spans``.  Equal values are brought together by a sort, so
    that the cost hardly grows faster than the number of spans.
    """

    def of(placed: Column) -> Column:
        places = F.transform(placed, lambda x, i: F.when((i == 0) | ~_same_key(x, F.get(placed, i - 1)), i.cast("int")))
        return bound(F.filter(places, lambda i: i.isNotNull()), lambda starts: bound(F.sort_array(F.transform(starts, lambda b, k: value(placed, b, F.coalesce(F.get(starts, k + 1), F.size(placed))))), numbered))

    def value(placed: Column, begin: Column, end: Column) -> Column:
        x = F.get(placed, begin)
        return F.struct(x["category"].alias("category"), x["place"].alias("first"), x["norm"].alias("norm"), F.transform(F.slice(placed, begin + 1, end - begin), lambda y: y["place"]).alias("places"))

    def named(v: Column, name: Column) -> Column:
        return F.struct(name.alias("placeholder"), F.get(spans, v["first"])["original"].alias("original"), v["category"].alias("category"), v["norm"].alias("norm"), v["first"].alias("first"), v["places"].alias("places"))

    def counted(values: Column) -> Column:
        heads = F.filter(F.transform(values, lambda v, i: F.when((i == 0) | (v["category"] != F.get(values, i - 1)["category"]), i.cast("int"))), lambda i: i.isNotNull())

        def entry(v: Column, i: Column, heads: Column) -> Column:
            number = i - F.array_max(F.filter(heads, lambda h: h <= i)) + 1
            if largest is not None:
                number = number + F.coalesce(F.try_element_at(largest, v["category"]), F.lit(0))
            return named(v, placeholder(v["category"], number, language))

        return bound(heads, lambda heads: F.transform(values, lambda v, i: entry(v, i, heads)))

    def numbered(values: Column) -> Column:
        if known is None:
            return bound(counted(values), labelled)
        rated = F.transform(values, lambda v: F.struct(v.alias("v"), F.try_element_at(known, value_name(v["category"], v["norm"])).alias("name")))

        def both(rated: Column) -> Column:
            new = F.transform(F.filter(rated, lambda x: x["name"].isNull()), lambda x: x["v"])
            old = F.transform(F.filter(rated, lambda x: x["name"].isNotNull()), lambda x: named(x["v"], x["name"]))
            return F.array_sort(F.concat(bound(new, counted), old), lambda a, b: a["first"] - b["first"])

        return bound(bound(rated, both), labelled)

    def labelled(entries: Column) -> Column:
        labels = F.sort_array(F.flatten(F.transform(entries, lambda e: F.transform(e["places"], lambda p: F.struct(p.alias("place"), e["placeholder"].alias("placeholder"))))))
        return F.struct(F.transform(entries, lambda e: e.dropFields("places")).alias("values"), F.transform(labels, lambda x: x["placeholder"]).alias("labels"))

    keys = F.transform(spans, lambda s, i: F.struct(s["category"].alias("category"), normalize(s["original"]).alias("norm"), i.cast("int").alias("place")))
    return bound(F.sort_array(keys), of)


def merge_mappings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old entries stay; new entries are added where their placeholder is not known yet (the first by ``pos``)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("scope_id", "placeholder").orderBy("_new", "pos"))
    return both.withColumn("_rank", rank).where((F.col("_new") == 0) | (F.col("_rank") == 1)).drop("_new", "_rank")
