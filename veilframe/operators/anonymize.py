"""Texts to texts with placeholders, and the mapping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, exploded, normalize, prefix_sums
from ..options import Options
from ..shared import materialize
from .detectors import detect
from .findings import with_findings
from .literals import table_candidates
from .numbering import build_mapping, row_labels, row_mapping, scope_mapping, seed_rows
from .resolve import resolve_overlaps, without_allowed


def accepted_spans(texts: DataFrame, options: Options, findings: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Adds ``spans``: the accepted candidates by start.  ``findings(scope_id, seq, text, category)`` join on ``scope_id``."""
    found = detect(texts, options, text)
    if findings is not None:
        found = with_findings(found, findings, options, text)
    return found.withColumn("spans", resolve_overlaps(without_allowed(F.col("candidates"), options.allowed_values))).drop("candidates")


def splice(text: Column, spans: Column, labels: Column) -> Column:
    """The text with its spans replaced by labels (arrays of equal length, spans by start, not overlapping)."""

    def whole(spans: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.get(spans, i - 1)
            end = F.when(i == 0, F.lit(0)).otherwise(before["start"] + before["len"])
            return F.concat(F.substring(text, end + 1, s["start"] - end), F.get(labels, i))

        last = F.get(spans, F.size(spans) - 1)
        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, last["start"] + last["len"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, bound(spans, whole)).otherwise(text)


def anonymize_rows(texts: DataFrame, options: Options | None = None, findings: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Every row is its own scope.  Adds ``anonymized_text`` and ``mapping`` (array of placeholder, original, category).

    Narrow.  A null text becomes empty.  A row's spans, mapping and text are one value, so that whatever columns are
    selected, each is computed once.
    """
    options = options or Options()
    found = accepted_spans(texts.withColumn(text, F.coalesce(text, F.lit(""))), options, findings, text)
    source = F.col(text)

    def row(spans: Column) -> Column:
        def named(mapping: Column) -> Column:
            entries = F.transform(F.array_sort(F.transform(mapping, lambda m: F.struct(m["first"], m["placeholder"], m["original"], m["category"]))), lambda m: F.struct(m["placeholder"], m["original"], m["category"]))
            new = bound(row_labels(spans, mapping), lambda labels: splice(source, spans, labels))
            return F.struct(new.alias("anonymized_text"), entries.alias("mapping"))

        return bound(row_mapping(spans, options.language), named)

    found = found.withColumn("_row", bound(F.col("spans"), row))
    return found.withColumn("anonymized_text", F.col("_row.anonymized_text")).withColumn("mapping", F.col("_row.mapping")).drop("spans", "_row")


def explode_spans(found: DataFrame) -> DataFrame:
    return exploded(found, "spans", "s", "scope_id", "ord").select("scope_id", "ord", "s.start", "s.len", "s.original", "s.category")


#: Spans, texts and characters of a scope that is anonymised in one row.
FEW, FEW_CHARACTERS = 4096, 1 << 20


def scope_rows(found: DataFrame, language: str, seed: DataFrame | None = None, more: tuple[str, ...] = (), use: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``(scope_id, texts, mapping)``: scopes whose texts and spans ``found(scope_id, ord, text, spans, *more)`` are one row each, anonymised without joins of spans.

    ``use(texts, mapping)`` makes one more array of them, ``used``; with it, texts are shown beside what they become.
    """
    lean = F.transform("spans", lambda s: F.struct(s["start"], s["len"], s["original"], s["category"]))
    scopes = found.groupBy("scope_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text", lean.alias("spans"), *more))).alias("texts"))
    known = largest = None
    if seed is not None:
        scopes = scopes.join(seed_rows(seed), "scope_id", "left")
        known, largest = F.col("known"), F.col("largest")

    def mapped(v: Column) -> Column:
        first = F.get("every", v["first"])
        return F.struct(v["placeholder"], v["original"], v["category"], F.struct(first["ord"].alias("ord"), first["s"]["start"].alias("start")).alias("pos"))

    def done(x: Column, i: Column) -> Column:
        own = F.slice("labels", F.get("begins", i) + 1, F.size(x["spans"]))
        text = [] if use is None else [x["text"].alias("text")]
        return F.struct(x["ord"].alias("ord"), *text, bound(own, lambda own: splice(x["text"], x["spans"], own)).alias("anonymized_text"))

    # a projection a step: a lambda's result is copied by each lambda around it, a column's is not
    steps = scopes.withColumn("every", F.flatten(F.transform("texts", lambda x: F.transform(x["spans"], lambda s: F.struct(x["ord"].alias("ord"), s.alias("s"))))))
    steps = steps.withColumn("spans", F.col("every.s"))
    steps = steps.withColumn("m", scope_mapping(F.col("spans"), language, known, largest))
    steps = steps.select("scope_id", "texts", F.transform("m.values", mapped).alias("mapping"), F.col("m.labels").alias("labels"), prefix_sums(F.transform("texts", lambda x: F.size(x["spans"]))).alias("begins"))
    used = [] if use is None else [use(F.col("texts"), F.col("mapping")).alias("used")]
    steps = steps.select("scope_id", F.transform("texts", done).alias("done"), "mapping", *used)
    return materialize(steps.withColumnRenamed("done", "texts"), "scopes")


def _anonymize_few(found: DataFrame, language: str, seed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``anonymize_scopes`` for small scopes; texts without spans stay as they are and where they are."""
    rows = scope_rows(found.where("n_spans > 0"), language, seed)
    texts = found.where("n_spans = 0").select("scope_id", "ord", F.col("text").alias("anonymized_text"))
    return texts.unionByName(rows.select("scope_id", F.inline("texts"))), rows.select("scope_id", F.inline("mapping"))


def _anonymize_many(found: DataFrame, language: str, seed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``anonymize_scopes`` for scopes of any size: values are numbered and meet their spans as tables."""
    spans = explode_spans(found)
    mapping = materialize(build_mapping(spans, language, seed), "mapping")
    named = spans.withColumn("norm", normalize(F.col("original"))).join(mapping.select("scope_id", "category", "norm", "placeholder"), ["scope_id", "category", "norm"])
    per_text = named.groupBy("scope_id", "ord").agg(F.sort_array(F.collect_list(F.struct("start", "len", "placeholder"))).alias("s"))
    joined = found.join(per_text, ["scope_id", "ord"], "left")
    out = joined.select("scope_id", "ord", F.when(F.col("s").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("s"), F.transform("s", lambda s: s["placeholder"]))).alias("anonymized_text"))
    return out, mapping.select("scope_id", "placeholder", "original", "category", F.struct("ord", "start").alias("pos"))


def anonymize_scopes(texts: DataFrame, options: Options | None = None, findings: DataFrame | None = None, seed: DataFrame | None = None, terms: DataFrame | None = None, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Texts ``(scope_id, ord, text)`` that share one mapping per scope.

    Returns ``(scope_id, ord, anonymized_text)`` and the mapping ``(scope_id, placeholder, original, category, pos)``
    of the values used in this pass.  ``(scope_id, ord)`` must be unique.  Null texts become empty.
    Texts and their spans are a table in the shared folder, so detection runs once.  ``terms(seq, text)`` are custom
    terms of any number, beside those of the options.  Scopes of up to ``few`` texts and spans and ``FEW_CHARACTERS`` characters
    are a row each, also where they go on from an earlier mapping; larger ones are numbered as tables.
    """
    options = options or Options()
    texts = texts.select("scope_id", "ord", F.coalesce("text", F.lit("")).alias("text"))
    if terms is not None and options.custom:
        texts = table_candidates(texts, terms)
    found = accepted_spans(texts, options, findings)
    found = materialize(found.select("scope_id", "ord", "text", "spans", F.size("spans").alias("n_spans"), F.length("text").alias("n_chars")), "spans")
    return anonymize_found(found, options.language, seed, few)


def large_scopes(sizes: DataFrame, seed: DataFrame | None, few: int) -> DataFrame:
    """The ``scope_id`` of ``sizes`` and of earlier mappings of more than ``few`` values; null, if there is any, is among them."""
    if seed is not None:
        sizes = sizes.select("scope_id").unionByName(seed.groupBy("scope_id").count().where((F.col("count") > few) | F.col("scope_id").isNull()).select("scope_id"))
    return materialize(sizes.select("scope_id").distinct(), "many")


def without_scopes(df: DataFrame, many: DataFrame) -> DataFrame:
    return df.where("scope_id is not null").join(many, "scope_id", "left_anti")


def of_scopes(df: DataFrame, many: DataFrame) -> DataFrame:
    return df.join(many, df["scope_id"].eqNullSafe(many["scope_id"]), "left_semi")


def anonymize_found(found: DataFrame, language: str, seed: DataFrame | None = None, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """``anonymize_scopes`` of a table of texts whose spans ``(scope_id, ord, text, spans, n_spans, n_chars)`` are known."""
    sizes = found.where("n_spans > 0").groupBy("scope_id").agg(F.sum("n_spans").alias("n_spans"), F.sum("n_chars").alias("n_chars"))
    # a scope that is null is one of those that are joined
    many = large_scopes(sizes.where((F.col("n_spans") > few) | (F.col("n_chars") > FEW_CHARACTERS) | F.col("scope_id").isNull()), seed, few)
    if many.isEmpty():
        return _anonymize_few(found, language, seed)
    early, late = (None, None) if seed is None else (without_scopes(seed, many), of_scopes(seed, many))
    small, large = without_scopes(found, many), of_scopes(found, many)
    # texts of no scope that have no spans
    rest = found.where("scope_id is null") if many.where("scope_id is null").isEmpty() else found.where("false")
    parts = zip(_anonymize_few(small.unionByName(rest), language, early), _anonymize_many(large, language, late))
    texts, mapping = (a.unionByName(b) for a, b in parts)
    return texts, mapping
