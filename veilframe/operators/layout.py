"""Boxes over personal data on page images: words to lines, lines to texts, hits to boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLOCK, bound, exploded, occurrences, prefix_sums
from ..options import Options
from ..shared import materialize
from .anonymize import FEW, FEW_CHARACTERS, accepted_spans, anonymize_found, large_scopes, of_scopes, scope_rows, without_scopes
from .literals import terms_by_text

#: Words overlap by more than this share of the smaller height if they stand in one line.
LINE_OVERLAP = 0.4
#: Font sizes of placeholders, their share of the box's height, and the margin around a box.
LEAST_FONT, LARGEST_FONT, FONT_SHARE, MARGIN = 9, 72, 0.78, 2


def _same_line(up: Column, down: Column, y0: Column, y1: Column) -> Column:
    overlap = F.least(down, y1) - F.greatest(up, y0)
    smaller = F.greatest(F.lit(1.0), F.least(down - up, y1 - y0))
    return F.coalesce(overlap / smaller > LINE_OVERLAP, F.lit(True))


def with_lines(words: DataFrame) -> DataFrame:
    """Adds ``line_no`` to words ``(page_id, word_idx, text, x0, y0, x1, y1)``: a word joins the line of the word before it if
    the two overlap enough vertically, or if either has no box."""
    w = Window.partitionBy("page_id").orderBy("word_idx")
    same = _same_line(F.lag("y0").over(w), F.lag("y1").over(w), F.col("y0"), F.col("y1"))
    return words.withColumn("_new", F.when(F.lag("word_idx").over(w).isNotNull() & ~same, 1).otherwise(0)).withColumn("line_no", F.sum("_new").over(w).cast("int")).drop("_new")


def line_texts(lined: DataFrame) -> DataFrame:
    """``(page_id, line_no, text, words)``: words joined by spaces, with their places in the text."""
    rows = lined.groupBy("page_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("word_idx", "text", "x0", "y0", "x1", "y1"))).alias("w"))
    ends = F.transform("w", lambda _, i: F.aggregate(F.slice("w", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x["text"]) + 1))
    placed = F.zip_with("w", ends, lambda x, s: F.struct(x["word_idx"].alias("word_idx"), s.alias("start"), (s + F.length(x["text"])).alias("end"), x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1")))
    return rows.select("page_id", "line_no", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), placed.alias("words"))


#: A box's coordinates.
BOX = ("x0", "y0", "x1", "y1")


def page_lines(words: DataFrame) -> DataFrame:
    """``(page_id, line_no, text, lens, x0, y0, x1, y1)``: the lines and texts of ``line_texts(with_lines(words))``, with the lengths and boxes of a
    line's words as arrays.  A page is one row, cut into its lines in one pass; words without text stand in none (their length is null)."""
    pages = words.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("word_idx", "text", *BOX))).alias("w"))

    def begins(w: Column) -> Column:
        def new(x: Column, i: Column) -> Column:
            before = F.get(w, i - 1)
            return F.when((i == 0) | ~_same_line(before["y0"], before["y1"], x["y0"], x["y1"]), i.cast("int"))

        return F.filter(F.transform(w, new), lambda i: i.isNotNull())

    # a projection a step: a lambda's result is copied by each lambda around it, a column's is not
    cut = pages.withColumn("b", begins(F.col("w")))
    own = F.transform("b", lambda s, k: F.struct(k.cast("int").alias("line_no"), F.slice("w", s + 1, F.coalesce(F.get("b", k + 1), F.size("w")) - s).alias("own")))
    text = F.col("own.text")
    return cut.select("page_id", F.inline(own)).select("page_id", "line_no", F.array_join(text, " ").alias("text"), F.transform(text, F.length).alias("lens"), *(F.col(f"own.{c}").alias(c) for c in BOX))


def _starts(lens: Column) -> Column:
    """Where a line's words start in its text."""
    sizes = F.transform(lens, lambda n: F.coalesce(n + 1, F.lit(0)))
    short = bound(sizes, lambda sizes: F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x)))
    return F.when(F.size(lens) <= BLOCK, short).otherwise(prefix_sums(sizes))


def _placed() -> Column:
    """The words of a line ``(lens, starts, x0, ...)`` that have a text and a box, with their places."""
    every = F.transform("lens", lambda n, i: F.struct(i.cast("int").alias("word_idx"), F.get("starts", i).alias("start"), (F.get("starts", i) + n).alias("end"), *(F.get(c, i).alias(c) for c in BOX)))
    return F.filter(every, lambda w: w["end"].isNotNull() & w["x0"].isNotNull())


def page_texts(lines: DataFrame, text: str = "text") -> DataFrame:
    joined = lines.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("line_no", F.col(text).alias("t")))).alias("l"))
    return joined.select("page_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))


def word_texts(lined: DataFrame) -> DataFrame:
    """``page_texts`` of ``line_texts``, straight from words with ``line_no``: each page is put together once, without its words' places.
    Words without text are left out."""
    pages = lined.where("text is not null").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "word_idx", "text"))).alias("w"))

    def joined(w: Column) -> Column:
        return F.array_join(F.transform(w, lambda x, i: F.concat(F.when(i == 0, "").when(F.get(w, i - 1)["line_no"] == x["line_no"], " ").otherwise("\n"), x["text"])), "")

    return pages.select("page_id", bound(F.col("w"), joined).alias("text"))


#: Bits of a mask in ``first_ranges``, so many characters are a bin.
BIN = 64


def _masks(start: Column, end: Column) -> tuple[Column, Column]:
    """The places from ``start`` to ``end`` of two bins (0 to 127) as bits of two longs."""

    def bits(a: Column, b: Column) -> Column:
        a, b = F.greatest(a, F.lit(0)).cast("int"), F.least(b, F.lit(BIN)).cast("int")
        return F.when(a >= b, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), BIN - (b - a)), a))

    return bits(start, end), bits(start - BIN, end - BIN)


def first_ranges(pieces: DataFrame, ranges: DataFrame, key: tuple[str, ...], order: str = "seq") -> DataFrame:
    """``pieces(*key, start, end, ...)`` with ``hit``: the first range ``(*key, start, end, order, ...)`` by ``order`` that overlaps them.

    Of equal ranges only the first stays.  Ranges are cut to windows of two bins of ``BIN`` characters, one window at every bin, and of a window's ranges only those
    stay that are the first at some of its places: at most ``2 * BIN``.  A piece of up to ``BIN`` characters lies within the window at its
    first bin, so it meets one row and is moved once; longer ones meet every other window that they reach, and their parts are put
    together again.  So no pairs of pieces and ranges are made, however many share a bin.

    Pieces without a range, null keys, and pieces and ranges without length have none.  ``order`` must be unique within a key; texts of any
    length, and tables of any size.
    """
    others = [c for c in ranges.columns if c not in (*key, "start", "end", order)]
    distinct = ranges.where("start < end").groupBy(*key, "start", "end").agg(F.min(order).alias(order), *(F.min_by(c, order).alias(c) for c in others))
    row = F.struct(*(c for c in ranges.columns if c not in key))
    first, last = F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN)
    cut = distinct.select(*key, row.alias("_range"), F.col(order).alias("_order"), "start", "end", F.explode(F.sequence(first - 1, last)).alias("_bin"))
    low, high = _masks(F.col("start") - F.col("_bin") * BIN, F.col("end") - F.col("_bin") * BIN)
    cut = cut.select(*key, "_bin", F.struct("_order", low.alias("low"), high.alias("high"), F.col("_range").alias("range")).alias("_r"))
    # of ranges with the same part in a window the first stays, before any are put together
    cut = cut.groupBy(*key, "_bin", "_r.low", "_r.high").agg(F.min_by("_r", "_r._order").alias("_r"))

    def seen(acc: Column, r: Column) -> Column:
        new = (r["low"].bitwiseAND(F.bitwise_not(acc["low"])) != 0) | (r["high"].bitwiseAND(F.bitwise_not(acc["high"])) != 0)
        return F.when(new, F.struct(acc["low"].bitwiseOR(r["low"]).alias("low"), acc["high"].bitwiseOR(r["high"]).alias("high"), F.concat(acc["kept"], F.array(r)).alias("kept"))).otherwise(acc)

    zero = F.lit(0).cast("long")
    every = F.sort_array(F.collect_list("_r"))
    windows = cut.groupBy(*key, "_bin").agg(every.alias("_every"))
    kept = F.aggregate("_every", F.struct(zero.alias("low"), zero.alias("high"), F.slice("_every", F.lit(1), F.lit(0)).alias("kept")), seen, lambda acc: acc["kept"])
    windows = windows.select(*key, "_bin", kept.alias("_kept"))

    def hit(rows: DataFrame) -> DataFrame:
        at = F.get(F.filter("_kept", lambda r: (F.col("start") < r["range"]["end"]) & (r["range"]["start"] < F.col("end"))), F.lit(0))
        met = rows.join(windows, [*key, "_bin"], "left").withColumn("hit", at["range"])
        return met.drop("_kept", "_bin")

    long = F.coalesce(F.col("end") - F.col("start") > BIN, F.lit(False))
    # a piece without length is in no window
    short = hit(pieces.where(~long).withColumn("_bin", F.when(F.col("start") < F.col("end"), first))).select(*pieces.columns, "hit")
    parts = hit(pieces.where(long).withColumn("_piece", F.monotonically_increasing_id()).withColumn("_bin", F.explode(F.sequence(first, last, F.lit(2).cast("long")))))
    joined = parts.groupBy("_piece").agg(F.first(F.struct(*pieces.columns)).alias("_row"), F.min_by("hit", f"hit.{order}").alias("hit"))
    return short.unionByName(joined.select(*(F.col("_row")[c].alias(c) for c in pieces.columns), "hit"))


def original_ranges(lines: DataFrame, mapping: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``(*key, seq, start, end, category, placeholder)``: where originals of a scope's ``mapping`` stand in its ``lines(*key,
    scope_id, text)``; ``seq`` orders by ``pos`` of the mapping, then place.  A line only looks for what it can hold."""
    terms = mapping.where("original <> ''").select("scope_id", "pos", F.col("original").alias("text"), "category", "placeholder")
    found = terms_by_text(lines, terms, key, "scope_id")
    joined = lines.select(*key, "text").join(found, list(key))

    def places(m: Column) -> Column:
        starts = occurrences(F.col("text"), m["text"])
        return F.transform(starts, lambda s: F.struct(F.struct(m["pos"].alias("pos"), m["placeholder"].alias("name"), s.alias("at")).alias("seq"), s.alias("start"), (s + F.length(m["text"])).alias("end"), m["category"].alias("category"), m["placeholder"].alias("placeholder")))

    return exploded(joined.withColumn("r", F.flatten(F.transform("found", places))), "r", "r", *key).select(*key, "r.*")


#: Words of a line, and spans times characters of a scope, that are met with each other in one row.
FEW_WORDS, FEW_STEPS = 1024, 1 << 28


def _held_ranges(lines: Column, mapping: Column) -> Column:
    """Those of one scope's ``lines`` (``array<struct<ord, text, lens, x0, ...>>``) in which originals of its mapping stand, with ``ranges`` in the order of
    numbering, then place; none of these is large."""

    def starts(text: Column, original: Column) -> Column:
        # most stand in a line once
        once = F.call_function("locate", original, text, F.call_function("locate", original, text) + F.length(original)) == 0
        return F.when(once, F.array(F.call_function("locate", original, text) - 1)).otherwise(occurrences(text, original))

    def ranges(text: Column, terms: Column) -> Column:
        def places(m: Column) -> Column:
            return F.transform(starts(text, m["original"]), lambda s: F.struct(s.alias("start"), (s + F.length(m["original"])).alias("end"), m["category"].alias("category"), m["placeholder"].alias("placeholder")))

        return F.flatten(F.transform(F.filter(terms, lambda m: F.contains(text, m["original"])), places))

    def held(terms: Column) -> Column:
        every = F.transform(lines, lambda x: F.struct(x["ord"]["page_id"].alias("page_id"), *(x[c].alias(c) for c in ("lens", *BOX)), ranges(x["text"], terms).alias("ranges")))
        return F.filter(every, lambda x: F.size(x["ranges"]) > 0)

    terms = F.array_sort(F.transform(F.filter(mapping, lambda m: m["original"] != ""), lambda m: F.struct(m["pos"], m["placeholder"], m["original"], m["category"])))
    return bound(terms, held)


def _row_boxes(lines: DataFrame) -> DataFrame:
    """The boxes of lines ``(page_id, lens, x0, y0, x1, y1, ranges)``, each by itself: a word belongs to the first of the ranges that overlap it."""

    def first(w: Column) -> Column:
        return F.array_min(F.transform("ranges", lambda r, k: F.when((w["start"] < w["end"]) & (r["start"] < w["end"]) & (w["start"] < r["end"]), k.cast("int"))))

    placed = lines.withColumn("starts", _starts(F.col("lens"))).select("page_id", "ranges", _placed().alias("w"))
    hits = placed.select("page_id", "ranges", F.transform("w", lambda w: F.struct(first(w).alias("k"), *(w[c].alias(c) for c in BOX))).alias("hits"))
    heads = F.filter(F.transform("hits", lambda h, i: F.when((i == 0) | ~h["k"].eqNullSafe(F.get("hits", i - 1)["k"]), i.cast("int"))), lambda i: i.isNotNull())
    cut = hits.withColumn("b", heads)
    own = F.transform("b", lambda s, j: F.struct(F.slice("hits", s + 1, F.coalesce(F.get("b", j + 1), F.size("hits")) - s).alias("own")))
    islands = cut.select("page_id", "ranges", F.inline(own)).select("page_id", F.get("ranges", F.get("own", F.lit(0))["k"]).alias("r"), "own")
    edges = (F.array_min("own.x0").alias("x0"), F.array_min("own.y0").alias("y0"), F.array_max("own.x1").alias("x1"), F.array_max("own.y1").alias("y1"))
    return islands.where("r is not null").select("page_id", *edges, "r.category", "r.placeholder")


def _table_boxes(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """The boxes of lines and mappings of any size, which meet as tables."""
    key = ("page_id", "line_no")
    ranges = materialize(original_ranges(lines, mapping, key), "ranges")
    met = lines.join(ranges.select(*key).distinct(), list(key), "left_semi")
    pieces = met.withColumn("starts", _starts(F.col("lens"))).select(*key, F.explode(_placed()).alias("w")).select(*key, "w.*")
    rows = first_ranges(pieces, ranges, key)
    w = Window.partitionBy(*key).orderBy("word_idx")
    rows = rows.withColumn("island", F.sum(F.when(F.col("hit.seq").eqNullSafe(F.lag("hit.seq").over(w)), 0).otherwise(1)).over(w)).where("hit is not null")
    boxes = rows.groupBy(*key, "island").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first("hit.category").alias("category"), F.first("hit.placeholder").alias("placeholder"))
    return boxes.select("page_id", *BOX, "category", "placeholder")


def plan_redaction(words: DataFrame, options: Options | None = None, findings: DataFrame | None = None, seed: DataFrame | None = None, scope: Column | None = None, few: int = FEW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxes ``(page_id, x0, y0, x1, y1, category, placeholder)``, lines with their anonymised texts, and the mapping.

    Each line is searched by itself; the mapping's scope is the page, or what ``scope`` says (a document).  Every occurrence of
    an original in a line gets a box, words that belong to one occurrence share it; where originals overlap, the one that was
    numbered first counts.  Lines are ordered by page and line without any scope in one task.

    Lines and their spans are written once.  Scopes without spans are done then; others of up to ``few`` lines and spans, and as the limits above say, are
    numbered, replaced and boxed in a row each, and larger ones as tables.
    """
    options = options or Options()
    scope = F.col("page_id") if scope is None else scope
    lines = page_lines(words).withColumn("scope_id", scope).withColumn("ord", F.struct("page_id", "line_no"))
    found = accepted_spans(lines, options, findings)
    lean = F.transform("spans", lambda s: F.struct(s["start"], s["len"], s["original"], s["category"]))
    found = materialize(found.select("scope_id", "ord", "page_id", "line_no", "text", "lens", *BOX, lean.alias("spans"), F.size("spans").alias("n_spans"), F.length("text").alias("n_chars")), "spans")
    n_spans, n_chars = F.col("n_spans"), F.col("n_chars")
    sizes = found.groupBy("scope_id").agg(F.sum("n_spans").alias("n_spans"), F.sum("n_chars").alias("n_chars"), F.count("*").alias("n_lines"), F.max(F.size("lens")).alias("n_words"))
    large = (n_spans + F.col("n_lines") > few) | (n_chars > FEW_CHARACTERS) | (n_spans * n_chars > FEW_STEPS) | (F.col("n_words") > FEW_WORDS) | F.col("scope_id").isNull()
    hit = materialize(sizes.where("n_spans > 0").select("scope_id", large.alias("large")), "sizes")
    many = large_scopes(hit.where("large"), seed, few)
    none = many.isEmpty()
    plain = found.join(hit.select("scope_id"), found["scope_id"].eqNullSafe(hit["scope_id"]), "left_anti").select("page_id", "line_no", "text", F.col("text").alias("anonymized_text"))
    small = found.join(hit.where("not large").select("scope_id"), "scope_id", "left_semi")
    early = seed
    if not none:
        small = without_scopes(small, many)
        early = None if seed is None else without_scopes(seed, many)
    rows = scope_rows(small, options.language, early, ("lens", *BOX), _held_ranges)
    boxes, mapping = _row_boxes(rows.select(F.inline("used"))), rows.select("scope_id", F.inline("mapping"))
    done = plain.unionByName(rows.select(F.inline("texts")).select("ord.page_id", "ord.line_no", "text", "anonymized_text"))
    if none:
        return boxes, done, mapping
    rest = of_scopes(found.join(hit.select("scope_id"), found["scope_id"].eqNullSafe(hit["scope_id"]), "left_semi"), many)
    texts, more = anonymize_found(rest.select("scope_id", "ord", "text", "spans", "n_spans", "n_chars"), options.language, None if seed is None else of_scopes(seed, many), few)
    done = done.unionByName(rest.join(texts, ["scope_id", "ord"]).select("page_id", "line_no", "text", "anonymized_text"))
    return boxes.unionByName(_table_boxes(rest, more)), done, mapping.unionByName(more)


def placeholder_boxes(boxes: DataFrame, char_width: float = 0.6) -> DataFrame:
    """Adds the drawn box ``(bx0, by0, bx1, by1)`` and ``font_size`` for a font whose letters are ``char_width`` sizes wide: the
    largest size that fits, and if even the smallest does not, a box that reaches further right (up to ``canvas_width``)."""
    x0, y0 = F.greatest(F.lit(0.0), F.col("x0") - MARGIN), F.greatest(F.lit(0.0), F.col("y0") - MARGIN)
    y1, right = F.col("y1") + MARGIN, F.col("x1") + MARGIN
    letters = F.length("placeholder") * char_width
    tallest = F.greatest(F.lit(LEAST_FONT), F.least(F.lit(LARGEST_FONT), F.floor(F.greatest(F.lit(1.0), y1 - y0) * FONT_SHARE)))
    fitting = F.floor(F.greatest(F.lit(1.0), right - x0) / letters)
    size = F.greatest(F.lit(LEAST_FONT), F.least(tallest, fitting)).cast("int")
    needed = letters * size + 2 * MARGIN
    x1 = F.when(needed > right - x0, F.least(F.col("canvas_width").cast("double"), x0 + needed)).otherwise(right)
    return boxes.withColumns({"bx0": x0, "by0": y0, "bx1": x1, "by1": y1, "font_size": size})
