"""Words with their boxes: recogniser output and text items of PDF pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least confidence of a word, and how far letters reach below the base line, in heights.
LEAST_CONFIDENCE = 30
DESCENDER = 0.28


def tsv_words(lines: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """``(page_id, word_idx, text, x0, y0, x1, y1)`` of recogniser lines ``(page_id, line_no, line)`` of twelve tab-separated columns."""
    c = F.split("line", "\t", -1)
    left, top, width, height, conf = (F.get(c, F.lit(i)).try_cast("double") for i in range(6, 11))
    text = F.trim(F.array_join(F.slice(c, F.lit(12), F.greatest(F.size(c) - 11, F.lit(0))), "\t"))
    words = lines.select("page_id", "line_no", F.size(c).alias("n"), F.get(c, F.lit(0)).alias("level"), left.alias("x0"), top.alias("y0"), (left + width).alias("x1"), (top + height).alias("y1"), conf.alias("conf"), text.alias("text"))
    kept = words.where((F.col("n") >= 12) & (F.col("level") == "5") & (F.col("text") != "") & F.col("x0").isNotNull() & F.coalesce(F.col("conf") >= least, F.lit(True)))
    return kept.select("page_id", F.col("line_no").alias("word_idx"), "text", "x0", "y0", "x1", "y1")


def matrix_product(a: Column, b: Column) -> Column:
    """The product of two affine 2 x 3 matrices, as arrays of six."""
    a0, a1, a2, a3, a4, a5 = (F.get(a, F.lit(i)) for i in range(6))
    b0, b1, b2, b3, b4, b5 = (F.get(b, F.lit(i)) for i in range(6))
    return F.array(a0 * b0 + a2 * b1, a1 * b0 + a3 * b1, a0 * b2 + a2 * b3, a1 * b2 + a3 * b3, a0 * b4 + a2 * b5 + a4, a1 * b4 + a3 * b5 + a5)


def pdf_words(items: DataFrame) -> DataFrame:
    """The same columns of PDF text items ``(page_id, idx, str, transform, width, viewport, scale)``; blank items are skipped."""
    tx = matrix_product(F.col("viewport"), F.col("transform"))
    kept = items.where((F.trim(F.regexp_replace("str", r"(?U)\s+", " ")) != "") & F.col("transform").isNotNull()).withColumn("tx", tx)
    height, x0, base = F.hypot(F.get("tx", F.lit(2)), F.get("tx", F.lit(3))), F.get("tx", F.lit(4)), F.get("tx", F.lit(5))
    return kept.select("page_id", F.col("idx").alias("word_idx"), F.col("str").alias("text"), x0.alias("x0"), (base - height).alias("y0"), (x0 + F.coalesce("width", F.lit(0.0)) * F.coalesce("scale", F.lit(1.0))).alias("x1"), (base + DESCENDER * height).alias("y1"))


def with_fallback(words: DataFrame, recognised: DataFrame) -> DataFrame:
    """Words of the text layer; recognised ones for pages without."""
    return words.unionByName(recognised.join(words.select("page_id").distinct(), "page_id", "left_anti"))
