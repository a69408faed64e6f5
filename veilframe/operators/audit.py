"""What was replaced, counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def audit_summary(mapping: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """``(scope_id, summary)``: ``"3 Platzhalter (name×2, email×1)"``, most frequent first, then by id; scopes of ``scopes`` without entries say ``"keine PII"``."""
    counts = mapping.groupBy("scope_id", "category").count()
    rows = counts.groupBy("scope_id").agg(F.sum("count").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("neg"), "category", "count"))).alias("c"))
    parts = F.array_join(F.transform("c", lambda c: F.concat(c["category"], F.lit("×"), c["count"].cast("string"))), ", ")
    out = rows.select("scope_id", F.concat(F.col("n").cast("string"), F.lit(" Platzhalter ("), parts, F.lit(")")).alias("summary"))
    if scopes is None:
        return out
    return scopes.select("scope_id").distinct().join(out, "scope_id", "left").withColumn("summary", F.coalesce("summary", F.lit("keine PII")))


def category_counts(mapping: DataFrame) -> DataFrame:
    """``(scope_id, category, n, rank)``: most frequent first, then by first appearance (``pos``)."""
    counts = mapping.groupBy("scope_id", "category").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy("scope_id").orderBy(F.desc("n"), "first"))
    return counts.select("scope_id", "category", "n", rank.alias("rank"))


def sensitive_count(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("scope_id").agg(F.count_if(F.col("category") == "sensitive").alias("n_sensitive"))
