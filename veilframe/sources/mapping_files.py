"""Mappings as JSON files and as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..categories import category_id
from ..shared import exists, materialize

ENTRIES = "array<struct<placeholder:string,original:string,category:string>>"


def export_json(mapping: DataFrame) -> DataFrame:
    """``(scope_id, body)``: each scope's mapping as a JSON array, in the order of ``pos``."""
    rows = mapping.groupBy("scope_id").agg(F.sort_array(F.collect_list(F.struct("pos", "placeholder", "original", "category"))).alias("e"))
    return rows.select("scope_id", F.to_json(F.transform("e", lambda e: F.struct(e["placeholder"], e["original"], e["category"]))).alias("body"))


def entries(body: Column, limit: int | None = None) -> Column:
    """The usable entries of a mapping file; a malformed one has none, an unknown category is ``term``.

    With a ``limit`` in bytes a larger file is an error; without one files of any size are read.
    """
    found = F.from_json(body, ENTRIES)
    if limit is not None:
        found = F.when(F.octet_length(body) > limit, F.raise_error(F.lit(f"a mapping file is larger than {limit} bytes"))).otherwise(found)
    usable = F.filter(found, lambda e: e["placeholder"].isNotNull() & (e["placeholder"] != "") & e["original"].isNotNull())
    known = F.transform(usable, lambda e: e.withField("category", F.coalesce(category_id(e["category"]), F.lit("term"))))
    return F.coalesce(known, F.array().cast(ENTRIES))


def import_json(files: DataFrame, limit: int | None = None) -> DataFrame:
    """``(scope_id, pos, placeholder, original, category)`` of ``files(scope_id, body)``."""
    rows = files.select("scope_id", F.posexplode(entries(F.col("body"), limit)).alias("pos", "e"))
    return rows.select("scope_id", "pos", "e.placeholder", "e.original", "e.category")


def replace_imported(old: DataFrame, files: DataFrame) -> DataFrame:
    """Imported mappings replace their scopes'; empty imports change nothing."""
    new = import_json(files)
    kept = old.join(new.select("scope_id").distinct(), "scope_id", "left_anti")
    return kept.unionByName(new.select(*old.columns))


def save(mapping: DataFrame, path: str) -> None:
    mapping.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a saved mapping; nothing happens where there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Parts of a store; a scope lies in one of them.
BUCKETS = 256


def _bucket(scope: str = "scope_id") -> Column:
    return F.pmod(F.xxhash64(scope), F.lit(BUCKETS)).cast("int")


def _buckets_of(scopes: DataFrame) -> list[int]:
    return sorted(r.bucket for r in scopes.select(_bucket().alias("bucket")).distinct().collect())


def replace_scopes(spark: SparkSession, path: str, mapping: DataFrame, gone: DataFrame | None = None) -> None:
    """Put the mappings of the scopes in ``mapping`` into a store, in place of what it has of them, and remove those of ``gone(scope_id)``.

    The store is a table in ``BUCKETS`` parts by a hash of the scope.  Only parts of the scopes named are read and written;
    files of the others stay.  A part changes as a whole, so a scope is never seen half changed.  One writer per store.
    """
    scopes = mapping.select("scope_id")
    scopes = materialize((scopes if gone is None else scopes.unionByName(gone.select("scope_id"))).distinct(), "scopes")
    touched = _buckets_of(scopes)
    new = mapping.withColumn("bucket", _bucket())
    if exists(spark, path):
        kept = spark.read.parquet(path).where(F.col("bucket").isin(touched)).join(scopes, "scope_id", "left_anti")
        new = new.unionByName(kept.select(new.columns))
    new = materialize(new, "store")
    new.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for bucket in set(touched) - {r.bucket for r in new.select("bucket").distinct().collect()}:
        delete(spark, f"{path}/bucket={bucket}")


def load_scopes(spark: SparkSession, path: str, scopes: DataFrame | None = None) -> DataFrame | None:
    """A store's mappings, or those of ``scopes(scope_id)``, for which only their parts are read; None where there is no store."""
    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    if scopes is not None:
        rows = rows.where(F.col("bucket").isin(_buckets_of(scopes))).join(scopes.select("scope_id").distinct(), "scope_id", "left_semi")
    return rows.drop("bucket")
