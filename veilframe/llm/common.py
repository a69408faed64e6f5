"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import send_package
from ..shared import materialize, shared_path

__all__ = ["BROADCAST_LIMIT", "Memo", "broadcast_file", "byte_slices", "map_arrow", "materialize", "resident", "shared_path", "slices", "spread_join", "table"]

#: Largest file or table that may be sent to every executor, in bytes.
BROADCAST_LIMIT = 64 << 20


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    send_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, for functions that hold much more than their input."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def byte_slices(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes in a column of strings or binaries; a larger value stands alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


#: Keys with more rows than this, and more than one in ``HOT_SHARE`` of all rows, are split by ``spread_join``.
HOT_ROWS, HOT_SHARE = 1 << 17, 10_000


def spread_join(big: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """Join on ``key``, of which ``small`` has one row each, such that a frequent key's rows are split by column ``by``.

    The rows of ``counted`` (``big``, if not given; a table) tell how often keys occur.  Fewer than ``HOT_SHARE`` keys can be
    hot, so their list is small whatever the size of the tables.  ``how`` is inner or left.
    """
    counted = big if counted is None else counted
    total = counted.count()
    least = max(HOT_ROWS, total // HOT_SHARE)
    if total <= least:  # then no key is hot
        return big.join(small, key, how)
    hot = counted.groupBy(key).count().where(F.col("count") > least).select(key, F.ceil(F.col("count") / least).cast("int").alias("_parts")).toPandas()
    if not len(hot):
        return big.join(small, key, how)
    parts = F.broadcast(big.sparkSession.createDataFrame(hot, big.select(key, F.lit(0).alias("_parts")).schema))
    left = big.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    right = small.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_file(spark: SparkSession, path: str):
    """A small file's bytes, read by the driver and sent once to each executor."""
    with open(path, "rb") as f:
        data = f.read(BROADCAST_LIMIT + 1)
    if len(data) > BROADCAST_LIMIT:
        raise ValueError(f"{path} is larger than {BROADCAST_LIMIT} bytes")
    return spark.sparkContext.broadcast(data)


_RESIDENT: dict[tuple[str, bytes], object] = {}


def resident(kind: str, data: bytes, build: Callable[[bytes], object]) -> object:
    """What a worker keeps between tasks: the one object last built, so that operators that follow one another in a
    worker do not add up their memory."""
    key = kind, hashlib.blake2b(data, digest_size=16).digest()
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = build(data)
    return _RESIDENT[key]


class Memo(dict):
    """Remembers a function's results: the last ``limit`` new ones, and of the ``limit`` before those still asked for."""

    def __init__(self, function: Callable, limit: int):
        super().__init__()
        self.function, self.limit, self.before = function, limit, {}

    def __missing__(self, key: object) -> object:
        found = self.before.get(key)
        if found is None:
            found = self.function(key)
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        self[key] = found
        return found
