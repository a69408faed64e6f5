"""SimHash near-duplicates with deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits have, cut into two segments of 32 bits, one segment
that differs in at most one bit.  So each distinct fingerprint is indexed under its exact segments and under every
variant of a segment with one bit deleted (a wildcard).  Fingerprints that share an exact segment, and those that
share a variant with different deleted bits, are the candidates; all 64 bits are then compared.

Index rows travel in bundles (one row for all entries of a task's batch that fall to a bucket).  Within a bucket
entries are sorted by key and compared group by group: small groups pair by pair, in blocks; in a group of more than
``LARGE`` fingerprints each is looked up under every possible difference (at most 5,488), which is linear in the group.
Only links that join two sets of a bucket for the first time are written, so links stay linear in the number
of fingerprints; components are what they define.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import map_arrow, materialize, spread_join
from .graph import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
BUCKETS_PER_PARTITION = 16
#: Groups of more fingerprints are not compared pair by pair.
LARGE = 1 << 17
#: Pairs compared at once.
PAIRS = 1 << 20
#: Shingle hashes whose bits are counted at once.
HASHES = 1 << 16


def majority(count: np.ndarray, total: int) -> int:
    return int(np.packbits(count * 2 > total, bitorder="little").view(np.uint64)[0])


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def signature(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes."""
    return majority(sum((bit_counts(hashes[i : i + HASHES]) for i in range(0, len(hashes), HASHES)), np.zeros(64, np.int64)), len(hashes))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    count, total = np.zeros(64, np.int64), 0
    last = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    for start in range(0, last, HASHES):
        stop = min(start + HASHES, last)
        joined = [b" ".join(words)] if last == 1 else map(b" ".join, zip(*(words[start + i : stop + i] for i in range(shingle)), strict=True))
        count += bit_counts(np.fromiter((digest(s, SEED) for s in joined), np.uint64, stop - start))
        total += stop - start
    return majority(count, total)


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)``, a row per input row; ``fp`` is the fingerprint as a signed long.  Narrow."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "fp": pa.array(found.view(np.int64))})

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(df[id_col].alias("id"), df[text_col].alias("t")), compute, f"id {kind}, fp long")


def index_entries(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints of all index entries.  A key holds the segment's number (bit 40), 1 + the deleted
    bit (bits 32 to 37; 0 for the exact segment) and the segment's other bits."""
    keys = []
    for number, shift in ((0, 0), (1, 32)):
        part = (fps >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)
        keys.append(part | np.uint64(number << 40))
        keys += [(part & np.uint64(0xFFFFFFFF ^ (1 << bit))) | np.uint64(number << 40 | (bit + 1) << 32) for bit in range(32)]
    return np.concatenate(keys), np.tile(fps, len(keys))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)) % np.uint64(buckets)


class Links:
    """Union-find over the fingerprints of one bucket; keeps the links that joined two sets."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.made: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def add(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.made.append((a, b))


def _compare(left: np.ndarray, right: np.ndarray, links: Links, distance: int, same: bool) -> None:
    """Link all pairs of two arrays within the distance, a block of pairs at a time."""
    rows = max(1, PAIRS // max(1, len(right)))
    for start in range(0, len(left), rows):
        block = left[start : start + rows]
        i, j = np.nonzero(np.bitwise_count(block[:, None] ^ right[None, :]) <= distance)
        if same:
            i, j = i[i + start < j], j[i + start < j]
        for a, b in zip(block[i].tolist(), right[j].tolist(), strict=True):
            links.add(a, b)


def _differences(shift: int, most: int) -> np.ndarray:
    """All masks of 1 to ``most`` bits among the 32 bits from ``shift`` on."""
    bits = [1 << (shift + i) for i in range(32)]
    return np.array([sum(c) for n in range(1, most + 1) for c in combinations(bits, n)], np.uint64)


def _look_up(left: np.ndarray, right: np.ndarray, masks: np.ndarray, links: Links) -> None:
    """Link each of ``left`` to those of ``right`` (sorted) from which it differs by a mask."""
    for mask in masks:
        wanted = left ^ mask
        at = np.searchsorted(right, wanted)
        at[at == len(right)] = 0
        for i in np.flatnonzero(right[at] == wanted).tolist():
            links.add(int(left[i]), int(wanted[i]))


def link_bucket(keys: np.ndarray, fps: np.ndarray, links: Links, distance: int = DISTANCE) -> None:
    """Compare the candidates of one bucket's entries."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
    keys, fps = keys[fresh], fps[fresh]
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    many = np.flatnonzero(np.diff(edges) > 1)
    for a, b in zip(edges[many].tolist(), edges[many + 1].tolist(), strict=True):
        group, key = fps[a:b], int(keys[a])
        deleted = (key >> 32 & 0xFF) - 1
        own, other = (32, 0) if key >> 40 else (0, 32)
        if deleted < 0:
            if len(group) > LARGE:
                _look_up(group, group, _differences(other, distance), links)
            else:
                _compare(group, group, links, distance, True)
            continue
        bit = (group >> np.uint64(deleted + own)) & np.uint64(1)
        if not bit.any() or bit.all():
            continue
        if len(group) > LARGE:
            flip = np.uint64(1 << (deleted + own))
            _look_up(group[bit == 0], group[bit == 1], np.append(_differences(other, distance - 1) | flip, flip), links)
        else:
            _compare(group[bit == 0], group[bit == 1], links, distance, False)


def links_between(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``(u, v)`` that connect the distinct fingerprints (column ``fp``) within ``distance`` bits.

    Not all pairs: within a bucket a link is written only where it joins two sets.
    """
    if not 1 <= distance <= DISTANCE:
        raise ValueError(f"two segments are enough for 1 to {DISTANCE} bits")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = parts * BUCKETS_PER_PARTITION

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 20_000):
                fps = batch.column(0).slice(part, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
                keys, owners = index_entries(fps)
                buckets = bucket_of(keys, n_buckets)
                order = np.argsort(buckets, kind="stable")
                keys, owners, buckets = keys[order], owners[order], buckets[order]
                edges = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1], [True])))
                pairs = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(buckets[edges[:-1]].astype(np.int32)),
                        "entries": pa.array([keys[a:b].tobytes() + owners[a:b].tobytes() for a, b in pairs], pa.binary()),
                    }
                )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def done(bundles: list[bytes]) -> pa.RecordBatch:
            links = Links()
            halves = [np.frombuffer(b, np.uint64).reshape(2, -1) for b in bundles]
            both = np.concatenate(halves, axis=1)
            link_bucket(both[0], both[1], links, distance)
            made = np.array(links.made, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_pydict({"u": pa.array(made[:, 0].copy()), "v": pa.array(made[:, 1].copy())})

        for batch in batches:
            for bucket, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and held:
                    yield done(held)
                    held = []
                now = bucket
                held.append(entries)
        if held:
            yield done(held)

    bundles = map_arrow(distinct.select("fp"), bundle, "bucket int, entries binary")
    return map_arrow(bundles.repartition(parts, "bucket").sortWithinPartitions("bucket"), link, "u long, v long").distinct()


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Near-duplicate classes.

    One row per input row: the id column, ``fingerprint`` (16 hexadecimal digits) and ``component_id``,
    the smallest id whose fingerprint is reachable over links.

    Null, empty and blank texts have fingerprint zero and are linked like any other.  A null id is never a
    component's smallest id unless all are null.  Repeated rows pass through; further columns are
    ignored, so their names cannot clash.  An empty table gives an empty table.
    """
    docs = materialize(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(docs.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    found = components(links_between(distinct, distance))
    whole = materialize(distinct.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "classes")
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    # a giant component, and the copies of one text, are split over many tasks
    names = spread_join(whole.select("fp", "component"), least, "component", "fp").select("fp", "component_id")
    named = spread_join(docs, names, "fp", "id")
    return named.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``df`` that are their near-duplicate class's smallest by id.

    Rows are judged by id and text, as an id may occur with texts of different classes.  Rows with a null id stay, and
    so do repeated rows of a class's smallest id and text.
    """
    # a null id comes last, so that it is a class's smallest only if all are null
    row = F.struct(df[id_col].isNull().alias("none"), df[id_col].alias("id"), F.xxhash64(df[text_col]).alias("h"))
    classes = group(df.select(row.alias("id"), df[text_col].alias("t")), "id", "t", shingle, distance)
    dropped = classes.where(~F.col("id.none") & (F.col("id") != F.col("component_id"))).select(F.col("id.id").alias("_gone"), F.col("id.h").alias("_gone_h")).distinct()
    return df.join(dropped, (df[id_col] == dropped["_gone"]) & (F.xxhash64(df[text_col]) == dropped["_gone_h"]), "left_anti")


def keep_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = jaccard.SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row, that of the smallest id, of each class of texts whose word shingles have a Jaccard similarity of 4/5 or more.

    The fingerprint index proposes the pairs and exact similarity verifies them.  Similar texts whose fingerprints differ
    in more than ``distance`` bits are found by the prefix filter of ``jaccard``, so that no class is split.
    Null, repeated and odd rows are treated as ``jaccard.keep_one`` says.
    """
    return jaccard.keep_one(df, id_col, text_col, shingle, signature, lambda distinct: links_between(distinct, distance))
