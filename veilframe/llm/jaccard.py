"""Near-duplicates by exact Jaccard similarity of word shingles.

Two sets of n and m shingles with a similarity of at least 4/5 share one of the first ``n - ceil(4 n / 5) + 1`` and
``m - ceil(4 m / 5) + 1`` shingles in any common order (prefix filter), so candidates are complete.  The order puts
frequent shingles last: which ones are taken for frequent comes from a sample and only changes the cost.

Candidates are compared in three steps: first those that a fingerprint index proposes (``signature`` and ``link``, if there
are) and each set with one other, the smallest that shares a key; then the sets of a key's group with ``HUBS`` of them,
which is linear in a group; then the sets of a key's group among each other; in the second and third step only
sets that are not yet in one class.  So a large group of near copies is hardly ever compared pair by pair, and classes
are those of all similar pairs, whatever the index found.

Groups of shingles that the sample shows to be very frequent are cut into parts, which are read by a task each; their parts
are compared in pairs of parts.  No task holds more than two parts.

Before texts meet, pairs are compared by parity sketches: every shingle flips one of a set's bits, so two sets differ in
at least as many shingles as their sketches differ in bits.  This rules most candidates out and no similar pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, slices, spread_join
from .graph import components

SHINGLE = 5
SEED = 42
#: Every so manieth text is looked at to find frequent shingles: those that so many of these texts hold.
SAMPLE, FREQUENT = 16, 4
#: At most so many shingles are put last.
MOST = 1 << 18
#: Pairs compared at once.
PAIRS = 1 << 18
#: Sets of a key's group that all others are compared with first.
HUBS = 8
#: A key's group of more sets than this is cut into parts of about this size.
PART = 1 << 16
#: Bits of the short sketches that travel with a key's entries.
SHORT = 1024


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's shingles in order, repeats included; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    last = max(1, len(words) - shingle + 1)
    joined = [b" ".join(words)] if last == 1 else map(b" ".join, zip(*(words[i : last + i] for i in range(shingle)), strict=True))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64, last)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the text's different shingles."""
    return np.unique(shingle_hashes(text, shingle))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity is 4/5 or more; empty sets are similar to each other."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def sketch(hashes: np.ndarray, bits: int | None = None) -> bytes:
    """The parities of the set's hashes modulo a power of two, if not given at least twice the set's size."""
    bits = bits or max(64, 1 << max(0, 2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def may_be_similar(a: bytes, b: bytes, sizes: int) -> bool:
    """Whether two sets of ``sizes`` shingles together can have a similarity of 4/5 or more."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= sizes


def frequent(df: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sample's frequent shingles: their sorted hashes, and into how many parts each one's group is cut."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_pydict({"h": pa.array(shingle_set(t.as_py(), shingle).view(np.int64))})

    sample = df.where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0).select(text_col)
    counts = map_arrow(sample, listed, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    most = counts.orderBy(F.desc("n"), "h").limit(MOST).toArrow()
    hashes, n = most.column(0).to_numpy().astype(np.int64).view(np.uint64), most.column(1).to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    return hashes[order], np.maximum(1, -(-n[order] * SAMPLE // PART))


def parts_of(hashes: np.ndarray, last: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Into how many parts the groups of shingles are cut."""
    if not len(last):
        return np.ones(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(last, hashes), len(last) - 1)
    return np.where(last[at] == hashes, parts[at], 1)


def prefix(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first shingles of a set, those in ``last`` (sorted) behind all others."""
    at = np.searchsorted(last, hashes)
    late = np.zeros(len(hashes), bool) if not len(last) else last[np.minimum(at, len(last) - 1)] == hashes
    n = len(hashes)
    return hashes[np.argsort(late, kind="stable")][: n + (-4 * n // 5) + 1 if n else 0]


def _possible(a: str, b: str) -> Column:
    """Whether two sets of sizes ``n`` can be similar if the shingles at ``pos`` are their first common ones."""
    return F.expr(f"5 * least({a}.n, {b}.n) >= 4 * greatest({a}.n, {b}.n) and 9 * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= 4 * ({a}.n + {b}.n)")


def _verified(pairs: DataFrame, marked: DataFrame, text: str, shingle: int) -> DataFrame:
    """The pairs ``(u, v)`` of similar sets: those that pass by their sketches, then by their texts.  A table."""
    pairs = materialize(pairs.distinct(), "candidates")
    sets = marked.select("d", "n", "sketch").dropDuplicates(["d"])
    both = spread_join(pairs, sets.toDF("u", "nu", "su"), "u", "v").join(sets.toDF("v", "nv", "sv"), "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist()
            good = [may_be_similar(a, b, n) for a, b, n in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), sizes, strict=True)]
            kept = batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, ["u", "v"])

    pairs = materialize(map_arrow(both.select("u", "v", "nu", "nv", "su", "sv"), compare, "u long, v long"), "sketched-pairs")
    nodes = pairs.select(F.col("u").alias("d")).unionByName(pairs.select(F.col("v").alias("d"))).distinct()
    texts = materialize(marked.select("d", F.col(text).alias("t")).join(nodes, "d", "left_semi").dropDuplicates(["d"]), "candidate-texts")
    both = spread_join(pairs.join(texts.toDF("v", "tv"), "v"), texts.toDF("u", "tu"), "u", "v", counted=pairs)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = np.zeros(0, np.uint64), None
        for batch in batches:
            good = []
            for u, tu, tv in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if u != known:
                    held, known = shingle_set(tu.as_py(), shingle), u
                good.append(similar(held, shingle_set(tv.as_py(), shingle)))
            kept = batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, ["u", "v"])

    return materialize(map_arrow(both.select("u", "v", "tu", "tv"), check, "u long, v long"), "similar")


def _parts(links: DataFrame) -> DataFrame:
    """``(d, part)``: the classes that links make so far."""
    return components(links).select(F.col("node").alias("d"), F.col("component").alias("part"))


def _across(hubs: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of sets of one group (rows come sorted by key and lot, which name it) that are in different classes and may be
    similar by size, place and short sketch; with ``hubs`` only those with one of a group's first sets."""

    def pairs(rows: np.ndarray, sketches: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, _, d, n, pos, part = rows
        first = len(d) if hubs is None else min(hubs, len(d))
        step = max(1, PAIRS // len(d))
        for a in range(0, first, step):
            left = slice(a, min(a + step, first))
            # each pair once: if both could stand left, the one of the smaller class does
            fits = (part[left, None] < part[None, :]) | ((part[left, None] != part[None, :]) & (np.arange(len(d)) >= first))
            fits &= 5 * np.minimum(n[left, None], n[None, :]) >= 4 * np.maximum(n[left, None], n[None, :])
            fits &= 9 * np.minimum((n - pos)[left, None], (n - pos)[None, :]) >= 4 * (n[left, None] + n[None, :])
            i, j = np.nonzero(fits)
            i += a
            near = 9 * np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j]
            if near.any():
                x, y = d[i[near]], d[j[near]]
                yield pa.RecordBatch.from_pydict({"u": pa.array(np.minimum(x, y)), "v": pa.array(np.maximum(x, y))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held = np.zeros((6, 0), np.int64), np.zeros((0, SHORT // 64), np.uint64)
        for batch in batches:
            rest = np.concatenate((rest, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]])), axis=1)
            held = np.concatenate((held, np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(-1, SHORT // 64)))
            edges = np.flatnonzero(np.concatenate(([True], (rest[:2, 1:] != rest[:2, :-1]).any(axis=0)))) if rest.shape[1] else np.zeros(0, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield from pairs(rest[:, a:b], held[a:b])
            if len(edges):
                rest, held = rest[:, edges[-1] :], held[edges[-1] :]
        if rest.shape[1]:
            yield from pairs(rest, held)

    return run


def _pairs_of_parts(parted: DataFrame) -> DataFrame:
    """The rows of each large group that has several classes, once for every pair of two of its parts; the pair is their ``lot``."""
    parted = materialize(parted, "parts")
    # as many keys as the sample may name, see MOST
    several = parted.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    other = F.explode(F.sequence(F.lit(0), F.col("lots") - 1))
    both = parted.join(F.broadcast(several), "key").withColumn("other", other).where("other <> lot")
    pair = F.greatest("lot", "other") * F.col("lots") + F.least("lot", "other")
    return both.select("key", pair.alias("lot"), "d", "n", "pos", "part")


def _proposed(marked: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs ``(u, v)`` of sets with equal or linked signatures; one set stands for each signature."""
    sets = marked.select("fp", "d").distinct()
    first = materialize(sets.groupBy("fp").agg(F.min("d").alias("u")), "signatures")
    equal = sets.join(first, "fp").where("d <> u").select("u", F.col("d").alias("v"))
    links = link(first.select("fp")).withColumnsRenamed({"u": "a", "v": "b"})
    pairs = links.join(first.select(F.col("fp").alias("a"), "u"), "a").join(first.select(F.col("fp").alias("b"), F.col("u").alias("v")), "b")
    return equal.unionByName(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


def keep_one(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    signature: Callable[[np.ndarray], int] | None = None,
    link: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row of each class of near-duplicates: the one of smallest id.

    A class is a component of the rows whose shingle sets have a Jaccard similarity of 4/5 or more.  Rows are judged, not
    ids: an id may occur with different texts, a null id comes last, and of repeated rows one stays.
    Null and blank texts are one class.  Columns of any name may be there.  An empty table gives an empty table.

    ``signature`` of a text's shingle hashes and ``link`` between the different signatures (column ``fp``, to pairs
    ``(u, v)``) propose pairs that are compared first.
    """
    names = {c: f"k{i}" for i, c in enumerate(df.columns)}
    id_, text = names[id_col], names[text_col]
    docs = df.toDF(*names.values())
    last = df.sparkSession.sparkContext.broadcast(frequent(docs, text, shingle))
    at = docs.columns.index(text)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            d, n, keys, fps, sketches, short = [], [], [], [], [], []
            for t in batch.column(at):
                hashes = shingle_hashes(t.as_py(), shingle)
                if signature:
                    fps.append(signature(hashes))
                hashes = np.unique(hashes)
                d.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                n.append(len(hashes))
                sketches.append(sketch(hashes))
                short.append(sketch(hashes, SHORT))
                keys.append(prefix(hashes, last.value[0]).tobytes())
            more = {"fp": pa.array(np.array(fps, np.uint64).view(np.int64)) if signature else pa.nulls(batch.num_rows, pa.int64())}
            more |= {"d": pa.array(np.array(d, np.uint64).view(np.int64)), "n": pa.array(n, pa.int64()), "keys": pa.array(keys, pa.binary()), "sketch": pa.array(sketches, pa.binary()), "short": pa.array(short, pa.binary())}
            yield pa.RecordBatch.from_pydict({f"k{i}": c for i, c in enumerate(batch.columns)} | more)

    schema = ", ".join(f"{c} {t}" for c, t in docs.dtypes) + ", fp long, d long, n long, keys binary, sketch binary, short binary"
    marked = materialize(map_arrow(docs, mark, schema).withColumn("uid", F.monotonically_increasing_id()), "shingles")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(k, np.int64) for k in batch.column(2).to_pylist()]
            for a in range(0, len(sets), 1000):
                sizes = [len(s) for s in sets[a : a + 1000]]
                d, n = (np.repeat(batch.column(i).to_numpy()[a : a + 1000], sizes) for i in (0, 1))
                pos = np.concatenate([np.arange(s, dtype=np.int64) for s in sizes])
                key = np.concatenate(sets[a : a + 1000])
                lots = parts_of(key.view(np.uint64), *last.value)
                lot = (d.view(np.uint64) % lots.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "d": pa.array(d), "n": pa.array(n), "pos": pa.array(pos), "lot": pa.array(lot), "lots": pa.array(lots)})

    entries = map_arrow(marked.select("d", "n", "keys").dropDuplicates(["d"]), spread, "key long, d long, n long, pos long, lot long, lots long")
    group = Window.partitionBy("key", "lot")
    seen = entries.withColumn("p", F.min(F.struct("d", "n", "pos")).over(group)).withColumn("size", F.count("*").over(group))
    shared = materialize(seen.where("size > 1 or lots > 1").drop("size"), "shared-shingles")

    fits = (F.col("d") != F.col("p.d")) & _possible("e", "p")
    near = shared.withColumn("e", F.struct("d", "n", "pos")).where(fits).groupBy(F.col("d").alias("v")).agg(F.min("p.d").alias("u")).select("u", "v")
    shared = shared.drop("p")
    if signature and link:
        near = near.unionByName(_proposed(marked, link))
    links = _verified(near, marked, text, shingle)

    short = marked.select("d", "short").dropDuplicates(["d"])
    for hubs in (HUBS, None):
        parted = shared.join(_parts(links), "d", "left").withColumn("part", F.coalesce("part", "d"))
        # within hubs' reach, and for whole groups, a group is a key's part; the rest meets in pairs of parts
        inner = parted if hubs else parted.where("lots = 1")
        mixed = inner.withColumn("lo", F.min("part").over(group)).withColumn("hi", F.max("part").over(group)).where("lo <> hi")
        mixed = mixed.select("key", "lot", "d", "n", "pos", "part")
        if not hubs and (last.value[1] > 1).any():
            mixed = mixed.unionByName(_pairs_of_parts(parted.where("lots > 1")))
        rows = mixed.join(short, "d").select("key", "lot", "d", "n", "pos", "part", "short").repartition("key", "lot").sortWithinPartitions("key", "lot", "d")
        links = links.unionByName(_verified(map_arrow(rows, _across(hubs), "u long, v long"), marked, text, shingle))

    found = components(links).select(F.col("node").alias("d"), "component")
    first = F.min(F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), "d", "uid"))
    least = marked.groupBy("d").agg(first.alias("least")).join(found, "d", "left").withColumn("component", F.coalesce("component", "d"))
    kept = least.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.uid").alias("uid"))
    return marked.join(kept, "uid", "left_semi").select(*(F.col(new).alias(old) for old, new in names.items()))
