"""Substring de-duplication by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Its minimiser is the smallest hash of the ``MER`` consecutive
words inside it.  Consecutive windows with one minimiser form a super-k-mer, which travels as one packed string
(its words joined by spaces) to the bucket of its minimiser; equal windows have equal minimisers and so
meet in one bucket.  There windows are sorted, and every window's smallest document is found exactly.

Hot passages stay cheap.  Equal super-k-mers of one task's batch travel once, for the smallest document; the others'
windows are repeats already.  Windows of a very frequent minimiser travel alone, spread by their own hash.  Packed
strings travel in compressed bundles, one for each bucket and batch.

Only the verdicts (runs of repeated windows) travel back; whole texts never meet in one place, and a text is sent along,
compressed, to be cut.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

WINDOW = 13
MER = 2
BUCKETS_PER_PARTITION = 32
#: Documents sampled to find hot minimisers (one in SAMPLE); one is hot with more than one in HOT of all super-k-mers, or
#: more than CROWD times the mean of a bucket.
SAMPLE, HOT, CROWD = 32, 1000, 4
#: Bytes of packed strings that a task gathers before it sends bundles.
GATHER = 48 << 20
#: A null id compares as the largest.
LAST_ID = (1 << 63) - 1
MIX = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.uint64(0xD6E8FEB86659FD93)


_CODECS: list[tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]] = []


def codecs() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """A worker's compressor and decompressor; a new one for each small text would cost more than its work."""
    if not _CODECS:
        _CODECS.append((zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()))
    return _CODECS[0]


def squeeze(data: bytes) -> bytes:
    return codecs()[0].compress(data)


def unsqueeze(data: bytes) -> bytes:
    return codecs()[1].decompress(data)


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * FOLD
    return values ^ (values >> np.uint64(29))


def super_kmers(words: list[bytes], window: int = WINDOW, mer: int = MER) -> tuple[np.ndarray, np.ndarray]:
    """First windows of the super-k-mers (one more entry: the number of windows) and their minimisers."""
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(1, np.int64), np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    mers = len(words) - mer + 1
    mixed = np.zeros(mers, np.uint64)
    for i in range(mer):
        mixed = mix(mixed * MIX + hashes[i : i + mers])
    # the smallest of `span` consecutive values, from smallest values of powers of two
    span, width, least = window - mer + 1, 1, mixed
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(mixed) - span + 1], least[span - width : span - width + len(mixed) - span + 1])
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return np.append(starts, n), least[starts]


class Bundles:
    """Super-k-mers gathered by bucket; equal ones once, with all their places in the smallest document."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        #: packed string: document, its places (tag, first window), minimiser
        self.seen: dict[bytes, tuple[int, list[tuple[int, int]], int]] = {}
        #: repeats found here: document, tag, first window, number of windows
        self.repeats: list[tuple[int, int, int, int]] = []
        self.size = 0

    def add(self, packed: bytes, minimiser: int, doc: int, tag: int, start: int, count: int) -> None:
        other = self.seen.get(packed)
        self.size += 96
        if other is None:
            self.seen[packed] = (doc, [(tag, start)], minimiser)
            self.size += len(packed) + 160
        elif other[0] == doc:
            other[1].append((tag, start))
        elif other[0] < doc:
            self.repeats.append((doc, tag, start, count))
        else:
            self.repeats += [(other[0], t, s, count) for t, s in other[1]]
            self.seen[packed] = (doc, [(tag, start)], minimiser)

    def batches(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, bundle), and (-1 - bucket, repeats found here)."""
        by_bucket: dict[int, list] = defaultdict(list)
        for packed, (doc, places, minimiser) in self.seen.items():
            by_bucket[minimiser % self.buckets].append((packed, doc, places))
        for bucket, rows in by_bucket.items():
            yield bucket, pack_rows(rows)
        for i in range(0, len(self.repeats), 10_000):
            yield -1 - i // 10_000 % self.buckets, np.array(self.repeats[i : i + 10_000], np.int64).tobytes()
        self.clear()


def pack_rows(rows: list[tuple[bytes, int, list[tuple[int, int]]]]) -> bytes:
    """Packed strings as lines, with their documents (differences of the sorted ids) and places as arrays."""
    rows.sort(key=_document)
    places = [p for _, _, places in rows for p in places]
    docs = np.array([doc for _, doc, _ in rows], np.int64)
    docs[1:] -= docs[:-1].copy()
    counts = np.array([len(p) for _, _, p in rows], np.uint32)
    tags, starts = (np.array(x, np.uint32) for x in zip(*places, strict=True))
    head = np.array([len(rows), len(places)], np.int64)
    return squeeze(b"".join(x.tobytes() for x in (head, docs, counts, starts, tags)) + b"\n".join([packed for packed, _, _ in rows]))


def _document(row: tuple[bytes, int, list[tuple[int, int]]]) -> int:
    return row[1]


def unpack_rows(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Documents, numbers of places, places' first windows and tags, packed strings."""
    data = unsqueeze(data)
    n, m = np.frombuffer(data, np.int64, 2).tolist()
    at = 16 + 12 * n
    places = np.frombuffer(data, np.uint32, 2 * m, at)
    return np.cumsum(np.frombuffer(data, np.int64, n, 16)), np.frombuffer(data, np.uint32, n, 16 + 8 * n).astype(np.int64), places[:m].astype(np.int64), places[m:], data[at + 8 * m :].split(b"\n")


def judge(bundles: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, tags and first words of the bucket's windows that also occur in a smaller document."""
    *arrays, texts = (list(x) for x in zip(*map(unpack_rows, bundles), strict=True))
    docs, n_places, starts, tags = map(np.concatenate, arrays)
    number: dict[bytes, int] = {}
    words, sizes = [], []
    for text in (t for part in texts for t in part):
        found = [number.setdefault(w, len(number)) for w in text.split(b" ")]
        words += found
        sizes.append(len(found))
    words, sizes = np.array(words, np.uint64), np.array(sizes, np.int64)
    counts = sizes - window + 1
    owner = np.repeat(np.arange(len(sizes)), counts)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.repeat(np.cumsum(sizes) - sizes, counts) + step
    # sort by a hash of the word numbers, then by document; equal hashes are compared word by word
    hashes = np.zeros(len(first), np.uint64)
    for i in range(window):
        hashes = mix(hashes * MIX + words[first + i])
    order = np.lexsort((docs[owner], hashes))
    same_hash = hashes[order[1:]] == hashes[order[:-1]]
    equal = np.flatnonzero(same_hash)
    a, b = first[order[equal]], first[order[equal + 1]]
    clash = np.zeros(len(equal), bool)
    for i in range(window):
        clash |= words[a + i] != words[b + i]
    if clash.any():  # different windows with one hash: sort by all their words
        order = np.lexsort((docs[owner], *(words[first + i] for i in range(window))))
        same = np.ones(len(order) - 1, bool)
        for i in range(window):
            same &= words[first[order[1:]] + i] == words[first[order[:-1]] + i]
    else:
        same = same_hash
    group = np.concatenate(([0], np.cumsum(~same))) if len(order) else np.zeros(0, np.int64)
    least = docs[owner[order]][np.flatnonzero(np.concatenate(([True], ~same)))] if len(order) else docs[:0]
    hit = order[docs[owner[order]] > least[group]] if len(order) else order
    # each window that is hit, at all places of its super-k-mer
    times = n_places[owner[hit]]
    place = np.repeat((np.cumsum(n_places) - n_places)[owner[hit]] - np.cumsum(times) + times, times) + np.arange(times.sum())
    return np.repeat(docs[owner[hit]], times), tags[place], starts[place] + np.repeat(step[hit], times)


def runs(docs: np.ndarray, tags: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows of one row as arrays of document, tag, first window and number of windows."""
    order = np.lexsort((starts, tags, docs))
    docs, tags, starts = docs[order], tags[order], starts[order]
    new = np.ones(len(starts), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1]) | (starts[1:] > starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts))[: len(first)] - 1
    return docs[first], tags[first], starts[first], starts[last] - starts[first] + 1


def row_tag(text: bytes) -> int:
    """Keeps rows of one id but different texts apart."""
    return zlib.crc32(text)


def _sample_counts(df: DataFrame, window: int, mer: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [super_kmers((t.as_py() or "").encode().split(), window, mer)[1] for t in batch.column(0)]
            values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"m": pa.array(values.view(np.int64)), "n": pa.array(counts.astype(np.int64))})

    return map_arrow(df, count, "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))


def hot_minimisers(df: DataFrame, id_col: str, text_col: str, window: int, mer: int, buckets: int) -> frozenset[int]:
    """Frequent minimisers of every ``SAMPLE``-th document: fewer than ``HOT``, or than a ``CROWD``-th of the buckets.

    A bucket without them holds a few times the mean at most, however large the corpus.  They only change which way windows
    travel, never a result.
    """
    sample = df.where(F.pmod(F.xxhash64(id_col), F.lit(SAMPLE)) == 0).select(df[text_col].alias("t"))
    counts = materialize(_sample_counts(sample, window, mer), "minimisers")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r[0] & (1 << 64) - 1 for r in counts.where(F.col("n") > max(8, min(total // HOT, CROWD * total // buckets))).select("m").collect())


def repeated_windows(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW, mer: int = MER) -> DataFrame:
    """``(doc, tag, first, number)``: runs of windows, by document and tag of its text, that also start in a document of smaller id."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * BUCKETS_PER_PARTITION
    hot = hot_minimisers(df, id_col, text_col, window, mer, buckets)

    def bundle(found: Bundles) -> pa.RecordBatch:
        rows = list(found.batches())
        return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Bundles(buckets)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                words = data.split()
                edges, minimisers = super_kmers(words, window, mer)
                tag, place = row_tag(data), LAST_ID if doc is None else doc
                edges = edges.tolist()
                for a, b, m in zip(edges, edges[1:], minimisers.tolist(), strict=False):
                    if m not in hot:
                        found.add(b" ".join(words[a : b + window - 1]), m, place, tag, a, b - a)
                        continue
                    for i in range(a, b):  # windows of a hot minimiser travel alone, by their own hash
                        packed = b" ".join(words[i : i + window])
                        found.add(packed, xxhash.xxh64_intdigest(packed), place, tag, i, 1)
                if found.size > GATHER:
                    yield bundle(found)
        yield bundle(found)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def rows(*columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({name: pa.array(c.astype(np.int64)) for name, c in zip(("doc", "tag", "first", "number"), columns, strict=True)})

        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and held:
                    yield rows(*runs(*judge(held, window)))
                    held = []
                now = bucket
                if bucket < 0:
                    yield rows(*np.frombuffer(data.as_py(), np.int64).reshape(-1, 4).T)
                else:
                    held.append(data.as_py())
        if held:
            yield rows(*runs(*judge(held, window)))

    packed = map_arrow(df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("t")), split, "bucket int, data binary")
    return map_arrow(packed.repartition(parts, "bucket").sortWithinPartitions("bucket"), compare, "doc long, tag long, first long, number long")


def covered(n_words: int, firsts: np.ndarray, numbers: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie inside any of the windows."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, firsts, 1)
    np.add.at(change, firsts + numbers + window - 1, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mer: int = MER, keep_text: bool = False) -> DataFrame:
    """Remove every word covered by a window that also starts in a document of smaller id.

    One row per input row: the id column, ``n_words``, ``n_removed``, ``kept_sha256`` (kept words joined by one space)
    and, if ``keep_text``, ``kept_text``.  Windows are judged on the input.

    Null, empty and shorter texts have no window and stay whole.  A null id compares as the largest, rows of equal id
    are not repeats of one another.  Further columns are ignored, so their names cannot clash.  An empty table
    gives an empty table.  Ids of other than integer types are compared in Spark's order, by their ranks.
    """
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        ids = df.select(df[id_col].alias("id")).where("id is not null").distinct()
        ranks = materialize(ids.repartitionByRange("id").sortWithinPartitions("id").select("id", F.monotonically_increasing_id().alias("rank")), "ranks")
        ranked = df.select(df[id_col].alias("id"), df[text_col].alias("t")).join(ranks, "id", "left").select("rank", "t")
        out = remove_repeats(ranked, "rank", "t", window, mer, keep_text)
        return out.join(ranks, "rank", "left").select(F.col("id").alias(id_col), *out.columns[1:])
    found = repeated_windows(df, id_col, text_col, window, mer)
    per_row = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "number")).alias("runs"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            docs = [LAST_ID if d is None else d for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "doc": pa.array(docs, pa.int64()), "tag": pa.array(list(map(row_tag, texts)), pa.int64()), "data": pa.array(list(map(squeeze, texts)), pa.binary())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for data, hits in zip(batch.column(1), batch.column(2), strict=True):
                words, hits = unsqueeze(data.as_py()).split(), hits.as_py()
                n_words.append(len(words))
                if hits:
                    gone = covered(len(words), np.array([h["first"] for h in hits]), np.array([h["number"] for h in hits]), window)
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    texts.append(kept.decode())
            columns = {"id": batch.column(0), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if keep_text:
                columns["kept_text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    texts = map_arrow(df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("t")), whole, "id long, doc long, tag long, data binary")
    joined = texts.join(per_row, ["doc", "tag"], "left").select("id", "data", "runs")
    out = map_arrow(joined, cut, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)
    return out.select(F.col("id").cast(kind).alias(id_col), *out.columns[1:])
