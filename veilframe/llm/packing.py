"""Packing documents into sequences of a fixed length.

A document's ids (with an id at its end) are cut into whole sequences and a rest.  Rests are dealt to randomised groups of a
bounded number of tokens; each group packs by itself: first-fit decreasing, the first bin with room found in a
tournament tree of the bins' free capacities.  What then lies in the emptiest bins fills the gaps of the others, cut where it must
be, so that a group ends with full sequences and, for what is left, sequences of powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_file, byte_slices, map_arrow, materialize
from .unit_tokens import unit_ids_of

#: Tokens that a group holds on average.
GROUP_TOKENS = 1 << 19
#: Rows of a result batch.
ROWS = 1 << 14


class Bins:
    """Free capacities of bins in a tournament tree: each node knows the larger of its two sides, so the first bin with
    enough room is found from the root in one way down."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1
        while self.leaves < max(1, most):
            self.leaves *= 2
        self.tree = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """The first bin with room for ``size``, which is taken from it."""
        tree, node = self.tree, 1
        if tree[1] < size:
            raise ValueError(f"no bin has room for {size}")
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        found = node - self.leaves
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of every item; items of equal size go in the order given."""
    bins, out = Bins(capacity, len(sizes)), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.take(sizes[i])
    return out


def close_gaps(sizes: list[int], bins: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(item, start, size, bin, offset)`` such that all bins are full but for ones of powers of two.

    The fullest bins stay; the items of the others fill their gaps one after another and are cut at a gap's end.  What is left
    goes into bins of powers of two, the largest first.
    """
    loads: dict[int, int] = {}
    for size, b in zip(sizes, bins, strict=True):
        loads[b] = loads.get(b, 0) + size
    whole, rest = divmod(sum(sizes), capacity)
    kept = sorted(loads, key=lambda b: (-loads[b], b))[:whole]
    filled, out, given = dict.fromkeys(kept, 0), [], []
    for i, (size, b) in enumerate(zip(sizes, bins, strict=True)):
        if b in filled:
            out.append((i, 0, size, b, filled[b]))
            filled[b] += size
        else:
            given.append(i)
    fresh = max(loads, default=-1) + 1
    gaps = [(b, filled[b], capacity - filled[b]) for b in kept if filled[b] < capacity]
    gaps += [(fresh + k, 0, 1 << bit) for k, bit in enumerate(b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1)]
    places = iter(gaps)
    b, offset, room = next(places, (0, 0, 0))
    for i in sorted(given, key=lambda i: -sizes[i]):
        start = 0
        while start < sizes[i]:
            if not room:
                b, offset, room = next(places)
            size = min(room, sizes[i] - start)
            out.append((i, start, size, b, offset))
            start, offset, room = start + size, offset + size, room - size
    return out


def pack_documents(df: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, seed: int = 42, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``length`` tokens.

    A document's ids are those of a byte-level BPE file of the ``tokenizers`` library without tokens added at its ends (strings of
    added tokens inside a text are those tokens), then ``end_id``.  One row per piece: the id column, ``start`` (the
    document's ids before it), ``length``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers),
    ``doc_tokens`` (with the end), ``sequence_id``, ``offset`` (in the sequence) and, if ``keep_ids``, ``ids``.  Every id lies in one
    piece; sequences are full, or of a power of two, so none needs padding.

    Rests are shuffled once, by group; groups are drawn by a hash of the piece's number, so no id, null or text gathers
    in one.  A group has ``group_tokens`` tokens on average.  Null texts count as empty: their end is their only id.  Null
    and repeated ids are packed row by row; further columns are ignored.  An empty table gives an empty table.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("the length of sequences must be a power of two")
    spark, spec = df.sparkSession, broadcast_file(df.sparkSession, tokenizer_path)
    kind = df.schema[id_col].dataType.simpleString()
    ending, width = np.array([end_id], "<u4").tobytes(), 4 * length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = unit_ids_of(spec.value)
        piece = TaskContext.get().partitionId() << 36
        for batch in byte_slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            for i, text in enumerate(batch.column(1)):
                ids = ids_of.text_ids(text.as_py() or "") + ending
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    whole = len(part) == width
                    for column, value in zip(rows, (piece, i, at // 4, len(part) // 4, len(ids) // 4, zlib.crc32(part) if whole else None, part if keep_ids or not whole else None), strict=True):
                        column.append(value)
                    piece += 1
                    if len(rows[0]) >= ROWS:
                        yield made(batch, rows)
                        rows = ([], [], [], [], [], [], [])
            yield made(batch, rows)

    def made(batch: pa.RecordBatch, rows: tuple[list, ...]) -> pa.RecordBatch:
        piece, row, start, size, total, crc, ids = rows
        owner = batch.column(0).take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), owner, pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())], ["piece", "id", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    pieces = materialize(map_arrow(df.select(df[id_col].alias("id"), df[text_col].alias("t")), cut, f"piece long, id {kind}, start long, length long, doc_tokens long, ids_crc32 long, ids binary"), "pieces")
    kept = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids]
    # sequences of one piece have odd numbers, those of groups even ones
    full = pieces.where("ids_crc32 is not null").withColumns({"sequence_id": F.col("piece") * 2 + 1, "offset": F.lit(0).cast("long")}).select(kept)
    rests = pieces.where("ids_crc32 is null")
    groups = max(1, -(-(rests.agg(F.sum("length")).first()[0] or 0) // group_tokens))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("piece")
        sizes, ids = rows["length"].to_pylist(), rows["ids"].to_pylist()
        placed = close_gaps(sizes, first_fit_decreasing(sizes, length), length)
        item = pa.array([p[0] for p in placed], pa.int64())
        parts = [ids[i][4 * at : 4 * (at + n)] for i, at, n, _, _ in placed]
        base = rows["start"].to_pylist()
        columns = {
            "id": rows["id"].take(item),
            "start": pa.array([base[i] + at for i, at, _, _, _ in placed], pa.int64()),
            "length": pa.array([n for _, _, n, _, _ in placed], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
            "doc_tokens": rows["doc_tokens"].take(item),
            "sequence_id": pa.array([(key[0].as_py() << 32 | b) * 2 for _, _, _, b, _ in placed], pa.int64()),
            "offset": pa.array([o for _, _, _, _, o in placed], pa.int64()),
        }
        return pa.table(columns | ({"ids": pa.array(parts, pa.binary())} if keep_ids else {}))

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    grouped = rests.withColumn("group", F.pmod(F.xxhash64("piece", F.lit(seed)), F.lit(groups))).groupBy("group").applyInArrow(pack, schema)
    return full.unionByName(grouped).withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids)`` of pieces with ids: the rows that a model is trained on."""
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
