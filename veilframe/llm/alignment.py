"""Cross-tokenizer alignment: which tokens of one vocabulary stand where tokens of another one do.

Side A is a byte-level BPE file, side B a SentencePiece BPE model.  A link is a token of A and a token of B in one text whose byte
ranges overlap.  Ids of B are dealt to stripes (``id % stripes``).  Each map task counts its pairs before anything is shuffled;
a stripe's counts are added up in one dense matrix, ids of the stripe by ids of A, whose row maxima are the best
partners.  Documents' links travel to their stripes too, and are scored there beside the matrix, several tasks to a stripe
that has many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_file, byte_slices, map_arrow, materialize, resident
from .unit_tokens import ByteLevel
from .units import SEGMENT, segments, split_units

STRIPES = 128
#: Units that a worker remembers.
UNITS = 250_000
#: Text of one block of documents, in bytes, and its largest number of documents.
BLOCK, DOCS = 8 << 20, 4096
#: Pairs that a map task counts before it hands them on, and entries of a row of counts.
PAIRS, ENTRIES = 4_000_000, 1 << 20
#: Bytes of links that one task scores.
PART = 256 << 20


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes((int(p[3:5], 16),)) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class Numbers(dict):
    """Numbers of units; new ones are listed."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        number = self[unit] = len(self)
        return number


class Aligner:
    """Both tokenizers, and what is known of units: token counts, groups and pairs.

    A unit's end is a token end on both sides, so groups and links never reach over units.
    """

    def __init__(self, spec: bytes, model: bytes, stripes: int):
        self.a = ByteLevel(spec, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        tokens = piece_bytes(self.b)
        if any(b" " in t.lstrip(b" ") for t in tokens) or self.b.encode("a b") != self.b.encode("a") + self.b.encode("b"):
            raise ValueError("a model is needed that adds a space in front, and whose pieces have spaces in front only")
        self.width, self.stripes = self.a.size, stripes
        self.rows = -(-len(tokens) // stripes)
        self.a_tokens = [self.a.tokens.get(i, b"") for i in range(self.a.size)]
        self.b_tokens = tokens
        self.a_bytes = np.array(list(map(len, self.a_tokens)), np.int64)
        self.b_bytes = np.array(list(map(len, tokens)), np.int64)
        # tokens as they are written: A within a group and at its end, B likewise
        self.written = [f"{i}," for i in range(self.a.size)] + [f"{i}|" for i in range(self.a.size)] + [f"{i}," for i in range(len(tokens))] + [f"{i};" for i in range(len(tokens))]
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        #: per unit: tokens of A and B, groups, links, whether it is none of the text
        self.facts = np.zeros((0, 5), np.int64)
        self.groups: list[str] = []
        self.pairs, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def numbers_of(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, split_units(text)), np.int64)

    def learn(self) -> None:
        """Tokenizes the units that are new."""
        units, self.numbers.new = self.numbers.new, []
        if not units:
            return
        texts = [" " + u for u in units]
        sides = [list(map(self.a.encode, texts)), self.b.encode(units, num_threads=1)]
        goal = [t.encode() for t in texts]
        bad = np.zeros(len(units), bool)
        for side, tokens in zip(sides, (self.a_tokens, self.b_tokens), strict=True):
            for i, (ids, want) in enumerate(zip(side, goal, strict=True)):
                if b"".join(map(tokens.__getitem__, ids)) != want:
                    bad[i] = True
        for i in np.flatnonzero(bad).tolist():
            sides[0][i] = sides[1][i] = []
        facts = np.zeros((len(units), 5), np.int64)
        facts[:, 4] = bad
        sizes = np.where(bad, 0, np.array(list(map(len, goal)), np.int64))
        ids, ends = [], []
        for k, (side, lengths) in enumerate(zip(sides, (self.a_bytes, self.b_bytes), strict=True)):
            facts[:, k] = list(map(len, side))
            flat = np.fromiter((i for own in side for i in own), np.int64, int(facts[:, k].sum()))
            ids.append(flat)
            ends.append(np.cumsum(lengths[flat]))
        unit_ends = np.cumsum(sizes)
        every, common = np.union1d(*ends), np.intersect1d(*ends, assume_unique=True)
        owner = np.searchsorted(unit_ends, every)
        facts[:, 3] = np.bincount(owner, minlength=len(units))
        facts[:, 2] = np.bincount(np.searchsorted(unit_ends, common), minlength=len(units))
        # between two ends that follow one another lies one link
        code = self.code(ids[0][np.searchsorted(ends[0], every)], ids[1][np.searchsorted(ends[1], every)])
        self.pairs = np.concatenate((self.pairs, code))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(facts[:, 3])))
        self.groups += self.spelled(ids, ends, common, facts[:, 0] + facts[:, 1])
        self.facts = np.concatenate((self.facts, facts))

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A pair's place: stripe, then row and column in the stripe's matrix."""
        return (b % self.stripes * self.rows + b // self.stripes) * self.width + a

    def spelled(self, ids: list[np.ndarray], ends: list[np.ndarray], common: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The groups of every unit, written out."""
        group = [np.searchsorted(common, e) for e in ends]
        last = [common[g] == e for g, e in zip(group, ends, strict=True)]
        order = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        order[np.arange(len(ids[0])) + np.searchsorted(group[1], group[0])] = ids[0] + self.width * last[0]
        order[np.arange(len(ids[1])) + np.searchsorted(group[0], group[1], "right")] = 2 * self.width + ids[1] + len(self.b_tokens) * last[1]
        parts, out, at = list(map(self.written.__getitem__, order.tolist())), [], 0
        for n in sizes.tolist():
            out.append("".join(parts[at : at + n])[:-1])
            at += n
        return out

    def pairs_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of units one after another, and for each the unit's place among ``units``."""
        sizes = self.facts[units, 3]
        place = np.repeat(np.arange(len(units)), sizes)
        within = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.pairs[self.starts[units][place] + within], place


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, and the sums of their times."""
    if not len(codes):
        return codes, times
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(times, first)


def small(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs: 1, 2, 4 or 8."""
    most = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(t).max)).tobytes()


def read_small(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


FIELDS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()), ("stripe", pa.int32()), ("docs", pa.int32()), ("sizes", pa.binary()), ("places", pa.binary()), ("keys", pa.binary()), ("times", pa.binary())]
LAYOUT = ", ".join(f"{n} {({'int64': 'long', 'int32': 'int'}).get(str(t), str(t))}" for n, t in FIELDS)


def rows_of(kind: pa.DataType, numbers: list[int], **columns: list | pa.Array) -> pa.RecordBatch:
    n = len(numbers)
    fields = [("doc_no", pa.int64()), ("id", kind), *FIELDS]
    values = {"doc_no": numbers, **columns}
    arrays = [(v if isinstance(v, pa.Array) else pa.array(v, t)) if (v := values.get(name)) is not None else pa.nulls(n, t) for name, t in fields]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


class TaskLinks:
    """What a map task makes: a row for each document, its links by stripes, and counts of pairs."""

    def __init__(self, aligner: Aligner, kind: pa.DataType, keep_groups: bool):
        self.aligner, self.kind, self.keep_groups = aligner, kind, keep_groups
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.held = 0

    def block(self, ids: pa.Array, texts: list[str | None], first: int) -> Iterator[pa.RecordBatch]:
        """Documents none of which is longer than a segment."""
        if len(self.aligner.numbers) > UNITS:
            self.aligner.forget()
        own = [self.aligner.numbers_of(t) if t else np.zeros(0, np.int64) for t in texts]
        self.aligner.learn()
        totals, spelled = np.zeros((len(texts), 4), np.int64), []
        kept = []
        for i, units in enumerate(own):
            good = len(units) and not self.aligner.facts[units, 4].any()
            kept.append(units if good else units[:0])
            if good:
                totals[i] = self.aligner.facts[units, :4].sum(0)
            spelled.append(";".join(map(self.aligner.groups.__getitem__, units.tolist())) if good else "")
        digests = [hashlib.sha256(s.encode()).hexdigest() if len(k) else "" for s, k in zip(spelled, kept, strict=True)]
        yield self.documents(ids, first, totals, digests, spelled)
        yield from self.links(kept, first)

    def long_document(self, ids: pa.Array, text: str, first: int) -> Iterator[pa.RecordBatch]:
        """One document, segment by segment: once to see whether both sides spell it, then for its links."""
        total, digest, spelled, good = np.zeros((1, 4), np.int64), hashlib.sha256(), [], True
        for segment in segments(text):
            units = self.known(segment)
            good = good and not self.aligner.facts[units, 4].any()
        for k, segment in enumerate(segments(text) if good else ()):
            units = self.known(segment)
            total[0] += self.aligner.facts[units, :4].sum(0)
            part = ";" * (k > 0) + ";".join(map(self.aligner.groups.__getitem__, units.tolist()))
            digest.update(part.encode())
            if self.keep_groups:
                spelled.append(part)
            yield from self.links([units], first)
        yield self.documents(ids, first, total, [digest.hexdigest() if good else ""], ["".join(spelled)])

    def known(self, segment: str) -> np.ndarray:
        if len(self.aligner.numbers) > UNITS:
            self.aligner.forget()
        units = self.aligner.numbers_of(segment)
        self.aligner.learn()
        return units

    def documents(self, ids: pa.Array, first: int, totals: np.ndarray, digests: list[str], spelled: list[str]) -> pa.RecordBatch:
        columns = {name: pa.array(totals[:, k]) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
        more = {"groups": spelled} if self.keep_groups else {}
        return rows_of(self.kind, list(range(first, first + len(digests))), id=ids, groups_sha256=digests, **columns, **more)

    def links(self, units: list[np.ndarray], first: int) -> Iterator[pa.RecordBatch]:
        """A row for each stripe: how many different pairs each document has there, which, and how often."""
        docs = len(units)
        number, aligner = np.concatenate(units), self.aligner
        if not len(number):
            return
        yield from self.count(*np.unique(number, return_counts=True))
        known, spread = len(aligner.facts), aligner.rows * aligner.width
        owner = np.repeat(np.arange(docs), list(map(len, units)))
        word, often = np.unique(owner * known + number, return_counts=True)
        code, place = aligner.pairs_of(word % known)
        stripe, key = code // spread, code % spread
        code, times = summed((stripe * docs + word[place] // known) * spread + key, often[place])
        stripe, doc, key = code // (docs * spread), code // spread % docs, code % spread
        cuts = np.searchsorted(stripe, np.arange(aligner.stripes + 1)).tolist()
        out: dict[str, list] = {k: [] for k in ("stripe", "sizes", "places", "keys", "times")}
        for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a == b:
                continue
            keys, places = np.unique(key[a:b], return_inverse=True)
            for name, value in (("stripe", s), ("sizes", small(np.bincount(doc[a:b], minlength=docs))), ("places", small(places)), ("keys", keys.astype("<u4").tobytes()), ("times", small(times[a:b]))):
                out[name].append(value)
        yield rows_of(self.kind, [first] * len(out["stripe"]), docs=[docs] * len(out["stripe"]), **out)

    def count(self, units: np.ndarray, often: np.ndarray) -> Iterator[pa.RecordBatch]:
        code, place = self.aligner.pairs_of(units)
        code, times = summed(code, often[place])
        self.codes.append(code)
        self.times.append(times)
        self.held += len(code)
        if self.held > PAIRS:
            self.codes, self.times = map(lambda x: [x], summed(np.concatenate(self.codes), np.concatenate(self.times)))
            self.held = len(self.codes[0])
            if self.held > PAIRS // 2:
                yield from self.counts()

    def counts(self) -> Iterator[pa.RecordBatch]:
        """The counts so far: a row for each stripe."""
        if not self.held:
            return
        codes, times = summed(np.concatenate(self.codes), np.concatenate(self.times))
        self.codes, self.times, self.held = [], [], 0
        spread = self.aligner.rows * self.aligner.width
        cuts = np.searchsorted(codes // spread, np.arange(self.aligner.stripes + 1)).tolist()
        there = [(s, a, b) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        yield rows_of(self.kind, [0] * len(there), stripe=[s for s, _, _ in there], keys=[(codes[a:b] % spread).astype("<u4").tobytes() for _, a, b in there], times=[small(times[a:b]) for _, a, b in there])


class Alignment:
    """The alignment of a table's texts: ``documents`` and ``links`` by row, and ``counts``, the matrices' entries."""

    def __init__(self, df: DataFrame, spec_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", stripes: int = STRIPES, keep_groups: bool = False):
        spec, model = broadcast_file(df.sparkSession, spec_path), broadcast_file(df.sparkSession, model_path)
        self.id_col, self.keep_groups, self.spark = id_col, keep_groups, df.sparkSession

        def aligner() -> Aligner:
            return resident("aligner", b"%d " % stripes + spec.value + model.value, lambda _: Aligner(spec.value, model.value, stripes))

        def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, number = None, TaskContext.get().partitionId() << 36
            for batch in byte_slices(batches, 1, BLOCK):
                task = task or TaskLinks(aligner(), batch.schema.field(0).type, keep_groups)
                texts, at = batch.column(1).to_pylist(), 0
                while at < len(texts):
                    end = at
                    while end < min(len(texts), at + DOCS) and len(texts[end] or "") <= SEGMENT:
                        end += 1
                    if end > at:
                        yield from task.block(batch.column(0)[at:end], texts[at:end], number)
                    else:
                        end = at + 1
                        yield from task.long_document(batch.column(0)[at:end], texts[at], number)
                    number, at = number + end - at, end
            if task:
                yield from task.counts()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for stripe, rows in by_stripe(batches, ("stripe",)):
                block = np.zeros(aligner_size(aligner()), np.int64)
                for row in rows:
                    key = np.frombuffer(row["keys"], "<u4")
                    np.add.at(block, key, read_small(row["times"], len(key)))
                key = np.flatnonzero(block)
                for at in range(0, len(key), ENTRIES):
                    part = key[at : at + ENTRIES]
                    yield pa.RecordBatch.from_pydict({"stripe": pa.array([stripe[0]], pa.int32()), "keys": pa.array([part.astype("<u4").tobytes()], pa.binary()), "times": pa.array([small(block[part])], pa.binary())})

        self.aligner = aligner
        kind = df.schema[id_col].dataType.simpleString()
        rows = map_arrow(df.select(df[id_col].alias("id"), df[text_col].alias("t")), align, f"doc_no long, id {kind}, {LAYOUT}")
        self.rows = materialize(rows, "alignment")
        self.documents = self.rows.where("stripe is null").select("doc_no", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * keep_groups)
        self.links = self.rows.where("docs is not null").select("doc_no", "stripe", "docs", "sizes", "places", "keys", "times")
        counted = self.rows.where("stripe is not null and docs is null").select("stripe", "keys", "times")
        self.counts = materialize(map_arrow(counted.repartition("stripe").sortWithinPartitions("stripe"), add, "stripe int, keys binary, times binary"), "pair-counts")

    def best_partners(self) -> DataFrame:
        """``(b, a, count)``: for every id of B that is linked at all, the ids of A linked to it most often."""
        aligner = self.aligner

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for stripe, rows in by_stripe(batches, ("stripe",)):
                block = filled(aligner(), rows)
                b, a = np.nonzero((block == block.max(1, keepdims=True)) & (block > 0))
                yield pa.RecordBatch.from_pydict({"b": pa.array(b * aligner().stripes + stripe[0], pa.int64()), "a": pa.array(a, pa.int64()), "count": pa.array(block[b, a], pa.int64())})

        return map_arrow(self.counts.repartition("stripe").sortWithinPartitions("stripe"), best, "b long, a long, count long")

    def scores(self) -> DataFrame:
        """``(doc_no, n_best, count_sum)`` of documents with links: scored where the links' stripes are.

        A stripe with more links than ``PART`` bytes is scored by several tasks, each with the stripe's matrix; at most
        as many numbers are collected as there are stripes.
        """
        aligner = self.aligner
        size = F.sum(F.octet_length("places") + F.octet_length("times"))
        parts = self.spark.createDataFrame([(r.stripe, max(1, -(-r.size // PART))) for r in self.links.groupBy("stripe").agg(size.alias("size")).collect()], "stripe int, parts long")
        links = self.links.join(F.broadcast(parts), "stripe").withColumns({"part": F.pmod(F.xxhash64("doc_no"), "parts"), "kind": F.lit(1)}).drop("parts")
        counts = self.counts.join(F.broadcast(parts), "stripe").withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)), "kind": F.lit(0)}).drop("parts")
        both = links.unionByName(counts, allowMissingColumns=True).select("stripe", "part", "kind", "doc_no", "docs", "sizes", "places", "keys", "times")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in by_stripe(batches, ("stripe", "part")):
                block, row, waiting = None, None, []
                for row in rows:
                    if row["kind"] == 0:
                        waiting.append(row)
                        continue
                    if block is None:
                        block = filled(aligner(), waiting)
                        most, flat = block.max(1), block.ravel()
                    sizes = read_small(row["sizes"], row["docs"])
                    n = int(sizes.sum())
                    key = np.frombuffer(row["keys"], "<u4").astype(np.int64)[read_small(row["places"], n)]
                    times, found = read_small(row["times"], n), flat[key]
                    doc = np.flatnonzero(sizes)
                    starts = (np.cumsum(sizes) - sizes)[doc]
                    good = np.where(found == most[key // aligner().width], times, 0)
                    yield pa.RecordBatch.from_pydict({"doc_no": pa.array(row["doc_no"] + doc, pa.int64()), "n_best": pa.array(np.add.reduceat(good, starts), pa.int64()), "count_sum": pa.array(np.add.reduceat(found * times, starts), pa.int64())})

        dealt = both.repartition("stripe", "part").sortWithinPartitions("stripe", "part", "kind")
        scored = map_arrow(dealt, score, "doc_no long, n_best long, count_sum long")
        return scored.groupBy("doc_no").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))

    def report(self) -> DataFrame:
        joined = self.documents.join(self.scores(), "doc_no", "left")
        none = F.lit(0).cast("long")
        return joined.select(F.col("id").alias(self.id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256", *["groups"] * self.keep_groups)


def aligner_size(aligner: Aligner) -> int:
    return aligner.rows * aligner.width


def filled(aligner: Aligner, rows: Iterator[dict] | list[dict]) -> np.ndarray:
    """A stripe's matrix from its entries."""
    block = np.zeros(aligner_size(aligner), np.int64)
    for row in rows:
        key = np.frombuffer(row["keys"], "<u4")
        block[key] = read_small(row["times"], len(key))
    return block.reshape(aligner.rows, aligner.width)


def by_stripe(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Sorted rows, one at a time, grouped by some columns."""
    rows = (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())
    return groupby(rows, key=lambda row: tuple(row[n] for n in names))


def align_tokenizers(df: DataFrame, spec_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", stripes: int = STRIPES, keep_groups: bool = False) -> DataFrame:
    """How the tokens of two tokenizers align in every whole text.

    A encodes a space and the text, B the text (it adds the space); no special tokens, their strings are plain text.  One row per
    input row: the id column, ``n_a``, ``n_b``, ``n_groups`` (stretches between bytes where both sides end a token),
    ``n_links`` (pairs of tokens that overlap), ``n_best`` (links whose pair is linked most often, over all texts, among
    those of its B id; ties count), ``count_sum`` (how often the links' pairs are linked over all texts), ``groups_sha256`` and, if
    ``keep_groups``, ``groups`` (``a1,a2|b1;a3|b2,b3``).

    Null and empty texts, and texts that either side does not spell byte for byte, have no tokens: zeros and ''.  Null and
    repeated ids are aligned row by row; further columns are ignored.  An empty table gives an empty table.  A map task counts
    pairs of its texts before they are shuffled, and a document sends each different pair once, so no frequent id gathers rows.
    """
    return Alignment(df, spec_path, model_path, id_col, text_col, stripes, keep_groups).report()
