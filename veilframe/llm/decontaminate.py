"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of ten consecutive words of a benchmark text (question or answer), and every shorter text as
a whole, is a pattern.  Words are normalised and numbered, and the automaton reads word numbers, so a pattern matches
whole words only and takes a node for a word.  A document is normalised the same way and scanned once; matches
are mapped back to word places and from there to offsets in the original text.

A benchmark whose automaton would have more than ``NODES`` nodes is cut into blocks of items.  Each block has one
automaton and reads the documents once more; hits and items are united.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, resident

#: Words of a window.
WINDOW = 10
#: Nodes of an automaton (about 100 bytes each).
NODES = 2_000_000
#: Upper-case A-Z become lower-case, what separates words becomes a space; other bytes stay (UTF-8 letters are bytes from 0x80).
NORMAL = bytes(b if chr(b).isdigit() or chr(b).isalpha() or b > 127 else 32 for b in bytes(range(128)).lower() + bytes(range(128, 256)))
WORD = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []


class Scanner:
    """The automaton over a block of benchmark items.  Word number n is written as the character n; 0 is any other word."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW):
        self.numbers: dict[bytes, str] = {}
        #: by pattern: the number of words, and the items
        self.sizes: list[int] = []
        self.owners: list[tuple[str, ...]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for item, text in items:
            own = () if item is None else (str(item),)
            numbered = [self.numbers.setdefault(w, chr(len(self.numbers) + 1)) for w in normal_words(text)]
            for words in windows(numbered, size):
                key = "".join(words)
                at = self.automaton.get(key, None)
                if at is None:
                    self.automaton.add_word(key, len(self.sizes))
                    self.sizes.append(len(words))
                    self.owners.append(own)
                elif own and own[0] not in self.owners[at]:
                    self.owners[at] += own
        if self.sizes:
            self.automaton.make_automaton()
            #: stretches of the benchmark's words that are long enough for its shortest window
            self.stretch = re.compile(f"[^\0]{{{min(self.sizes)},}}")

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items with occurring windows."""
        items: set[str] = set()
        change = np.zeros(len(words) + 1, np.int64)
        if self.sizes and words:
            sizes, owners = self.sizes, self.owners
            for stretch in self.stretch.finditer("".join(map(self.numbers.get, words, repeat("\0")))):
                for last, pattern in self.automaton.iter(stretch[0]):
                    end = stretch.start() + last + 1
                    change[end - sizes[pattern]] += 1
                    change[end] -= 1
                    items.update(owners[pattern])
        return np.cumsum(change[:-1]) > 0, items


def hit_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as code point offsets (end exclusive) in the original text."""
    data = text.encode()
    at = [m.span() for m in WORD.finditer(data.lower())]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    spans = [(at[a][0], at[b - 1][1]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    return [(len(data[:a].decode()), len(data[:b].decode())) for a, b in spans]


def scanner_of(data: bytes, size: int) -> Scanner:
    return resident(f"scanner{size}", data, lambda d: Scanner(pickle.loads(d), size))


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int, limit: int) -> Iterator[bytes]:
    """The benchmark in blocks whose automata have about ``limit`` nodes at most; at least one block.

    A longer item is cut into parts that overlap such that every window is in one of them.
    """
    block, nodes, step = [], 0, max(1, limit // size - size)
    for item, text in benchmark.select(item_col, text_col).toLocalIterator():
        words = normal_words(text)
        for at in range(0, max(1, len(words) - size + 1), step):
            part = words[at : at + step + size - 1]
            if block and nodes + size * len(part) > limit:
                yield pickle.dumps(block)
                block, nodes = [], 0
            block.append((item, b" ".join(part).decode()))
            nodes += size * len(part)
    yield pickle.dumps(block)


def find_contamination(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    spans: bool = False,
    keep: tuple[str, ...] = (),
    nodes: int = NODES,
) -> DataFrame:
    """Benchmark windows in whole texts.

    One row per input row: the id column, ``n_words``, ``n_hit`` (words inside any occurrence of a
    window), ``n_items``, ``items_sha256`` (their ids sorted as strings, comma-joined), ``contaminated``
    (``n_hit > 0``) and, if ``spans``, ``hit_spans`` (code point offsets in the original text).  ``keep``
    names further columns to carry along.  Narrow: documents are never shuffled.

    The benchmark is read in blocks of ``nodes`` automaton nodes, each sent to the executors by itself; with more than
    one block, what was found so far is a table between two of them.

    Null texts have no words.  Items without words have no windows; an item without id marks words but is
    not listed; an id that occurs repeatedly is one item.  With an empty benchmark nothing is hit.
    """
    spark = df.sparkSession

    def scanned(rows: DataFrame, block: bytes) -> DataFrame:
        items = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = scanner_of(items.value, window)
            for batch in batches:
                hits, owners = [], []
                for value, before, known in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                    hit, found = scanner.scan(normal_words(value.as_py()))
                    if before.is_valid:
                        hit |= np.unpackbits(np.frombuffer(before.as_py(), np.uint8), count=len(hit)).astype(bool)
                        found.update(known.as_py())
                    # without hits so far there is nothing to carry
                    hits.append(np.packbits(hit).tobytes() if hit.any() else None)
                    owners.append(sorted(found))
                columns = [pa.array(hits, pa.binary()), pa.array(owners, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns, *batch.columns[4:]], batch.schema.names)

        return map_arrow(rows, scan, ", ".join(f"{c} {t}" for c, t in rows.dtypes))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from report(batches, None)

    def report(batches: Iterator[pa.RecordBatch], scanner: Scanner | None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_words": [], "n_hit": [], "n_items": [], "items_sha256": [], "contaminated": [], "hit_spans": []}
            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                words = normal_words(text)
                if scanner is not None:
                    hit, owners = scanner.scan(words)
                else:
                    bits = batch.column(2)[i].as_py()
                    hit = np.unpackbits(np.frombuffer(bits or bytes(-(-len(words) // 8)), np.uint8), count=len(words)).astype(bool)
                    owners = batch.column(3)[i].as_py() or []
                n = int(hit.sum())
                out["n_words"].append(len(words))
                out["n_hit"].append(n)
                out["n_items"].append(len(owners))
                out["items_sha256"].append(hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest())
                out["contaminated"].append(n > 0)
                if spans:
                    out["hit_spans"].append([{"start": a, "end": b} for a, b in hit_spans(text, hit)] if n else [])
            columns = {"id": batch.column(0)}
            columns |= {f"k{i}": batch.column(batch.schema.get_field_index(f"k{i}")) for i in range(len(keep))}
            columns |= {k: pa.array(out[k], t) for k, t in (("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()))}
            if spans:
                columns["hit_spans"] = pa.array(out["hit_spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_pydict(columns)

    def kind(c: str) -> str:
        return df.schema[c].dataType.simpleString()

    schema = ", ".join([f"id {kind(id_col)}", *(f"k{i} {kind(c)}" for i, c in enumerate(keep)), "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"]) + ", hit_spans array<struct<start:long,end:long>>" * spans
    kept = [df[c].alias(f"k{i}") for i, c in enumerate(keep)]
    blocks = item_blocks(benchmark, item_col, item_text_col, window, nodes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        items = spark.sparkContext.broadcast(first)
        rows = df.select(df[id_col].alias("id"), df[text_col].alias("t"), *kept)
        out = map_arrow(rows, lambda batches: report(batches, scanner_of(items.value, window)), schema)
    else:
        nothing = (F.lit(None).cast("binary").alias("h"), F.lit(None).cast("array<string>").alias("o"))
        rows = df.select(df[id_col].alias("id"), df[text_col].alias("t"), *nothing, *kept)
        for block in chain((first, second), blocks):
            rows = materialize(scanned(rows, block), "hits")
        out = map_arrow(rows, told, schema)
    return out.withColumnsRenamed({"id": id_col} | {f"k{i}": c for i, c in enumerate(keep)})
