"""Token counts by compiled finite-state transducers.

Two deterministic machines, composed:

* ``SPLIT``: the split pattern as a machine of twelve states over character classes, whose transitions
  mark piece starts.  Text is cut into equal chunks; each chunk's *state map* (end state for every
  start state) is computed independently, the maps are composed by a parallel prefix scan, and only
  then are the chunks' marks read off with their true start states.
* ``CountTransducer``: reads one piece's bytes; each transition carries the change in the number of emitted tokens.

A piece start resets the second machine, so counts add up over pieces and over chunks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import PIECE_CACHE, PrefixEncoder, merge
from .common import Memo, broadcast_file, map_arrow, resident

#: Compiled states of the counting machine.  A piece that would need one more is counted by the table of last tokens, from which the
#: states are compiled: the counts are equal, and compiling states that are met once costs more than they save.
STATE_LIMIT = 100_000

#: Characters scanned at once, and characters of a chunk.
BLOCK = 1 << 21
CHUNK = 256

# Character classes.
SEP, SPACE, WHITE, LETTER, STMD, R, V, L, E, NUMBER, APOSTROPHE, OTHER = range(12)
LETTERS = (LETTER, STMD, R, V, L, E)
# States: at a boundary; in a run of letters, numbers or others; one space or other white character; several, the
# last a space or another; an apostrophe that began the piece, alone or with the first letter of 're, 've or 'll.
AT, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(12)
#: A transition's mark: a piece starts at this character, at the one before.
HERE, BEFORE = 1, 2


def _split_machine() -> tuple[np.ndarray, np.ndarray]:
    to, mark = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    begin = {SEP: AT, SPACE: ONE_SPACE, WHITE: ONE_WHITE, NUMBER: IN_NUMBERS, APOSTROPHE: QUOTE, OTHER: IN_OTHERS} | dict.fromkeys(LETTERS, IN_LETTERS)
    run = {NUMBER: IN_NUMBERS, APOSTROPHE: IN_OTHERS, OTHER: IN_OTHERS} | dict.fromkeys(LETTERS, IN_LETTERS)
    for state in range(12):
        for c in range(12):
            go, put = begin[c], HERE
            if c == SEP:
                pass
            elif state in (IN_LETTERS, IN_NUMBERS, IN_OTHERS) and run.get(c) == state:
                go, put = state, 0
            elif state in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE) and c in (SPACE, WHITE):
                go, put = MORE_SPACE if c == SPACE else MORE_WHITE, 0
            elif state == ONE_SPACE:
                go, put = run[c], 0
            elif state == MORE_SPACE:
                go, put = run[c], BEFORE
            elif state == MORE_WHITE:
                put = HERE | BEFORE
            elif state == QUOTE and c in (APOSTROPHE, OTHER):
                go, put = IN_OTHERS, 0
            elif state == QUOTE and c == STMD:
                go, put = AT, 0
            elif state == QUOTE and c in (R, V, L):
                go, put = {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0
            elif (state, c) in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
                go, put = AT, 0
            elif state in (QUOTE_R, QUOTE_V, QUOTE_L):
                go, put = (IN_LETTERS, BEFORE) if c in LETTERS else (begin[c], HERE | BEFORE)
            to[state, c], mark[state, c] = go, put
    # the letter after the apostrophe starts a piece also where the text ends before 're, 've or 'll is complete
    for state in (QUOTE_R, QUOTE_V, QUOTE_L):
        mark[state, SEP] = HERE | BEFORE
    return to, mark


TO, MARK = _split_machine()
_CLASSES: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """The class of every code point."""
    if not _CLASSES:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
            table[[ord(c) for c in regex.findall(pattern, every)]] = kind
        for c, kind in ((" ", SPACE), ("'", APOSTROPHE), ("r", R), ("v", V), ("l", L), ("e", E), *((c, STMD) for c in "stmd")):
            table[ord(c)] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (chunks x states), in log2(chunks) parallel steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        later = out[step:].copy()
        out[step:] = np.take_along_axis(later, out[:-step].astype(np.intp), axis=1)
        step *= 2
    return out


def piece_starts(classes: np.ndarray, start: int = AT, chunk: int = CHUNK) -> np.ndarray:
    """True where a piece starts.  The text must end with a separator."""
    n = len(classes)
    lanes = -(-n // chunk)
    grid = np.full(lanes * chunk, SEP, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(lanes, chunk).T)
    to, mark = TO.ravel(), MARK.ravel()
    state = np.broadcast_to(np.arange(12, dtype=np.uint8)[:, None], (12, lanes)).copy()
    for row in grid:  # every chunk's map, all chunks at once
        state = to[state * np.uint8(12) + row]
    scanned = compose_scan(np.ascontiguousarray(state.T))
    now = np.empty(lanes, np.uint8)
    now[0], now[1:] = start, scanned[:-1, start]
    marks = np.empty((chunk, lanes), np.uint8)
    for i, row in enumerate(grid):
        at = now * np.uint8(12) + row
        marks[i], now = mark[at], to[at]
    marks = marks.T.ravel()[:n]
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BEFORE) > 0
    return starts


class CountTransducer:
    """The prefix dynamic programme as a deterministic machine whose states are compiled when first reached.

    What the future can depend on is the longest suffix read that still begins a token (the tail), and
    for each place in the tail where a token may yet begin the last token before that place.  A
    transition tells the change in the number of tokens of the prefix read.  Reading a whole piece is memoised as one
    transition.
    """

    def __init__(self, encoder: PrefixEncoder):
        self.encoder = encoder
        self.prefixes = {token[:i] for token in encoder.ranks for i in range(1, len(token) + 1)}
        start = (b"", ((-1, 0),))
        self.number, self.states = {start: 0}, [start]
        self.go: list[dict[int, tuple[int, int]]] = [{}]
        self.counts = Memo(lambda piece: self.count(piece.encode()), PIECE_CACHE)

    def compile(self, state: int, byte: int) -> tuple[int, int] | None:
        """The transition, or none where it would need one state too many."""
        tail, places = self.states[state]
        text, ranks, stable = tail + bytes((byte,)), self.encoder.ranks, self.encoder.stable
        for i, place in enumerate(places):  # the token that ends here begins after i bytes of the tail
            token = place and ranks.get(text[i:])
            if token is not None and place and (place[0] < 0 or stable(place[0], token)):
                break
        else:
            raise ValueError(f"the vocabulary lacks byte {byte}")
        change, prefixes = place[1] + 1, self.prefixes
        cut = next((k for k in range(len(text)) if text[k:] in prefixes), len(text))
        kept = [p and (p[0], p[1] - change) if text[k:] in prefixes else None for k, p in enumerate(places[cut:], cut)]
        new = (text[cut:], (*kept, (token, 0)))
        target = self.number.get(new)
        if target is None:
            if len(self.states) >= STATE_LIMIT:
                return None
            target = self.number[new] = len(self.states)
            self.states.append(new)
            self.go.append({})
        found = self.go[state][byte] = (target, change)
        return found

    def count(self, data: bytes) -> int:
        """The sum of the transitions' changes: the number of tokens.  A token's bytes are one, as its merges lead to it."""
        if data in self.encoder.ranks:
            return 1
        state, go, total = 0, self.go, 0
        for byte in data:
            step = go[state].get(byte) or self.compile(state, byte)
            if step is None:
                return len(self.encoder.encode_piece(data))
            state = step[0]
            total += step[1]
        return total


class TokenCounter:
    """Both machines and the added tokens of a ``tokenizers`` file with a byte-level BPE model."""

    def __init__(self, spec: bytes):
        spec = json.loads(spec)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer without normalizer is needed")
        if spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("the byte-level split without a prefix space is needed")
        if any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            raise ValueError("plain merges of bytes are needed")
        plain = {c: b for b, c in byte_letters().items()}
        pairs = [tuple(bytes(map(plain.__getitem__, side)) for side in (x.split(" ") if isinstance(x, str) else x)) for x in spec["model"]["merges"]]
        ranks = {bytes((b,)): b for b in range(256)}
        ranks.update((a + b, 256 + i) for i, (a, b) in enumerate(pairs))
        # ranks say which bytes are joined, merges which pairs: they agree if each token is made of its merge's pair
        for i, (a, b) in enumerate(pairs):
            if merge(ranks, a + b, 256 + i) != [a, b]:
                raise ValueError("merges that lead to every token are needed")
        self.machine = CountTransducer(PrefixEncoder(ranks))
        added = sorted((t["content"] for t in spec.get("added_tokens") or ()), key=len, reverse=True)
        if any(t.get(k) for t in spec.get("added_tokens") or () for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts; those texts together make one block of the scan."""
        out = [0] * len(texts)
        parts: list[str] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            for k, part in enumerate(self.added.split(text) if self.added else [text]):
                out[i] += k > 0
                # a long part is counted piece by piece of BLOCK characters, except for its end
                done, rest = self.long_part(part) if len(part) > BLOCK else (0, part)
                out[i] += done
                parts.append(rest)
                owner.append(i)
        joined = "\0".join(parts) + "\0"
        classes = classes_of(joined)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes[ends] = SEP
        starts = np.flatnonzero(piece_starts(classes))
        numbers = self.numbers(joined, starts, len(joined))
        numbers[classes[starts] == SEP] = 0
        first = np.searchsorted(starts, np.concatenate(([0], ends[:-1] + 1)))
        for i, n in zip(owner, np.add.reduceat(numbers, first).tolist(), strict=True):
            out[i] += n
        return out

    def numbers(self, text: str, starts: np.ndarray, end: int) -> np.ndarray:
        at = starts.tolist()
        pieces = (text[a:b] for a, b in zip(at, [*at[1:], end], strict=True))
        return np.fromiter(map(self.machine.counts.__getitem__, pieces), np.int64, len(at))

    def long_part(self, text: str) -> tuple[int, str]:
        """The number of tokens in all but the end of a text, and that end.

        A piece's start is a boundary, so a scan may begin there; the last two pieces before the end of a block may
        yet change with what follows and open the next block.
        """
        total, at, size = 0, 0, BLOCK
        while len(text) - at > size:
            block = text[at : at + size]
            starts = np.flatnonzero(piece_starts(np.append(classes_of(block), np.uint8(SEP))))[:-1]
            if len(starts) < 4:
                size *= 2  # a piece as long as a block
                continue
            total += int(self.numbers(block, starts[:-3], int(starts[-3])).sum())
            at, size = at + int(starts[-3]), BLOCK
        return total, text[at:]


def classes_of(text: str) -> np.ndarray:
    return char_classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def counter_of(data: bytes) -> TokenCounter:
    return resident("counter", data, TokenCounter)


def blocks(texts: list[str], limit: int = BLOCK) -> Iterator[list[str]]:
    """Consecutive texts of about ``limit`` characters; a longer text stands alone."""
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text) + 1
    if block:
        yield block


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of whole texts.

    One row per input row: the id column, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``
    (``n_tokens > limit``).  Narrow: no shuffle.  Strings of added tokens inside a text count as one
    token each, the library's default.

    Null texts count as empty.  Null or repeated ids pass through; further columns are ignored, so
    their names cannot clash.  An empty table gives an empty table.
    """
    spec = broadcast_file(df.sparkSession, tokenizer_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(spec.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            numbers = [n for block in blocks(texts) for n in counter.counts(block)]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column(0),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n_tokens": pa.array(numbers, pa.int64()),
                    "over_limit": pa.array([n > limit for n in numbers], pa.bool_()),
                }
            )

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(df[id_col].alias("id"), df[text_col].alias("t")), count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
