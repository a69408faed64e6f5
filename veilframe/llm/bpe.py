"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece exactly one vocabulary token can be the last token of the
prefix's encoding.  ``PrefixEncoder`` finds it from shorter prefixes: token ``t`` ends the prefix
if it spells the prefix's last bytes and the pair (last token of the prefix before ``t``, ``t``)
is *stable*, that is, encoding the two tokens' bytes together gives the same two tokens.  The
table of last tokens makes appends exact (extend the table) and lets an edit be re-encoded from
the edited byte on.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, broadcast_file, map_arrow, resident

#: Pieces that a worker's memo keeps (and as many again of those before), and pairs of tokens.
PIECE_CACHE = 200_000
PAIR_CACHE = 1_000_000
#: Pieces of one text that are held at once.
PIECES_AT_ONCE = 1 << 18
NEVER = 1 << 40


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks from the text of a ``.tiktoken`` file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge(ranks: dict[bytes, int], piece: bytes, below: int = NEVER) -> list[bytes]:
    """Plain BPE: repeatedly join the leftmost adjacent pair of lowest rank, ranks < ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], NEVER)
            if rank < best:
                best, at = rank, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class PrefixEncoder:
    """Encodes pieces (matches of the split pattern) with a fixed vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._right: dict[int, list[tuple[bytes, int]]] = {}
        self._left: dict[int, list[tuple[bytes, int]]] = {}
        # finds all tokens in a piece, by their ends and the longest first; bytes are written as Latin-1 characters
        self.finder = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.finder.add_word(token.decode("latin-1"), (len(token), rank))
        self.finder.make_automaton()
        #: by the right token: left token to whether the pair is stable
        self._stable: dict[int, dict[int, bool]] = {rank: {} for rank in self.tokens}
        self._pairs = 0
        self.ids_of = Memo(lambda piece: pack(self.encode_piece(piece.encode())), PIECE_CACHE)

    def _spine(self, token: int, side: int, memo: dict) -> list[tuple[bytes, int]]:
        """The parts of ``token`` that touch its right (side 1) or left (side 0) end while it is
        built, each with the rank of the merge that consumes it."""
        found = memo.get(token)
        if found is None:
            text, until, found = self.tokens[token], NEVER, []
            while True:
                found.append((text, until))
                if len(text) < 2:
                    break
                until = self.ranks[text]
                text = merge(self.ranks, text, until)[-side]
            memo[token] = found
        return found

    def stable(self, left: int, right: int) -> bool:
        """True if no merge ever joins bytes of ``left`` to bytes of ``right``."""
        answer = self._stable[right].get(left)
        if answer is None:
            answer = self._judge(left, right)
            if self._pairs >= PAIR_CACHE:
                for lefts in self._stable.values():
                    lefts.clear()
                self._pairs = 0
            self._pairs += 1
            self._stable[right][left] = answer
        return answer

    def _judge(self, left: int, right: int) -> bool:
        ranks = self.ranks
        for x, x_until in self._spine(left, 1, self._right):
            x_from = ranks[x]
            for y, y_until in self._spine(right, 0, self._left):
                # x and y are neighbours at some time, and their merge comes before either is consumed;
                # of equal ranks the leftmost merge goes first
                joined = ranks.get(x + y)
                if joined is not None and joined < x_until and joined <= y_until and ranks[y] < x_until and x_from < y_until:
                    return False
        return True

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Append to ``last`` (last tokens of the prefixes known so far) up to the end of ``data``."""
        ranks, stable, longest = self.ranks, self.stable, self.longest
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(data[start:end])
                if token is not None and (start == 0 or stable(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError(f"the vocabulary lacks byte {data[end - 1]}")
        return last

    def walk_back(self, last: list[int]) -> list[int]:
        """The token ids that a table of last tokens stands for."""
        ids, end, sizes = [], len(last), self.sizes
        while end:
            token = last[end - 1]
            ids.append(token)
            end -= sizes[token]
        ids.reverse()
        return ids

    def lasts(self, data: bytes) -> list[int]:
        """The last token of every prefix of a piece."""
        last, known, judged, stable = [], 0, self._stable, self.stable
        for at, (size, token) in self.finder.iter(data.decode("latin-1")):
            if at < known:
                continue
            start = at - size
            if start >= 0:
                before = last[start]
                good = judged[token].get(before)
                if good is None:
                    good = stable(before, token)
                if not good:
                    continue
            last.append(token)
            known += 1
        if known < len(data):
            raise ValueError(f"the vocabulary lacks a byte of {data[:20]!r}")
        return last

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return self.walk_back(self.lasts(piece)) if whole is None else [whole]


class EditableEncoding:
    """One piece with its table of last tokens; appends and edits redo only what they change."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data = encoder, data
        self.last = encoder.extend(data, [])

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes ``start`` to ``end``; prefixes up to ``start`` are kept, and once
        ``longest`` consecutive prefixes after the edit have their old last tokens, so are the rest."""
        tail = self.data[end:]
        old = self.last[end:]
        self.data = self.data[:start] + new + tail
        del self.last[start:]
        self.encoder.extend(self.data[: start + len(new)], self.last)
        same, longest = 0, self.encoder.longest
        for i in range(len(tail)):
            self.encoder.extend(self.data[: len(self.last) + 1], self.last)
            same = same + 1 if self.last[-1] == old[i] else 0
            if same > longest:
                self.last += old[i + 1 :]
                break

    def ids(self) -> list[int]:
        return self.encoder.walk_back(self.last)


def pack(ids: list[int]) -> bytes:
    out = array("I", ids)
    if out.itemsize != 4:
        out = array("L", ids)
    return out.tobytes()


def encoder_of(data: bytes) -> PrefixEncoder:
    """The worker's encoder for a rank file's bytes."""
    return resident("encoder", data, lambda d: PrefixEncoder(read_ranks(d)))


def packed_blocks(encoder: PrefixEncoder, pattern: regex.Pattern, text: str) -> Iterator[bytes]:
    """Packed ids of a whole text, a bounded number of pieces at a time."""
    get = encoder.ids_of.__getitem__
    if len(text) < PIECES_AT_ONCE:
        yield b"".join(map(get, pattern.findall(text)))
        return
    pieces = (m.group() for m in pattern.finditer(text))
    while block := list(islice(pieces, PIECES_AT_ONCE)):
        yield b"".join(map(get, block))


def unpack(data: bytes) -> array:
    out = array("I")
    if out.itemsize != 4:
        out = array("L")
    out.frombytes(data)
    return out


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every whole text, then decode the ids again.

    One row per input row: the id column, ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned
    32-bit integers), ``decoded_sha256`` (the decoded bytes) and, if ``keep_ids``, ``ids`` (those
    integers' bytes).  Narrow: no shuffle.

    Null texts count as empty: no ids, digests of nothing.  Null or repeated ids pass through; further
    columns are ignored, so their names cannot clash.  An empty table gives an empty table.
    """
    ranks = broadcast_file(df.sparkSession, ranks_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = encoder_of(ranks.value), regex.compile(pattern)
        token = [encoder.tokens[i] for i in range(len(encoder.tokens))] if sorted(encoder.tokens) == list(range(len(encoder.tokens))) else encoder.tokens
        for batch in batches:
            counts, ids_sha, bytes_sha, all_ids = [], [], [], []
            for text in batch.column(1):
                ids, back, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                for block in packed_blocks(encoder, split, text.as_py() or ""):
                    ids.update(block)
                    back.update(b"".join(map(token.__getitem__, unpack(block))))
                    n += len(block) // 4
                    if keep_ids:
                        kept.append(block)
                counts.append(n)
                ids_sha.append(ids.hexdigest())
                bytes_sha.append(back.hexdigest())
                all_ids.append(b"".join(kept))
            columns = {"id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(bytes_sha, pa.string())}
            if keep_ids:
                columns["ids"] = pa.array(all_ids, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return map_arrow(df.select(df[id_col].alias("id"), df[text_col].alias("t")), encode, schema).withColumnRenamed("id", id_col)


def decode_ids(encoder: PrefixEncoder, ids: bytes) -> bytes:
    return b"".join(encoder.tokens[i] for i in unpack(ids))
