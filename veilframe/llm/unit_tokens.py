"""Token ids of whole texts, unit by unit, by the public libraries; what a unit becomes is remembered."""

from __future__ import annotations

import json

import tiktoken
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

from .bpe import pack
from .common import Memo, resident
from .count_transducer import byte_letters
from .units import segments, split_units

#: Units that a worker remembers (and as many of those before).
UNITS = 400_000
#: Below this, what counts as a letter or digit has been settled for long, so that both libraries split alike.
SETTLED = "ɐ"


def byte_tokens(spec: dict) -> dict[int, bytes]:
    """The bytes of every token of a byte-level file, added ones left out."""
    plain = {c: b for b, c in byte_letters().items()}
    added = {t["id"] for t in spec.get("added_tokens") or ()}
    return {i: bytes(map(plain.__getitem__, token)) for token, i in spec["model"]["vocab"].items() if i not in added}


class ByteLevel:
    """Ids by a byte-level BPE file.  Merges in the order of the ids are ranks, so ``tiktoken`` encodes what is plain; all
    else is encoded by ``tokenizers`` itself.  ``special``: strings of added tokens inside a text are those tokens."""

    def __init__(self, data: bytes, special: bool = True):
        spec = json.loads(data)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer without normalizer is needed")
        if any(t.get(k) for t in spec.get("added_tokens") or () for k in ("lstrip", "rstrip", "single_word")) or any(c.isspace() for t in spec.get("added_tokens") or () for c in t["content"]):
            raise ValueError("added tokens that take in white space are not supported")
        self.tokens = byte_tokens(spec)
        self.size = max(self.tokens, default=0) + 1
        self.library = Tokenizer.from_str(data.decode())
        self.library.encode_special_tokens = not special
        self.added = [t["content"] for t in spec.get("added_tokens") or ()] if special else []
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"].get(a + b) for a, b in merges]
        ranked = len(self.tokens) == 256 + len(merges) and all(x is not None for x in order) and order == sorted(order)
        self.fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks={t: i for i, t in self.tokens.items()}, special_tokens={}) if ranked else None

    def encode(self, text: str) -> list[int]:
        if self.fast is None or not (text.isascii() or max(text) < SETTLED) or self.holds_added(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def holds_added(self, text: str) -> bool:
        for added in self.added:
            if added in text:
                return True
        return False


class UnitIds:
    """Packed ids of texts; units after the first are encoded with the space before them."""

    def __init__(self, data: bytes):
        self.model = ByteLevel(data)
        self.later = Memo(lambda unit: self.packed(" " + unit), UNITS)

    def packed(self, text: str) -> bytes:
        return pack(self.model.encode(text))

    def text_ids(self, text: str) -> bytes:
        """The ids of a whole text, little-endian unsigned 32-bit integers."""
        out = []
        for k, segment in enumerate(segments(text)):
            units = split_units(segment)
            if k == 0:
                out.append(self.packed(units[0]))
                del units[0]
            out.append(b"".join(map(self.later.__getitem__, units)))
        return b"".join(out)


def unit_ids_of(data: bytes) -> UnitIds:
    return resident("unit ids", data, UnitIds)
