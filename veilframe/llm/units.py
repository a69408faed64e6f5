"""Texts cut where no token of either kind of tokenizer can reach across, and tokens remembered by what is cut.

A space between two characters that are not white space begins a new piece in byte-level splits (a run of letters, digits or
others ends before it, and what follows does not look back), and begins a new piece for vocabularies in which a space
mark only stands at a token's front.  So a text's tokens are those of its units, one after another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space but the space.
OTHER_SPACE = [chr(c) for c in (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Characters of a text that are cut into units at once.
SEGMENT = 1 << 20


def split_units(text: str) -> list[str]:
    """Units such that ``" ".join(units)`` is the text; where spaces stand alone this is a plain split."""
    if "  " in text or text[:1] == " " or text[-1:] == " " or any(c + " " in text or " " + c in text for c in OTHER_SPACE if c in text):
        return CUT.split(text)
    return text.split(" ")


def segments(text: str, limit: int = SEGMENT) -> Iterator[str]:
    """Consecutive parts of about ``limit`` characters, cut between units (so with one space less at each cut)."""
    at = 0
    while len(text) - at > limit:
        cut = CUT.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text
