"""JSON texts whose strings are replaced where they stand, so that all else stays byte for byte.

The tokens of a text are found by one pattern and nested by a stack: no depth, length or number is too large, and no
number is ever read.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

SURROGATE = re.compile("[\ud800-\udfff]")
TOKEN = re.compile(
    r"""[ \t\n\r]*+(?:(?P<string>"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+")|(?P<open>[{\[])|(?P<close>[}\]])|(?P<comma>,)|(?P<colon>:)"""
    r"""|(?P<scalar>(?:-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null)(?=[ \t\n\r,:}\]]|\Z))|(?P<end>\Z))"""
)


@dataclass(slots=True)
class Node:
    """A value: ``kind`` is one of ``{ [ " 0`` (the last for numbers, true, false, null), with its place in the text.

    ``items`` are the members of an object (with their keys' nodes, repeated ones too) or the elements of an array.
    """

    kind: str
    start: int
    end: int
    items: list | tuple = ()


class JsonText:
    """A text and the nodes of the JSON value in it; raises ``ValueError`` for what is no JSON."""

    def __init__(self, text: str):
        self.text = text
        self.root = self._read()

    def _read(self) -> Node:
        text, at, want, match = self.text, 0, "value", TOKEN.match
        top = Node("[", 0, 0, [])
        holders, key = [top], None
        while True:
            m = match(text, at)
            if m is None:
                raise ValueError(f"no JSON at {at}")
            kind = m.lastgroup
            start, at = m.span(kind)
            if kind == "end" and want == "end":
                return top.items[0]
            if kind == "string" and want in ("key", "key or close"):
                key, want = Node('"', start, at), "colon"
            elif kind in ("string", "scalar", "open") and want in ("value", "value or close"):
                node = Node(text[start], start, at, []) if kind == "open" else Node('"' if kind == "string" else "0", start, at)
                holder = holders[-1]
                holder.items.append((key, node) if holder.kind == "{" else node)
                if kind == "open":
                    holders.append(node)
                    want = "key or close" if node.kind == "{" else "value or close"
                else:
                    want = "comma or close" if len(holders) > 1 else "end"
            elif kind == "close" and want.endswith("close") and holders[-1].kind + text[start] in ("{}", "[]"):
                holders.pop().end = at
                want = "comma or close" if len(holders) > 1 else "end"
            elif kind == "comma" and want == "comma or close":
                want = "key" if holders[-1].kind == "{" else "value"
            elif kind == "colon" and want == "colon":
                want = "value"
            else:
                raise ValueError(f"no JSON at {start}")

    def string(self, node: Node) -> str:
        # what has no escape stands as it is: tokens hold no control characters
        inner = self.text[node.start + 1 : node.end - 1]
        return json.loads(f'"{inner}"') if "\\" in inner else inner

    def members(self, node: Node, name: str) -> list[Node]:
        """The values of all members of that name, in order; the last is the one that readers take."""
        return [value for key, value in node.items if self.string(key) == name] if node.kind == "{" else []

    def strings(self) -> list[Node]:
        """All string values (no keys), in the order of the text."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if node.kind == '"':
                out.append(node)
            else:
                todo += [item[1] if node.kind == "{" else item for item in reversed(node.items)]
        return out

    def spliced(self, changes: list[tuple[Node, str]]) -> str:
        """The text with some string values replaced; a value that stays the same keeps its spelling."""
        out, at = [], 0
        for node, new in sorted(changes, key=lambda c: c[0].start):
            if new not in ((old := self.string(node)), clean(old)):
                out += (self.text[at : node.start], dump(new))
                at = node.end
        return "".join((*out, self.text[at:]))


def read(text: str | None) -> JsonText | None:
    """The nodes of a text, or None for what is no JSON (``NaN`` and ``Infinity`` are none)."""
    try:
        return JsonText(text or "")
    except ValueError:
        return None


def dump(value: object) -> str:
    """Compact JSON; halves of surrogate pairs, which no encoding can hold, stay escapes."""
    out = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", out)


def clean(text: str) -> str:
    """The text with halves of surrogate pairs replaced by the replacement character."""
    return SURROGATE.sub("�", text)
