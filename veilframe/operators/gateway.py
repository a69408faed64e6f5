"""JSON requests and responses of chat interfaces: texts out, placeholders in, originals back.

JSON of any depth has no built-in walk that keeps spelling, so these are Python functions over slices of Arrow batches; what happens to the
texts is done by the DataFrame operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.json_tree import JsonText, Node, clean, read
from ..functions.restorer import Restorer
from ..options import Options
from ..session import send_package
from .anonymize import anonymize_scopes
from .restore import mappings_by_scope


#: The path of a body that is no JSON and therefore one text.
WHOLE = "*"


def _block_slots(tree: JsonText, blocks: Node, path: str) -> list[tuple[str, Node]]:
    """Text blocks, and what is in tool results, at any depth; of repeated members each counts."""
    out, todo = [], [(path, blocks)]
    while todo:
        path, node = todo.pop()
        if node.kind == '"':
            out.append((path, node))
        elif node.kind == "[":
            inner = []
            for i, block in enumerate(node.items):
                kinds = {tree.string(t) for t in tree.members(block, "type") if t.kind == '"'}
                if "text" in kinds:
                    inner += [(f"{path}/{i}/text", t) for t in tree.members(block, "text") if t.kind == '"']
                if "tool_result" in kinds:
                    inner += [(f"{path}/{i}/content", c) for c in tree.members(block, "content")]
            todo += reversed(inner)
    return out


def _slots(tree: JsonText) -> list[tuple[str, Node]]:
    parts = [("system", node) for node in tree.members(tree.root, "system")]
    for messages in tree.members(tree.root, "messages"):
        for i, message in enumerate(messages.items if messages.kind == "[" else ()):
            parts += [(f"messages/{i}/content", node) for node in tree.members(message, "content")]
    return [slot for path, node in parts for slot in _block_slots(tree, node, path)]


def request_slots(body: str | None) -> list[tuple[str, str]]:
    """The texts of a request with their paths: the system prompt, messages and the text blocks in them.

    JSON of any depth and with numbers of any size is read.  A body that is no JSON is one text, so that nothing passes
    unseen; JSON that is no object has no texts.
    """
    tree = read(body)
    if tree is None:
        return [(WHOLE, body)] if body else []
    return [(path, clean(tree.string(node))) for path, node in _slots(tree)]


def fill_slots(body: str, texts: list[str]) -> str:
    """The request with its texts replaced, in the order of ``request_slots``; all else stays byte for byte."""
    tree = read(body)
    if tree is None:
        return texts[0]
    return tree.spliced([(node, text) for (_, node), text in zip(_slots(tree), texts, strict=True)])


def restore_values(body: str, restorer: Restorer) -> str:
    """A response with every string value restored, at any depth; keys, numbers and spelling stay.  What is no JSON is
    restored as text."""
    tree = read(body)
    if tree is None:
        return restorer(body)
    return tree.spliced([(node, restorer(tree.string(node))) for node in tree.strings()])


#: Bytes of a batch that are Python objects at once, so that a worker's memory is that of one Arrow batch and not many times it.
SLICE = 1 << 20


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``SLICE`` bytes at a time, one at least."""
    for batch in batches:
        n = max(1, batch.num_rows * SLICE // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def extract_slots(requests: DataFrame) -> DataFrame:
    """``(request_id, slot_ord, json_path, text)`` of ``requests(request_id, body)``."""

    send_package(requests.sparkSession)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _sliced(batches):
            found = [(i, k, p, t) for i, b in enumerate(rows.column(1).to_pylist()) for k, (p, t) in enumerate(request_slots(b))]
            at, places, paths, texts = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at, pa.int64())), pa.array(places, pa.int32()), pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["request_id", "slot_ord", "json_path", "text"])

    rows = requests.select("request_id", "body")
    key = StructType([StructField("request_id", rows.schema["request_id"].dataType)])
    return rows.mapInArrow(slots, key.add("slot_ord", "integer").add("json_path", "string").add("text", "string"))


def _bodies(rows: DataFrame, use: Callable[[str | None, list], str | None]) -> DataFrame:
    """``(request_id, body)`` of rows ``(request_id, body, with)``: ``use`` is called with each body and its list, unless that is null or empty."""

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches):
            new = [use(b, x) if x else b for b, x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.string())], ["request_id", "body"])

    return rows.mapInArrow(changed, StructType([StructField("request_id", rows.schema["request_id"].dataType)]).add("body", "string"))


def prompts(slots: DataFrame) -> DataFrame:
    """One text per request for a model to look at: its slots, separated by blank lines."""
    joined = slots.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("slot_ord", "text"))).alias("s"))
    return joined.select("request_id", F.array_join(F.transform("s", lambda s: s["text"]), "\n\n").alias("prompt"))


def anonymize_requests(requests: DataFrame, options: Options | None = None, findings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(request_id, body)`` with placeholders, and the mapping with one scope per request.

    Everything but the texts stays byte for byte: numbers, order and repetition of keys, spelling.  What is no JSON is masked as one
    text and never passed on unread.
    """

    slots = extract_slots(requests).select(F.col("request_id").alias("scope_id"), F.col("slot_ord").alias("ord"), "text")
    texts, mapping = anonymize_scopes(slots, options, findings)
    per_request = texts.groupBy(F.col("scope_id").alias("request_id")).agg(F.sort_array(F.collect_list(F.struct("ord", "anonymized_text"))).alias("t"))
    joined = requests.join(per_request, "request_id", "left")
    return _bodies(joined.select("request_id", "body", F.transform("t", lambda t: t["anonymized_text"]).alias("with")), fill_slots), mapping


def restore_responses(responses: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(request_id, body)`` with originals; a response whose request has no mapping stays unchanged."""

    send_package(responses.sparkSession)

    def restore(body: str | None, entries: list[dict]) -> str | None:
        return body if body is None else restore_values(body, Restorer((x["placeholder"], x["original"]) for x in entries))

    joined = responses.join(mappings_by_scope(mapping).withColumnRenamed("scope_id", "request_id"), "request_id", "left")
    return _bodies(joined.select("request_id", "body", "entries"), restore)
