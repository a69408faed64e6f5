"""Server-sent events with placeholders, restored while they arrive.

``EventRestorer`` is the state machine of one stream; what it holds is a line, an event's lines and a text for each block and
kind.  ``restore_stream`` keeps these in Structured Streaming's state, ``restore_batch`` runs over finished streams.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.json_tree import JsonText, Node, dump, read
from ..functions.restorer import Restorer, json_inner
from ..operators.restore import mappings_by_scope
from ..options import Options
from ..session import send_package

#: Block numbers; and kinds of text in a delta, with the field that holds it.
INTEGER = re.compile("-?(?:0|[1-9][0-9]{0,17})")
FIELDS = {"text_delta": "text", "input_json_delta": "partial_json"}


def split_open_bracket(text: str) -> tuple[str, str]:
    """What can be shown now, and what is kept from the last bracket that is still open."""
    at = text.rfind("[")
    return (text[:at], text[at:]) if at >= 0 and "]" not in text[at:] else (text, "")


class EventRestorer:
    """Re-assembles lines and events over chunk boundaries and holds back unfinished placeholders, for each block and kind."""

    def __init__(self, entries: list[tuple[str, str]], carry: str = "", lines: tuple[str, ...] = (), pending: dict[str, str] | None = None):
        self.entries, self._restorers = entries, {}
        self.carry, self.lines, self.pending = carry, list(lines), dict(pending or {})

    def _restored(self, kind: str, text: str) -> str:
        """A stream rarely has both kinds, so each one's restorer is made when it is needed."""
        if kind not in self._restorers:
            self._restorers[kind] = Restorer(self.entries, json_inner if kind == "input_json_delta" else None)
        return self._restorers[kind](text)

    def push(self, chunk: str | None) -> str:
        *lines, self.carry = (self.carry + (chunk or "")).split("\n")
        return "".join(map(self._line, lines))

    def complete(self) -> str:
        """The last line and event.  Text held back by a block that never stopped is not shown."""
        out = self._line(self.carry) if self.carry else ""
        out += self._event()
        self.carry, self.lines = "", []
        return out

    def _line(self, line: str) -> str:
        if line.rstrip("\r"):
            self.lines.append(line)
            return ""
        out = self._event()
        self.lines = []
        return f"{out}{line}\n"

    def _event(self) -> str:
        at = next((i for i, line in enumerate(self.lines) if line.startswith("data:")), None)
        before, lines = "", list(self.lines)
        tree = read(lines[at][5:]) if at is not None else None
        if tree is not None and tree.root.kind == "{":
            index = self._index(tree)
            kind = self._text(tree, tree.root, "type")
            if kind == "content_block_start":
                for name in FIELDS:
                    self.pending.pop(f"{name}:{index}", None)
            elif kind == "content_block_delta":
                lines[at] = "data:" + self._delta(tree, index)
            elif kind == "content_block_stop":
                before = "".join(self._flush(name, index) for name in FIELDS)
        return before + "".join(f"{line}\n" for line in lines)

    @staticmethod
    def _text(tree: JsonText, node: Node, name: str) -> str | None:
        found = tree.members(node, name)
        return tree.string(found[-1]) if found and found[-1].kind == '"' else None

    @staticmethod
    def _index(tree: JsonText) -> str:
        """A block's number as it is written; 0 where there is none."""
        found = tree.members(tree.root, "index")
        written = tree.text[found[-1].start : found[-1].end] if found else ""
        return written if INTEGER.fullmatch(written) else "0"

    def _delta(self, tree: JsonText, index: str) -> str:
        for delta in tree.members(tree.root, "delta")[-1:]:
            name = self._text(tree, delta, "type")
            if name in FIELDS:
                places = [n for n in tree.members(delta, FIELDS[name])[-1:] if n.kind == '"']
                shown, kept = split_open_bracket(self.pending.get(f"{name}:{index}", "") + "".join(map(tree.string, places)))
                self.pending[f"{name}:{index}"] = kept
                return tree.spliced([(n, self._restored(name, shown)) for n in places])
        return tree.text

    def _flush(self, name: str, index: str) -> str:
        kept = self.pending.pop(f"{name}:{index}", "")
        if not kept:
            return ""
        event = {"type": "content_block_delta", "index": int(index), "delta": {"type": name, FIELDS[name]: self._restored(name, kept)}}
        return f"event: content_block_delta\ndata: {dump(event)}\n\n"


def restore_batch(chunks: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(stream_id, text)``: finished streams ``(stream_id, seq, chunk)`` with originals (``mapping.scope_id`` is the stream).

    A finished stream is one text, as lines do not depend on where chunks end; it meets its mapping in one row, and rows come to
    Python in Arrow batches, not stream by stream.
    """

    @F.pandas_udf("string")
    def restored(streams: pd.Series, known: pd.Series) -> pd.Series:
        def one(stream: str, entries: Iterable[dict] | None) -> str:
            machine = EventRestorer([(e["placeholder"], e["original"]) for e in (() if entries is None else entries)])
            return machine.push(stream) + machine.complete()

        return pd.Series([one(s, e) for s, e in zip(streams, known, strict=True)], dtype="object")

    send_package(chunks.sparkSession)
    # chunks without a number come last
    place = F.struct(F.col("seq").isNull().alias("none"), F.col("seq"), F.coalesce("chunk", F.lit("")).alias("chunk"))
    streams = chunks.groupBy("stream_id").agg(F.sort_array(F.collect_list(place)).alias("c"))
    whole = streams.select("stream_id", F.array_join(F.transform("c", lambda c: c["chunk"]), "").alias("stream"))
    known = mappings_by_scope(mapping).withColumnRenamed("scope_id", "_stream")
    joined = whole.join(known, whole["stream_id"].eqNullSafe(known["_stream"]), "left")
    return joined.select("stream_id", restored("stream", "entries").alias("text"))


#: Milliseconds without a chunk after which a stream is ended, and for which an ended stream's late chunks are dropped.
TIMEOUT = 60_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StreamProcessor(StatefulProcessor):
    """One stream's state: the next chunk's number and what is unfinished, early chunks, texts held back, the mapping, and
    for a while that it has ended."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.line = handle.getValueState("line", "next bigint, carry string, lines array<string>")
        self.early = handle.getMapState("early", "seq bigint", "chunk string, last boolean")
        self.held = handle.getMapState("held", "block string", "text string")
        self.known = handle.getValueState("known", "entries array<struct<placeholder:string,original:string>>")
        self.ended = handle.getValueState("ended", "seq bigint", self.timeout)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        rows = list(rows)
        if self.ended.exists():
            return
        for row in rows:
            if row["entries"]:
                self.known.update((row["entries"],))
            self.early.updateValue((row["seq"],), (row["chunk"], row["last"]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout)
        yield from self.go_on(key, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        yield from self.go_on(key, True)

    def go_on(self, key: tuple, end: bool) -> Iterator[Row]:
        """Chunks in their order, as far as there are no gaps; at the end over gaps too."""
        after, carry, lines = self.line.get() if self.line.exists() else (0, "", [])
        entries = self.known.get()[0] if self.known.exists() else []
        held = {k[0]: v[0] for k, v in self.held.iterator()} if self.held.exists() else {}
        machine = EventRestorer([(e["placeholder"], e["original"]) for e in entries], carry, lines, held)
        over = False
        # what is early is only listed where the end is; else it is looked up number by number
        gaps = iter(sorted(k[0] for k in self.early.keys())) if end and self.early.exists() else None
        while not over:
            seq = next(gaps, None) if gaps else after
            if seq is None or not self.early.containsKey((seq,)):
                break
            chunk, last = self.early.getValue((seq,))
            self.early.removeKey((seq,))
            after, over = seq + 1, bool(last)
            yield Row(stream_id=key[0], seq=seq, text=machine.push(chunk) + (machine.complete() if over else ""))
        if end and not over:
            rest = machine.complete()
            if rest:
                yield Row(stream_id=key[0], seq=after, text=rest)
        if end or over:
            self.forget(after)
            return
        self.line.update((after, machine.carry, machine.lines))
        for block in held.keys() - machine.pending.keys():
            self.held.removeKey((block,))
        for block, text in machine.pending.items():
            if held.get(block) != text:
                self.held.updateValue((block,), (text,))

    def forget(self, after: int) -> None:
        for state in (self.line, self.early, self.held, self.known):
            state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.ended.update((after,))

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State with maps, timers and times to live needs Spark's store on RocksDB; it is the session's setting."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def restore_stream(chunks: DataFrame, mapping: DataFrame, timeout: int = TIMEOUT) -> DataFrame:
    """A streaming ``(stream_id, seq, chunk, last)`` to ``(stream_id, seq, text)``.

    Chunks are numbered from 0; those that come early wait in the state for the ones before them, repeated numbers count once.
    A row with ``last`` ends its stream, and so does a time of ``timeout`` milliseconds without a chunk: then what waits is
    shown, over gaps too, and the state goes.  Chunks that come after the end are dropped for as long again.
    ``mapping`` is static; it travels with a stream's first chunk only.
    """
    send_package(chunks.sparkSession)
    use_rocksdb(chunks.sparkSession)
    kind = chunks.schema["stream_id"].dataType.simpleString()
    known = mappings_by_scope(mapping).withColumnRenamed("scope_id", "_first")
    first = chunks.select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk", "last", F.when(F.col("seq") == 0, F.col("stream_id")).alias("_first"))
    joined = first.join(known, "_first", "left").drop("_first")
    return joined.groupBy("stream_id").transformWithState(StreamProcessor(timeout), f"stream_id {kind}, seq long, text string", "append", "ProcessingTime")


def upsert_mapping(batch: DataFrame, path: str) -> None:
    """For ``foreachBatch``: merge a micro-batch's mapping into a table, by way of a new version beside it.

    One writer per table; versions are numbered, readers take the last complete one (``latest_mapping``).
    """
    from ..operators.numbering import merge_mappings

    version, old = latest_mapping(batch.sparkSession, path)
    merged = batch if old is None else merge_mappings(old, batch)
    merged.write.parquet(f"{path}/version={version + 1}")


def latest_mapping(spark, path: str) -> tuple[int, DataFrame | None]:  # noqa: ANN001
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return 0, None
    done = [int(s.getPath().getName().removeprefix("version=")) for s in files.listStatus(root) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return (max(done), spark.read.parquet(f"{path}/version={max(done)}")) if done else (0, None)


def continue_scopes(batch: DataFrame, path: str, options: Options | None = None) -> DataFrame:
    """For ``foreachBatch``: replace the values of a micro-batch ``(scope_id, ord, text)`` and keep its numbers.

    Values of earlier batches keep their placeholders, new ones are numbered on from the largest.  The mapping is a store of
    ``mapping_files.replace_scopes``: only the parts of the batch's scopes are read and written, before the texts
    ``(scope_id, ord, anonymized_text)`` are returned.  A batch that is run again changes nothing.  See ``scopes.anonymize_stream`` for
    numbers in the stream's own state.
    """
    from ..operators.anonymize import anonymize_scopes
    from ..operators.numbering import merge_mappings
    from ..sources.mapping_files import load_scopes, replace_scopes

    spark = batch.sparkSession
    old = load_scopes(spark, path, batch)
    texts, mapping = anonymize_scopes(batch, options, seed=old)
    replace_scopes(spark, path, mapping if old is None else merge_mappings(old, mapping))
    return texts
