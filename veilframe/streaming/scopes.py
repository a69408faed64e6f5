"""Scopes that go on: numbers and newest results in Structured Streaming's state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..categories import LABELS
from ..functions.text import normalize
from ..operators.anonymize import accepted_spans
from ..options import Options
from ..session import send_package
from .sse import use_rocksdb


class ScopeNumbers(StatefulProcessor):
    """A scope's state: the number of every value, and the last number of every category.

    Only the values of a micro-batch's texts are looked up, so its cost does not depend on how many the scope has.
    """

    def __init__(self, labels: dict[str, str]):
        self.labels = labels

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", "category string, norm string", "number bigint")
        self.last = handle.getMapState("last", "category string", "number bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        # every look at the state is a message: a new scope has none to read, and a value or a category is read and written once
        known, last, old = {}, {}, self.last.exists()
        before = {}

        def number(value: tuple[str, str]) -> tuple[int, bool]:
            if value in known:
                return known[value], False
            found = self.numbers.getValue(value) if old else None
            if found is not None:
                known[value] = found[0]
                return found[0], False
            category = value[0]
            if category not in last:
                found = self.last.getValue((category,)) if old else None
                last[category] = before[category] = found[0] if found is not None else 0
            known[value] = last[category] = last[category] + 1
            self.numbers.updateValue(value, (known[value],))
            return known[value], True

        for row in sorted(rows, key=lambda r: r["ord"]):
            parts, at, entries = [], 0, []
            for span in row["spans"]:
                count, new = number((span["category"], span["norm"]))
                name = f"[{self.labels[span['category']]}_{count}]"
                parts += (row["text"][at : span["start"]], name)
                at = span["start"] + span["len"]
                if new:
                    entries.append(Row(placeholder=name, original=span["original"], category=span["category"]))
            yield Row(scope_id=key[0], ord=row["ord"], anonymized_text="".join((*parts, row["text"][at:])), entries=entries)
        for category, count in last.items():
            if count != before[category]:
                self.last.updateValue((category,), (count,))

    def close(self) -> None:
        pass


def anonymize_stream(texts: DataFrame, options: Options | None = None) -> DataFrame:
    """A streaming ``(scope_id, ord, text)`` to ``(scope_id, ord, anonymized_text, entries)``.

    ``entries`` are the mapping's new rows, ``(placeholder, original, category)``.  Values keep their numbers over
    micro-batches; within one, texts are taken by ``ord``.  Where texts arrive in the order of ``ord``, all entries are the mapping that
    ``anonymize_scopes`` gives for all texts at once.  A micro-batch that is run again changes nothing.  Null texts become empty.
    """
    options = options or Options()
    send_package(texts.sparkSession)
    use_rocksdb(texts.sparkSession)
    found = accepted_spans(texts.select("scope_id", "ord", F.coalesce("text", F.lit("")).alias("text")), options)
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"), s["original"].alias("original"), s["category"].alias("category"), normalize(s["original"]).alias("norm")))
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = f"scope_id {kinds['scope_id']}, ord {kinds['ord']}, anonymized_text string, entries array<struct<placeholder:string,original:string,category:string>>"
    processor = ScopeNumbers(LABELS.get(options.language, LABELS["de"]))
    return found.select("scope_id", "ord", "text", spans.alias("spans")).groupBy("scope_id").transformWithState(processor, schema, "append", "None")


class NewestRun(StatefulProcessor):
    """A scope's newest run and phase; results that are not newer are dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "run_gen bigint, phase bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        newest = max(rows, key=lambda r: (r["run_gen"], r["phase"]))
        now = newest["run_gen"], newest["phase"]
        if not self.newest.exists() or tuple(self.newest.get()) < now:
            self.newest.update(now)
            yield newest

    def close(self) -> None:
        pass


def latest_stream(results: DataFrame, key: str = "scope_id") -> DataFrame:
    """A streaming ``(key, run_gen, phase, ...)`` to its rows that are newer than all before them in their scope.

    Whatever the order and the micro-batches, the last row of a scope is the one of ``findings.latest_runs``: the newest run's last phase.
    ``run_gen`` and ``phase`` must not be null.
    """
    send_package(results.sparkSession)
    use_rocksdb(results.sparkSession)
    return results.groupBy(key).transformWithState(NewestRun(), results.schema, "append", "None")
