"""State of streams: order, ends by time, what is kept and what goes."""

import json
import random
import time

from veilframe.operators.anonymize import anonymize_scopes
from veilframe.operators.findings import ask_known, latest_runs
from veilframe.options import Options
from veilframe.sources import mapping_files
from veilframe.streaming import scopes
from veilframe.streaming.sse import restore_batch, restore_stream

from test_plumbing import delta, texts

SCHEMA = "stream_id string, seq long, chunk string, last boolean"


def run(spark, folder, batches, start, name, until=lambda progress: True, schema=SCHEMA):
    """Each batch is a file that is read before the next one is there; then until a condition on the last progress holds."""
    spark.createDataFrame([], schema).write.parquet(f"{folder}/in/empty")
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    query = start(source).writeStream.format("memory").outputMode("append").queryName(name).option("checkpointLocation", f"{folder}/state").start()
    read = 0

    def wait(good):
        for _ in range(600):  # with timers there is always a next batch, so one cannot wait for the end
            if query.exception():
                raise query.exception()
            progress = [json.loads(p.json) for p in query.recentProgress]
            if good(progress):
                return
            time.sleep(0.2)
        raise TimeoutError

    try:
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
            read += len(batch)
            wait(lambda progress: sum(p["numInputRows"] for p in progress) >= read)
        wait(lambda progress: until(progress[-1]))
    finally:
        query.stop()
    return spark.table(name).collect()


def test_any_cut_and_order_gives_the_batch_result(spark, tmp_path):
    stop = 'data: {"type":"content_block_stop","index":0}\n\n'
    streams = {"a": delta("Hi [NA") + delta("ME_1]! [op") + stop, "b": delta('{"x": "[NAME', "input_json_delta", "partial_json", 1) + delta('_1]"}', "input_json_delta", "partial_json", 1)}
    rng, rows = random.Random(3), []
    for name, text in streams.items():
        cut = [text[i : i + 40] for i in range(0, len(text), 40)]
        rows += [(name, i, c, i == len(cut) - 1) for i, c in enumerate(cut)]
    mapping = spark.createDataFrame([(s, "[NAME_1]", 'Max "M"') for s in streams] + [("none", "[NAME_1]", "x")], "scope_id string, placeholder string, original string")
    rng.shuffle(rows)
    batches = [rows[i::3] for i in range(3)]
    got = run(spark, tmp_path, [*batches, batches[0]], lambda s: restore_stream(s, mapping), "any_order")
    want = {r.stream_id: r.text for r in restore_batch(spark.createDataFrame(rows, SCHEMA), mapping).collect()}
    assert {s: "".join(r.text for r in sorted((r for r in got if r.stream_id == s), key=lambda r: r.seq)) for s in streams} == want
    assert texts(want["a"]) == 'Hi Max "M"! [op'


def test_a_stream_ends_by_time(spark, tmp_path):
    mapping = spark.createDataFrame([("s", "[NAME_1]", "Max")], "scope_id string, placeholder string, original string")
    first = delta("Hi [NAME_1]")
    batches = [[("s", 0, first[:-2], False), ("s", 2, "\n\n" + delta("late"), False)]]  # chunk 1 never comes, nor does the last
    empty = lambda progress: progress["batchId"] > 2 and sum(o["numRowsTotal"] for o in progress["stateOperators"]) == 0
    got = run(spark, tmp_path, batches, lambda s: restore_stream(s, mapping, 3000), "by_time", empty)
    assert "".join(texts(r.text) for r in sorted(got, key=lambda r: r.seq)) == "Hi Maxlate"


def test_numbers_go_on_in_the_state(spark, tmp_path):
    schema = "scope_id long, ord long, text string"
    batches = [[(1, 1, "c@d.ch a@b.ch"), (1, 0, "a@b.ch 10.0.0.1")], [(2, 0, "x@y.ch"), (1, 2, "A  10.0.0.2 c@d.ch")], [(1, 3, None), (2, 1, "x@y.ch z@y.ch")]]
    got = run(spark, tmp_path, batches, lambda s: scopes.anonymize_stream(s, Options.only("emails", "ips", language="en")), "numbers", schema=schema)
    texts_want, mapping_want = anonymize_scopes(spark.createDataFrame([r for b in batches for r in b], schema), Options.only("emails", "ips", language="en"))
    assert {(r.scope_id, r.ord): r.anonymized_text for r in got} == {(r.scope_id, r.ord): r.anonymized_text for r in texts_want.collect()}
    assert sorted((r.scope_id, e.placeholder, e.original, e.category) for r in got for e in r.entries) == sorted((r.scope_id, r.placeholder, r.original, r.category) for r in mapping_want.collect())


def test_late_results_are_dropped(spark, tmp_path):
    schema = "scope_id long, run_gen long, phase long, note string"
    rows = [(s, g, p, f"{g}/{p}") for s in (1, 2) for g in (1, 2, 3) for p in (0, 1)]
    random.Random(1).shuffle(rows)
    got = run(spark, tmp_path, [rows[:5], rows[5:8], rows[8:], rows[:5]], scopes.latest_stream, "newest", schema=schema)
    last = {}
    for r in got:
        assert r.scope_id not in last or (last[r.scope_id].run_gen, last[r.scope_id].phase) < (r.run_gen, r.phase)
        last[r.scope_id] = r
    assert {tuple(r) for r in last.values()} == {tuple(r) for r in latest_runs(spark.createDataFrame(rows, schema)).select("scope_id", "run_gen", "phase", "note").collect()}


def test_a_store_changes_only_what_it_must(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(i, f"[N_{i}]", "x") for i in range(2000)], "scope_id long, placeholder string, original string")
    assert mapping_files.load_scopes(spark, path) is None
    mapping_files.replace_scopes(spark, path, rows)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    new = spark.createDataFrame([(7, "[NEW_1]", "y"), (7, "[NEW_2]", "z")], rows.schema)
    mapping_files.replace_scopes(spark, path, new, spark.createDataFrame([(8,), (5000,)], "scope_id long"))
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    changed = {f.parent.name for f in before.keys() ^ after.keys()}
    assert 1 <= len(changed) <= 3 and all(after[f] == before[f] for f in before.keys() & after.keys())
    got = {(r.scope_id, r.placeholder) for r in mapping_files.load_scopes(spark, path).collect()}
    assert got == {(i, f"[N_{i}]") for i in range(2000) if i not in (7, 8)} | {(7, "[NEW_1]"), (7, "[NEW_2]")}
    assert {r.placeholder for r in mapping_files.load_scopes(spark, path, new).collect()} == {"[NEW_1]", "[NEW_2]"}
    mapping_files.replace_scopes(spark, path, rows.where("false"), rows.select("scope_id"))
    assert not list((tmp_path / "store").rglob("*.parquet")) or mapping_files.load_scopes(spark, path).count() == 0


def test_known_texts_are_not_asked_again(spark, tmp_path):
    log = tmp_path / "asked"

    def detector(batch):
        with open(log, "a") as f:
            f.writelines(f"{len(batch)}:{t}\n" for t in batch)
        return [t.upper() for t in batch]

    path = f"file://{tmp_path}/answers"
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "i long, text string")
    assert {r.i: r.answer for r in ask_known(first, detector, path, "m1", batch=2).collect()} == {1: "A", 2: "A", 3: "", 4: "B"}
    asked = log.read_text().splitlines()
    assert sorted(x.split(":")[1] for x in asked) == ["", "a", "b"] and all(int(x.split(":")[0]) <= 2 for x in asked)
    more = first.unionByName(spark.createDataFrame([(5, "c")], first.schema))
    assert {r.i: r.answer for r in ask_known(more, detector, path, "m1").collect()}[5] == "C"
    assert [x.split(":")[1] for x in log.read_text().splitlines()[3:]] == ["c"]
    ask_known(first, detector, path, "m2").collect()
    assert len(log.read_text().splitlines()) == 7
