"""Requests, responses, streams, layout, files and the registry."""

import json

import pytest
from pyspark.sql import functions as F

from veilframe.categories import LABELS, parse_language
from veilframe.functions.restorer import Restorer
from veilframe.operators import audit, findings, gateway, layout, numbering, restore
from veilframe.options import Options, pick_model
from veilframe.sources import mapping_files, pdf_files, words
from veilframe.streaming import sse
from veilframe.streaming.sse import EventRestorer, latest_mapping, upsert_mapping


def test_languages_and_models():
    assert [parse_language(x) for x in ("Deutsch", " FR ", "xx", None)] == ["de", "fr", "en", "en"]
    assert {len(v) for v in LABELS.values()} == {15}
    assert pick_model(["nomic-embed", "b", "llama3"], None, "llama") == "llama3" and pick_model(["embed"], "x", "y") is None


def test_restore_rules(spark):
    entries = [("[NAME_1]", "$& \\1"), ("name_1", "late"), ("[NAME_11]", "eleven"), ("", "no")]
    text = "[ name_1 ] [NAME_11] [NAME_2] []"
    assert Restorer(entries)(text) == "$& \\1 eleven [NAME_2] []"
    df = spark.createDataFrame([(text, entries)], "t string, m array<struct<placeholder:string,original:string>>")
    assert df.select(restore.restore_text(F.col("t"), restore.lookup_map(F.col("m"))).alias("r")).first().r == "$& \\1 eleven [NAME_2] []"


def test_request_and_response(spark):
    body = {
        "stream": True,
        "system": [{"type": "text", "text": "Mail a@b.ch"}],
        "messages": [{"role": "user", "content": "c@d.ch"}, {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "a@b.ch"}]}, {"type": "image", "source": {"data": "a@b.ch"}}]}],
    }
    requests = spark.createDataFrame([(1, json.dumps(body)), (2, "no json"), (3, '{"messages": 7}'), (4, None)], "request_id long, body string")
    bodies, mapping = gateway.anonymize_requests(requests, Options())
    got = {r.request_id: r.body for r in bodies.collect()}
    new = json.loads(got[1])
    assert new["system"][0]["text"] == "Mail [EMAIL_1]" and new["messages"][0]["content"] == "[EMAIL_2]"
    assert new["messages"][1]["content"][0]["content"][0]["text"] == "[EMAIL_1]" and new["messages"][1]["content"][1] == body["messages"][1]["content"][1] and new["stream"] is True
    assert got[2] == "no json" and got[3] == '{"messages": 7}' and got[4] is None
    answer = {"content": [{"type": "text", "text": "An [EMAIL_1]"}, {"type": "tool_use", "input": {"[EMAIL_2]": ["[EMAIL_2]"]}}]}
    responses = spark.createDataFrame([(1, json.dumps(answer)), (2, "[EMAIL_1]")], "request_id long, body string")
    back = {r.request_id: r.body for r in gateway.restore_responses(responses, mapping).collect()}
    assert json.loads(back[1]) == {"content": [{"type": "text", "text": "An a@b.ch"}, {"type": "tool_use", "input": {"[EMAIL_2]": ["c@d.ch"]}}]} and back[2] == "[EMAIL_1]"


def delta(text, kind="text_delta", field="text", index=0):
    return f"event: content_block_delta\ndata: {json.dumps({'type': 'content_block_delta', 'index': index, 'delta': {'type': kind, field: text}})}\n\n"


def texts(stream, field="text"):
    return "".join(json.loads(line[6:]).get("delta", {}).get(field, "") for line in stream.split("\n") if line.startswith("data: {"))


def test_stream_machine():
    entries = [("[NAME_1]", 'Max "M"')]
    stream = delta("Hi [NA") + delta("ME_1]! [op") + 'data: {"type":"content_block_stop","index":0}\n\n' + delta('{"a": "[NAME', "input_json_delta", "partial_json", 1) + delta('_1]"}', "input_json_delta", "partial_json", 1) + "data: [DONE]\r\n\r\n: note\n\n"
    for size in (1, 5, 1000):
        machine, out = EventRestorer(entries), ""
        for i in range(0, len(stream), size):
            out += machine.push(stream[i : i + size])
            machine = EventRestorer(entries, machine.carry, machine.lines, machine.pending)
        out += machine.complete()
        assert texts(out) == 'Hi Max "M"! [op'
        assert json.loads(texts(out, "partial_json")) == {"a": 'Max "M"'}
        assert out.endswith("data: [DONE]\r\n\r\n: note\n\n")


def test_mapping_versions(spark, tmp_path):
    schema = "scope_id string, placeholder string, original string, category string, pos long"
    upsert_mapping(spark.createDataFrame([("s", "[A_1]", "x", "term", 0)], schema), str(tmp_path / "m"))
    upsert_mapping(spark.createDataFrame([("s", "[A_1]", "y", "term", 0), ("s", "[A_2]", "z", "term", 1)], schema), str(tmp_path / "m"))
    version, table = latest_mapping(spark, str(tmp_path / "m"))
    assert version == 2 and {(r.placeholder, r.original) for r in table.collect()} == {("[A_1]", "x"), ("[A_2]", "z")}


def test_mapping_files(spark):
    files = spark.createDataFrame([("a", '[{"placeholder":"[X_1]","original":"v","category":"what"},{"placeholder":"","original":"v"},{"placeholder":"[Y]"}]'), ("b", "no json")], "scope_id string, body string")
    assert [tuple(r) for r in mapping_files.import_json(files).collect()] == [("a", 0, "[X_1]", "v", "term")]
    old = spark.createDataFrame([("a", 0, "[O]", "o", "term"), ("b", 0, "[P]", "p", "term")], "scope_id string, pos int, placeholder string, original string, category string")
    assert {r.placeholder for r in mapping_files.replace_imported(old, files).collect()} == {"[X_1]", "[P]"}


def test_answers_and_progress(spark):
    answers = ['{"entities":[{"text":"A","category":"Company"},{"text":"A"},{"text":5,"category":"zzz"}]}', "```json\n{\"entities\":[{\"text\":\"B\"}]}\n```", "rubbish", '{"entities":', '{"entities":{}}', None, ""]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i long, a string")
    got = {r.i: [tuple(x) for x in r.f] for r in df.select("i", findings.parse_answer(F.col("a")).alias("f")).collect()}
    assert got[0][0] == ("A", "org") and got[1] == [("B", "term")] and all(got[i] == [] for i in range(2, 7))
    lines = ['{"status":"p","total":10,"completed":25}', '{"error":"bad"}', '{"status":"success"}', "[1]", "x", None, ""]
    rows = [r.p for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, l string").orderBy("i").select(findings.pull_progress(F.col("l")).alias("p")).collect()]
    assert [tuple(r) if r else None for r in rows] == [("p", 100, False, False), ("bad", None, False, True), ("success", None, True, False), None, None, None, None]


def test_model_callable(spark):
    from veilframe.session import send_package

    send_package(spark)
    df = findings.ask_model(spark.createDataFrame([(1, "x")], "i long, text string"), lambda batch: [t.upper() for t in batch])
    assert df.first().answer == "X"


def test_redaction(spark):
    def word(page, i, text, x, y):
        return (page, i, text, float(x), float(y), float(x + 50), float(y + 10))

    rows = [word(1, 0, "Frau", 0, 0), word(1, 1, "Anna", 60, 1), word(1, 2, "Meier", 120, 0), word(1, 3, "Kunde:", 0, 30), word(1, 4, "Anna", 60, 30), word(1, 5, "Meier", 120, 31), (1, 6, "x", None, None, None, None), word(2, 0, "Herr", 0, 0), word(2, 1, "Beat", 60, 0)]
    df = spark.createDataFrame(rows, "page_id long, word_idx long, text string, x0 double, y0 double, x1 double, y1 double")
    boxes, lines, mapping = layout.plan_redaction(df, Options(), scope=F.lit("doc"))
    got = sorted((r.page_id, r.x0, r.y0, r.x1, r.y1, r.placeholder) for r in boxes.collect())
    assert got == [(1, 60.0, 0.0, 170.0, 11.0, "[NAME_1]"), (1, 60.0, 30.0, 170.0, 41.0, "[NAME_1]"), (2, 60.0, 0.0, 110.0, 10.0, "[NAME_2]")]
    assert layout.page_texts(lines, "anonymized_text").where("page_id = 1").first().text == "Frau [NAME_1]\nKunde: [NAME_1] x"


def test_words_and_pdf(spark):
    lines = ["5\t1\t1\t1\t1\t1\t10\t20\t30\t8\t90\t Wort ", "5\t1\t1\t1\t1\t1\t10\t20\t30\t8\t20\tleise", "4\t1\t1\t1\t1\t1\t10\t20\t30\t8\t90\tblock", "kurz", "5\t1\t1\t1\t1\t1\t10\t20\t30\t8\t90\t "]
    got = words.tsv_words(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "page_id long, line_no long, line string")).collect()
    assert [tuple(r)[2:] for r in got] == [("Wort", 10.0, 20.0, 40.0, 28.0)]
    pdf = pdf_files.images_to_pdf([(b"JPEG", 10, 20), (b"JPG2", 30, 40)])
    table = int(pdf.split(b"startxref\n")[1].split(b"\n")[0])
    assert pdf.startswith(b"%PDF-1.4\n") and pdf[table : table + 4] == b"xref" and pdf.count(b"/DCTDecode") == 2
    for i, line in enumerate(pdf[table:].split(b"\n")[3:11], 1):
        assert pdf[int(line[:10]) :].startswith(b"%d 0 obj" % i)


def test_audit(spark):
    mapping = spark.createDataFrame([(1, "name", 0), (1, "email", 1), (1, "name", 2), (2, "sensitive", 0)], "scope_id long, category string, pos long")
    scopes = spark.createDataFrame([(1,), (2,), (3,)], "scope_id long")
    assert {r.scope_id: r.summary for r in audit.audit_summary(mapping, scopes).collect()} == {1: "3 Platzhalter (name×2, email×1)", 2: "1 Platzhalter (sensitive×1)", 3: "keine PII"}
    assert {r.scope_id: r.n_sensitive for r in audit.sensitive_count(mapping).collect()} == {1: 0, 2: 1}


def test_registry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_documents_use_all_default_kinds(spark, tmp_path):
    from veilframe.plans.queries import QUERIES

    text = "Call +41 44 123 45 67, IBAN CH93 0076 2011 6238 5295 7."
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    row = QUERIES["anonymize_documents"](spark, str(tmp_path)).first()
    assert "123 45 67" not in row.anonymized_text and "6238" not in row.anonymized_text and row.n_values == 2
    assert QUERIES["roundtrip_documents"](spark, str(tmp_path)).first().restored == text


def test_rows_that_no_parser_likes(spark):
    """Deep nesting, halves of surrogate pairs and numbers that are none leave the job running."""
    deep = "[" * 100_000 + "]" * 100_000
    half = '{"system": "a@b.ch \\ud800", "messages": [], "x": "\\udfff", "n": 1e400}'
    requests = spark.createDataFrame([(1, deep), (2, half), (3, '{"system": "a@b.ch", "n": NaN}')], "request_id long, body string")
    bodies, mapping = gateway.anonymize_requests(requests, Options())
    got = {r.request_id: r.body for r in bodies.collect()}
    assert got[1] == deep and got[3].endswith("NaN}")
    assert json.loads(got[2])["system"].startswith("[EMAIL_1] ") and json.loads(got[2])["x"] == "\udfff" and "Infinity" not in got[2]
    names = spark.createDataFrame([(i, "[EMAIL_1]", "a@b.ch", 0) for i in (1, 2, 3)], "scope_id long, placeholder string, original string, pos int")
    back = {r.request_id: r.body for r in gateway.restore_responses(bodies, names).collect()}
    assert back[1] == deep and json.loads(back[2])["system"].startswith("a@b.ch")
    machine = EventRestorer([])
    assert machine.push("data: " + deep + "\n\n") + machine.complete() == "data: " + deep + "\n\n"


def test_odd_progress_and_seeds(spark):
    lines = ['{"total": "x", "completed": 1}', '{"total": 1, "completed": 1e17}', '{"total": 3, "completed": 1}', '{"total": "NaN", "completed": 1}', '{"total": 7, "completed": -5}']
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    assert [r.p for r in df.orderBy("i").select(findings.pull_progress(F.col("line")).percent.alias("p")).collect()] == [None, 100, 33, None, 0]
    seed = spark.createDataFrame([(1, "name", "[NAME_99999999999999999999]"), (1, "name", "[NAME_99999999999]"), (1, "name", "[X]")], "scope_id long, category string, placeholder string")
    assert [r.largest for r in numbering.seed_numbers(seed).collect()] == [99_999_999_999]


def test_import_limit(spark):
    body = json.dumps([{"placeholder": "[X_1]", "original": "o" * 100, "category": "name"}])
    files = spark.createDataFrame([(1, body)], "scope_id long, body string")
    assert mapping_files.import_json(files).count() == 1
    with pytest.raises(Exception, match="larger than 50 bytes"):
        mapping_files.import_json(files, 50).collect()


def test_numbers_go_on_over_batches(spark, tmp_path):
    path, options = f"file://{tmp_path}/m", Options.only("emails")
    batches = [[(1, 0, "a@b.ch c@d.ch")], [(1, 1, "e@f.ch c@d.ch"), (2, 0, "x@y.ch")], [(1, 2, "a@b.ch g@h.ch")]]
    out = [sse.continue_scopes(spark.createDataFrame(b, "scope_id long, ord long, text string"), path, options).collect() for b in batches]
    assert {r.anonymized_text for rows in out for r in rows} == {"[EMAIL_1] [EMAIL_2]", "[EMAIL_3] [EMAIL_2]", "[EMAIL_1]", "[EMAIL_1] [EMAIL_4]"}
    assert mapping_files.load_scopes(spark, path).count() == 5
