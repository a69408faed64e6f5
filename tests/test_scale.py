"""Work is dealt to all cores, and large tables take no more than they need."""

import random

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from veilframe.plans import cases
from veilframe.operators import gateway, layout, literals, numbering, resolve
from veilframe.operators.anonymize import anonymize_scopes
from veilframe.operators.detectors import REGISTRY
from veilframe.operators.restore import restore_wide
from veilframe.options import Options
from veilframe.sources import pdf_files
from veilframe.streaming.scopes import ScopeNumbers
from veilframe.streaming.sse import restore_batch


def test_texts_of_one_file_are_many_tasks_work(spark, sf_dir):
    texts = cases.case_texts(spark, sf_dir)
    assert spark.read.parquet(f"{sf_dir}/orders.parquet").rdd.getNumPartitions() == 1
    assert texts.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert texts.count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_streams_meet_python_in_batches(spark):
    rows = [(s, i, c) for s in (None, 1, 2) for i, c in ((1, 'data: {"type":"content_block_delta","delta":{"type":"text_delta","te'), (2, 'xt":"a [N_1]"}}\n\n'), (3, None), (0, ":\n\n"))]
    chunks = spark.createDataFrame(rows, "stream_id long, seq long, chunk string")
    mapping = spark.createDataFrame([(None, "[N_1]", "none"), (1, "[N_1]", "one"), (9, "[N_1]", "nine")], "scope_id long, placeholder string, original string")
    out = restore_batch(chunks, mapping)
    assert "CoGroup" not in plan(out)
    got = {r.stream_id: r.text for r in out.collect()}
    shown = ':\n\ndata: {{"type":"content_block_delta","delta":{{"type":"text_delta","text":"a {}"}}}}\n\n'
    assert got == {None: shown.format("none"), 1: shown.format("one"), 2: shown.format("[N_1]")}


def test_bodies_become_objects_in_slices(spark, monkeypatch):
    """A worker holds the texts of a slice as objects, not those of a whole Arrow batch."""
    batch = pa.RecordBatch.from_pylist([{"request_id": i, "body": "x" * 1000} for i in range(5000)] + [{"request_id": -1, "body": "y" * (3 << 20)}])
    parts = list(gateway._sliced(iter([batch, batch.slice(0, 0)])))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and max(p.num_rows for p in parts) < 1000
    requests = spark.createDataFrame([(1, '{"system":"a","messages":[{"content":"b"}]}'), (None, "no json"), (3, None), (4, "{}")], "request_id long, body string")
    slots = gateway.extract_slots(requests)
    assert "MapInArrow" in plan(slots) and "ArrowEvalPython" not in plan(slots)
    assert sorted(map(tuple, slots.where("request_id = 1").collect())) == [(1, 0, "system", "a"), (1, 1, "messages/0/content", "b")]
    assert [tuple(r) for r in slots.where("request_id is null or request_id > 1").collect()] == [(None, 0, "*", "no json")]


class Counted:
    """A state of a stream that counts the messages to it."""

    def __init__(self):
        self.kept, self.messages = {}, 0

    def __getattr__(self, name):
        def call(key=None, value=None):
            self.messages += 1
            if name == "updateValue":
                self.kept[key] = value
            return {"exists": bool(self.kept), "containsKey": key in self.kept, "getValue": self.kept.get(key)}.get(name)

        return call


def test_numbers_of_a_scope_take_few_messages():
    processor = ScopeNumbers({"email": "EMAIL"})
    processor.numbers, processor.last = Counted(), Counted()

    def texts(first, *values):
        spans = [Row(start=0, len=1, original=v, category="email", norm=v) for v in values]
        return [Row(ord=first + i, text="x", spans=[s]) for i, s in enumerate(spans)]

    def run(rows):
        return [r.anonymized_text for r in processor.handleInputRows((1,), iter(rows), None)]

    assert run(texts(0, "a", "b", "a", "c", "b")) == ["[EMAIL_1]", "[EMAIL_2]", "[EMAIL_1]", "[EMAIL_3]", "[EMAIL_2]"]
    assert processor.numbers.messages + processor.last.messages == 5  # one look, three values, one last number
    assert run(texts(5, "c", "d", "c")) == ["[EMAIL_3]", "[EMAIL_4]", "[EMAIL_3]"]
    assert processor.last.kept == {("email",): (4,)}


def test_pages_meet_python_in_batches(spark):
    pages = spark.createDataFrame([(1, 1, b"bb", 3, 4), (1, 0, b"a", 1, 2), (None, 0, b"c", 5, 6)], "doc_id long, page_no int, jpeg binary, width int, height int")
    out = pdf_files.write_pdfs(pages)
    assert "FlatMapGroups" not in plan(out)
    assert {r.doc_id: bytes(r.pdf) for r in out.collect()} == {1: pdf_files.images_to_pdf([(b"a", 1, 2), (b"bb", 3, 4)]), None: pdf_files.images_to_pdf([(b"c", 5, 6)])}


def test_spans_of_small_texts_take_no_rounds(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(t, rng.randint(0, 90), rng.randint(0, 12), rng.randint(0, 3), i) for t in (None, 1, 2, 3) for i in range(30 if t == 3 else 12)]
    spans = spark.createDataFrame(rows, "t long, start int, len int, priority int, seq int")

    def kept(few):
        written.clear()
        return sorted(map(repr, resolve.resolve_spans(spans, ("t",), few=few).collect()))

    written, write = [], resolve.materialize
    monkeypatch.setattr(resolve, "materialize", lambda df, name: written.append(name) or write(df, name))
    rounds = kept(0)
    assert "taken" in written and rounds
    assert kept(256) == rounds and "taken" not in written
    assert kept(15) == rounds and "taken" in written


def test_terms_that_stand_nowhere_are_not_taken_apart(spark, monkeypatch):
    texts = spark.createDataFrame([(1, 0, "the strasse"), (2, 0, "ox")], "scope_id long, ord long, text string")
    terms = spark.range(500).selectExpr("concat('absent', id) as text").unionByName(spark.createDataFrame([("Stra",), ("OX",)], "text string"))
    written, write = {}, literals.materialize
    monkeypatch.setattr(literals, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    found = {r.scope_id: [t.text for t in r.found] for r in literals.terms_by_text(texts, terms).collect()}
    assert found == {1: ["Stra"], 2: ["OX"]}
    assert "term-groups" not in written and written["anchors"].count() < 50


def test_small_scopes_are_a_row_each(spark):
    """Scopes of few spans are numbered, replaced and restored without joins of spans; larger ones as tables, with the same result."""
    rows = [(s, i, t) for s, n in ((1, 2), (2, 9), (3, 1), (None, 2)) for i, t in ((n - j, f"von b{j % 3}@x.org an a@y.org , B{j}@x.org , 10.0.0.{j % 2}" if j % 4 != 3 else "nichts") for j in range(n))] + [(4, 0, None), (5, 0, "leer")]
    texts = spark.createDataFrame(rows, "scope_id long, ord long, text string")
    options = Options.only("emails", "ips")
    few, mapping = anonymize_scopes(texts.where("scope_id is not null"), options)
    assert "Join" not in plan(few) and "Join" not in plan(mapping)
    want, want_mapping = anonymize_scopes(texts, options, few=0)
    for n in (0, 5, 7, 4096):
        out, mapping = anonymize_scopes(texts, options, few=n)
        assert sorted(out.collect(), key=str) == sorted(want.collect(), key=str) and out.count() == len(rows)
        assert sorted(mapping.collect(), key=str) == sorted(want_mapping.collect(), key=str)
        for k in (0, 3, 1024):
            back = restore_wide(out, mapping, text="anonymized_text", few=k).where("scope_id is not null").collect()
            assert sorted((r.scope_id, r.ord, r.restored) for r in back) == sorted((s, i, t or "") for s, i, t in rows if s is not None)
    assert "Join" in plan(want)
    pairs = spark.createDataFrame([(1, "[A_1]", "late", 2), (1, " a_1 ", "first", 1), (1, "[]", "none", 0), (1, "[B_1]", None, 3)], "scope_id long, placeholder string, original string, pos long")
    said = spark.createDataFrame([(1, 0, "x [a_1] [B_1] [C_1]"), (2, 0, "[A_1]")], "scope_id long, ord long, text string")
    assert restore_wide(said, pairs).collect() and all(sorted(r.restored for r in restore_wide(said, pairs, few=k).collect()) == ["[A_1]", "x first [B_1] [C_1]"] for k in (0, 9))


def test_words_are_looked_for_where_their_letters_are(spark):
    """Patterns of words rule out most places by one letter, and find what they find without it."""
    said = ["ſchaden Nr. ABC123, Kunden-Nr. K1234, ınvoice No. 77777", "GEB. 01.02.1990 born on 1/2/1990, née le 3.4.1999", "aZH 1234, ZH 123456 TI-123", "KundE: Max, Kunde: Max Muster, Prénom: Anna", "HerrHerr Max, Dr. Anna", "BIC: UBSWCHZH, N. IVA CHE12345678"]
    texts = spark.createDataFrame([(t,) for t in said], "text string").repartition(1).cache()
    for name in ("bic", "vat", "reference", "birth_date", "plate", "salutation_name", "keyword_name"):
        d = REGISTRY[name]
        marks = "<$1|$2>" if d.grouped else "<$0>"
        plain = d.regex.replace(d.entry, "", 1)
        assert d.entry.startswith("(?=[") and d.entry not in plain
        rows = texts.select("text", F.regexp_replace("text", d.regex, marks).alias("a"), F.regexp_replace("text", plain, marks).alias("b")).collect()
        assert all(r.a == r.b for r in rows) and any(r.a != r.text for r in rows)


def test_small_scopes_go_on_from_a_mapping_in_a_row(spark, monkeypatch):
    """Scopes with an earlier mapping are a row each too: known values keep their placeholders, others are numbered on; large ones give the same."""
    rows = [(s, i, f"von b{i % 3}@x.org an  b{i}@x.org , 10.0.0.{i % 2}" if i % 4 else "nichts") for s, n in ((1, 3), (2, 9), (3, 2), (None, 2)) for i in range(n)]
    texts = spark.createDataFrame(rows, "scope_id long, ord long, text string")
    old = [(1, "[EMAIL_7]", "b1@x.org", "email", 1), (1, "[EMAIL_9]", "b1@x.org", "email", 2), (1, "[IP_x]", "10.0.0.1", "ip", 1), (2, "[EMAIL_3]", None, "email", 1), (2, "[EMAIL_4]", "b2@x.org", None, 1), (2, None, "b5@x.org", "email", 1), (8, "[EMAIL_5]", "z@x.org", "email", 1), (None, "[EMAIL_1]", "b1@x.org", "email", 1)]
    seed = spark.createDataFrame(old, "scope_id long, placeholder string, original string, category string, pos long")
    options = Options.only("emails", "ips")
    want, want_mapping = anonymize_scopes(texts, options, seed=seed, few=0)
    written, write = [], numbering.materialize
    monkeypatch.setattr(numbering, "materialize", lambda df, name: written.append(name) or write(df, name))
    # null scopes are joined; without them nothing is numbered as a table
    here, known = texts.where("scope_id is not null"), seed.where("scope_id is not null")
    got, got_mapping = anonymize_scopes(here, options, seed=known)
    assert not written and {r.placeholder for r in got_mapping.where("original in ('b1@x.org', '10.0.0.1') and scope_id = 1").collect()} == {"[EMAIL_9]", "[IP_x]"}
    assert sorted(map(str, got.collect())) == sorted(map(str, want.where("scope_id is not null").collect()))
    assert sorted(map(str, got_mapping.collect())) == sorted(map(str, want_mapping.where("scope_id is not null").collect()))
    mixed, mixed_mapping = anonymize_scopes(texts, options, seed=seed, few=5)
    assert written and sorted(map(str, mixed.collect())) == sorted(map(str, want.collect())) and sorted(map(str, mixed_mapping.collect())) == sorted(map(str, want_mapping.collect()))


def test_boxes_of_small_scopes_meet_no_tables(spark, monkeypatch):
    """Lines, mapping and boxes of small scopes are rows, those of large ones tables; both as a plain search finds them."""
    rng = random.Random(7)
    said = ["a@x.org", "b@x.org,a@x.org", "(ba@x.org)", "", "10.0.0.1", "Mail", None, "b@x.org"]
    words = []
    for p in range(8):
        y = 0.0
        for i in range(rng.randint(1, 14) if p else 300):
            y += rng.choice([0, 0, 3, 20])
            words.append((p % 3, p, i, rng.choice(said), *((None,) * 4 if rng.random() < 0.15 else (10.0 * i, y, 10.0 * i + 9, y + 12))))
    table = spark.createDataFrame(words, "doc int, page int, word_idx int, text string, x0 double, y0 double, x1 double, y1 double")
    table = table.select(F.struct("doc", "page").alias("page_id"), "word_idx", "text", "x0", "y0", "x1", "y1")
    seed = spark.createDataFrame([(0, "[EMAIL_7]", "a@x.org", "email")], "scope_id int, placeholder string, original string, category string")
    written, write = [], layout.materialize
    monkeypatch.setattr(layout, "materialize", lambda df, name: written.append(name) or write(df, name))

    def plan_of(few):
        boxes, lines, mapping = layout.plan_redaction(table, Options.only("emails", "ips"), seed=seed, scope=F.col("page_id.doc"), few=few)
        return sorted(map(str, boxes.collect())), sorted(map(str, lines.collect())), sorted(map(str, mapping.collect())), boxes

    *want, tables = plan_of(0)
    assert "ranges" in written
    written.clear()
    *got, _ = plan_of(4096)
    assert "ranges" not in written and got == want and len(want[0]) > 20
    assert plan_of(60)[:3] == tuple(want)
    lined = layout.line_texts(layout.with_lines(table)).collect()
    assert sorted((str(r.page_id), r.line_no, r.text) for r in lined) == sorted((str(r.page_id), r.line_no, r.text) for r in layout.page_lines(table).collect())
    # every word with a box and an original in it is under a box of its line
    names = [r.original for r in layout.plan_redaction(table, Options.only("emails", "ips"), seed=seed, scope=F.col("page_id.doc"))[2].where("scope_id = 0").collect()]
    under = [(r.page_id.page, r.x0, r.x1, r.y0, r.y1) for r in tables.where("page_id.doc = 0").collect()]
    for d, p, i, t, x0, y0, x1, y1 in words:
        if d == 0 and t and x0 is not None and any(n in t for n in names):
            assert any(q == p and a <= x0 and x1 <= b and c <= y0 and y1 <= e for q, a, b, c, e in under)


def test_terms_made_of_groups_that_a_text_holds_apart_do_not_meet_it(spark):
    texts = spark.createDataFrame([(1, 0, "abc bcd cde def efg fgh ghi hij ijk"), (2, 0, "xABCDEFx"), (3, 0, "an abcdefghijk"), (4, 0, None)], "scope_id long, ord long, text string")
    terms = spark.createDataFrame([("abcdef",), ("abcdefghijk",), ("defghij",), ("cde",), ("ij",)], "text string")
    found = {r.scope_id: [t.text for t in r.found] for r in literals.terms_by_text(texts, terms).collect()}
    assert found == {1: ["cde", "ij"], 2: ["abcdef", "cde"], 3: ["abcdef", "abcdefghijk", "cde", "defghij", "ij"]}
