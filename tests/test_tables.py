"""Spans, literals and ranges as tables of any size, against loops."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.operators import layout, literals, numbering
from veilframe.operators.anonymize import anonymize_rows, anonymize_scopes
from veilframe.operators.detectors import term_candidates
from veilframe.operators.resolve import resolve_spans
from veilframe.options import Options


def greedy(spans):
    taken = []
    for s in sorted(spans, key=lambda s: (s[2], -s[1], s[0], s[3])):
        if s[1] > 0 and all(s[0] >= t[0] + t[1] or t[0] >= s[0] + s[1] for t in taken):
            taken.append(s)
    return sorted(taken)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_rounds_equal_the_loop(spark, data):
    rng = random.Random(data.draw(st.integers(0, 10_000)))
    rows = []
    for scope in [None, 1, 2, 3, 4]:
        wide = rng.choice([3, 40, 3000])
        rows += [(scope, 0, rng.randint(0, 200), rng.randint(0, wide), rng.randint(0, 3), i, "x") for i in range(rng.randint(0, 60))]
    schema = "scope_id long, ord int, start int, len int, priority int, seq int, level string"
    got = resolve_spans(spark.createDataFrame(rows, schema)).collect()
    for scope in [None, 1, 2, 3, 4]:
        assert sorted((r.start, r.len, r.priority, r.seq) for r in got if r.scope_id == scope) == greedy([r[2:6] for r in rows if r[0] == scope])


def test_rounds_of_a_long_chain_and_of_nothing(spark):
    schema = "scope_id long, ord int, start int, len int, priority int, seq int"
    chain = [(1, 0, 5 * i, 7, i, i) for i in range(12)]  # each overlaps the next, which is worse
    got = resolve_spans(spark.createDataFrame(chain, schema)).collect()
    assert sorted(r.seq for r in got) == list(range(0, 12, 2))
    same = spark.createDataFrame([(1, 0, 3, 4, 1, 1)] * 50 + [(1, 0, 6, 4, 2, 1)], schema)
    assert [tuple(r) for r in resolve_spans(same).collect()] == [(1, 0, 3, 4, 1, 1)]
    assert resolve_spans(same.where("false")).count() == 0


def test_table_of_terms_equals_terms_in_a_row(spark):
    terms = ["ab", "AB", "é", "strasse", "the end", "x", "zz top", "straße", "aaa", "never", "İ", "🎉b"]
    texts = ["Ab aB STRASSE straße", "É the END, aaaa", None, "", "🎉B x", "zztop", "nothing"]
    df = spark.createDataFrame([(i % 3 if i else None, i, t) for i, t in enumerate(texts)], "scope_id long, ord long, text string")
    table = spark.createDataFrame([*((i, t) for i, t in enumerate(terms)), (99, ""), (98, None)], "seq int, text string")
    got = {r.ord: [tuple(c) for c in r.term_candidates] for r in literals.table_candidates(df, table).collect()}
    want = {r.ord: [tuple(c) for c in r.c] if r.c else [] for r in df.select("ord", term_candidates(F.col("text"), tuple(terms)).alias("c")).collect()}
    assert got == want and any(want.values())
    assert literals.table_candidates(df, table.where("false")).where("size(term_candidates) > 0").count() == 0


def test_terms_of_a_table_are_replaced(spark):
    texts = spark.createDataFrame([("s", 0, "Projekt Falke, falke@x.ch"), ("s", 1, "FALKE!")], "scope_id string, ord long, text string")
    terms = spark.createDataFrame([(0, "Falke"), (1, "Adler")], "seq int, text string")
    out, _ = anonymize_scopes(texts, Options.only("custom", "emails"), terms=terms)
    assert {r.ord: r.anonymized_text for r in out.collect()} == {0: "Projekt [BEGRIFF_1], [BEGRIFF_2]@x.ch", 1: "[BEGRIFF_3]!"}
    found = literals.table_candidates(texts, terms)
    assert [r.anonymized_text for r in anonymize_rows(found, Options.only("emails")).orderBy("ord").collect()][1] == "[BEGRIFF_1]!"


def test_first_ranges_equal_loops(spark):
    rng = random.Random(2)
    pieces = [(rng.choice([None, 1, 2]), i, a := rng.randint(0, 500), a + rng.randint(1, 90)) for i in range(80)]
    ranges = [(rng.choice([None, 1, 2]), i, a := rng.randint(0, 500), a + rng.randint(1, 200)) for i in range(40)]
    df = layout.first_ranges(spark.createDataFrame(pieces, "line int, no int, start int, end int"), spark.createDataFrame(ranges, "line int, seq int, start int, end int"), ("line",))
    got = {r.no: r.hit.seq if r.hit else None for r in df.collect()}
    for line, no, a, b in pieces:
        assert got[no] == min((s for k, s, c, d in ranges if line is not None and k == line and a < d and c < b), default=None)


def test_ranges_that_share_bins_make_no_pairs(spark, monkeypatch):
    """Pieces of all lengths, ranges by the hundred on the same characters: one row of a window meets a piece, nothing is written."""
    rng = random.Random(3)
    pieces = [(i, a := rng.choice([0, 40, 63, 64, 65, rng.randint(0, 400)]), a + rng.choice([0, 1, 24, 63, 64, 65, 66, 128, 129, 300])) for i in range(120)]
    ranges = [(i, (f"p{rng.randint(10, 99)}", i), a := rng.randint(0, 420), a + rng.choice([0, 1, 2, 30, 64, 200])) for i in range(300)]
    monkeypatch.setattr(layout, "materialize", lambda df, name: pytest.fail("written"))
    found = layout.first_ranges(spark.createDataFrame([(1, *p) for p in pieces], "line int, no int, start int, end int"), spark.createDataFrame([(1, *r) for r in ranges], "line int, name int, seq struct<page:string,line:int>, start int, end int"), ("line",))
    got = {r.no: tuple(r.hit.seq) if r.hit else None for r in found.collect()}
    assert got == {i: min((s for _, s, c, d in ranges if a < b and c < d and a < d and c < b), default=None) for i, a, b in pieces}
    assert all(r.hit.name == r.hit.seq.line for r in found.collect() if r.hit)


def test_pages_are_put_together_once(spark):
    rng = random.Random(4)
    words = [(p, i, rng.choice(["a", "", "b c"]), 0.0, float(y), 9.0, y + 12.0) for p in (1, 2) for i, y in enumerate(sorted(rng.randint(0, 5) * 20 for _ in range(30)))]
    lined = layout.with_lines(spark.createDataFrame(words, "page_id int, word_idx int, text string, x0 double, y0 double, x1 double, y1 double"))
    got = layout.word_texts(lined)
    assert got._jdf.queryExecution().executedPlan().toString().count("collect_list") < layout.page_texts(layout.line_texts(lined))._jdf.queryExecution().executedPlan().toString().count("collect_list")
    assert sorted(got.collect()) == sorted(layout.page_texts(layout.line_texts(lined)).collect())


def test_numbers_of_any_order(spark):
    rng = random.Random(7)
    rows = [(s, "name", f"v{i}", (f"p{rng.randint(10, 99)}", rng.randint(0, 9)), i, f"v{i}") for s in (1, 2) for i in range(300)]
    values = spark.createDataFrame(rows, "scope_id int, category string, norm string, ord struct<page:string,line:int>, start int, original string")
    got = {(r.scope_id, r.norm): r.number for r in numbering.number_values(values, 7).collect()}
    for s in (1, 2):
        for n, r in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[4])), 1):
            assert got[s, r[2]] == n


def test_seed_without_order(spark):
    spans = spark.createDataFrame([(1, 0, 0, "a", "name"), (1, 0, 5, "b", "name")], "scope_id int, ord int, start int, original string, category string")
    seed = spark.createDataFrame([(1, "name", "a", "[X_9]", 1), (1, "name", "a", "[X_10]", 2)], "scope_id int, category string, original string, placeholder string, pos int")
    assert {r.original: r.placeholder for r in numbering.build_mapping(spans, "de", seed).collect()} == {"a": "[X_10]", "b": "[NAME_11]"}
    with pytest.raises(Exception, match="give it a column pos"):
        numbering.build_mapping(spans, "de", seed.drop("pos")).collect()
