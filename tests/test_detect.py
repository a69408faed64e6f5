"""Detectors on example texts in four languages, resolution, numbering and restoring."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.operators.anonymize import anonymize_rows, anonymize_scopes
from veilframe.operators.detectors import REGISTRY, Detector, any_of, term_candidates, with_candidates
from veilframe.operators.resolve import resolve_overlaps
from veilframe.operators.restore import lookup_map, restore_scopes, restore_text, restore_wide
from veilframe.options import Options, allow, disallow, parse_allowed, parse_lines

GERMAN = (
    "Sehr geehrte Damen, Herr Max Muster (geb. 31.12.1980) wohnt an der Bahnhofstrasse 12a, 8001 Zürich. Seine AHV-Nummer ist 756.1234.5678.97, die Police: Policen-Nr. ABC-123.45. "
    "Telefon +41 79 123 45 67, Mail max.muster@example.ch, IBAN CH93 0076 2011 6238 5295 7. Kennzeichen ZH 123456. Karte 4111 1111 1111 1111, nicht 4111 1111 1111 1112. "
    "Am 01.03.2024 zahlte er 2024 Franken und im 2024 März nichts. Kontakt: Telefon folgt."
)
FOUND = {
    "german": (GERMAN, "de", ["Max Muster", "31.12.1980", "Bahnhofstrasse 12a", "8001 Zürich", "756.1234.5678.97", "ABC-123.45", "+41 79 123 45 67", "max.muster@example.ch", "CH93 0076 2011 6238 5295 7", "ZH 123456", "4111 1111 1111 1111"], ["4111 1111 1111 1112", "01.03.2024", "2024 Franken", "2024 März", "Herr ", "Telefon folgt"]),
    "english": ("Dear Mr. John Smith, born on March 12, 1985, of 12 Main Street. SSN 123-45-6789, Policy No. P-98765, call (555) 123-4567.", "en", ["John Smith", "March 12, 1985", "12 Main Street", "123-45-6789", "P-98765", "(555) 123-4567"], ["Mr. "]),
    "french": ("Madame Claire Dubois, née le 12 mars 1985, Rue de Lausanne 12, 1201 Genève. N° de police 4711-A.", "fr", ["Claire Dubois", "12 mars 1985", "Rue de Lausanne 12", "1201 Genève", "4711-A"], ["Madame "]),
    "italian": ("Sig. Mario Rossi, nato il 01/02/1970, Via Roma 8, 6900 Lugano. Numero polizza 88/99.", "it", ["Mario Rossi", "01/02/1970", "Via Roma 8", "6900 Lugano", "88/99"], ["Sig. "]),
    "swiss": ("Karte 80756012345678901234, UID CHE-123.456.789 MWST, Host 192.168.0.1 und 2001:0db8:85a3:0000:0000:8a2e:0370:7334, VIN WVWZZZ1KZAW123456, BIC: UBSWCHZH80A, VAT: DE123456789.", "de", ["80756012345678901234", "CHE-123.456.789 MWST", "192.168.0.1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "WVWZZZ1KZAW123456", "UBSWCHZH80A", "DE123456789"], ["BIC: ", "VAT: "]),
}


@pytest.fixture(scope="module")
def results(spark):
    out = {}
    for name, (text, language, _, _) in FOUND.items():
        df = spark.createDataFrame([(text,)], "text string")
        out[name] = anonymize_rows(df, Options(language=language)).select("*", restore_text(F.col("anonymized_text"), lookup_map(F.col("mapping"))).alias("restored")).first()
    return out


@pytest.mark.parametrize("name", FOUND)
def test_examples(results, name):
    text, _, gone, kept = FOUND[name]
    row = results[name]
    for value in gone:
        assert value not in row.anonymized_text, value
    for value in kept:
        assert value in row.anonymized_text, value
    assert row.restored == text


def test_labels(results):
    assert "[NAME_1]" in results["german"].anonymized_text and "[AHV_1]" in results["german"].anonymized_text
    assert "[SSN_1]" in results["english"].anonymized_text
    assert "[NOM_1]" in results["french"].anonymized_text
    assert "[DATA_1]" in results["italian"].anonymized_text


def test_empty_and_null(spark):
    rows = anonymize_rows(spark.createDataFrame([("",), (None,), ("nichts",)], "text string")).collect()
    assert [(r.anonymized_text, r.mapping) for r in rows] == [("", []), ("", []), ("nichts", [])]


def test_switches_terms_and_allow_list(spark):
    df = spark.createDataFrame([("Projekt Zebra: a@b.ch und c@d.ch, projekt zebra, 01.03.2024",)], "text string")
    row = anonymize_rows(df, Options(custom_terms=("Projekt Zebra", " "), allowed_values=("A@B.CH ",), all_dates=True)).first()
    assert row.anonymized_text == "[BEGRIFF_1]: a@b.ch und [EMAIL_1], [BEGRIFF_2], [DATUM_1]"
    assert anonymize_rows(df, Options(emails=False)).first().mapping == []


def test_priority_beats_length(spark):
    row = anonymize_rows(spark.createDataFrame([("CH93 0076 2011 6238 5295 7",)], "text string"), Options(custom_terms=("0076",))).first()
    assert row.anonymized_text == "CH93 [BEGRIFF_1] 2011 6238 5295 7"


def test_findings(spark):
    texts = spark.createDataFrame([(1, 0, "Firma Acme AG, acme ag und a@b.ch; beta")], "scope_id long, ord long, text string")
    found = spark.createDataFrame([(1, 0, "Acme AG", "org"), (1, 1, "a@b.ch", "name"), (1, 2, "fehlt", "org"), (1, 3, "BETA", "sensitive"), (1, 4, "x", "org"), (1, 5, "[Firma", "org")], "scope_id long, seq long, text string, category string")
    out, mapping = anonymize_scopes(texts, Options(), found)
    assert out.first().anonymized_text == "Firma [FIRMA_1], acme ag und [EMAIL_1]; [SENSIBEL_1]"
    assert anonymize_scopes(texts, Options(organisations=False), found)[0].first().anonymized_text.startswith("Firma Acme AG")


def test_shared_scope_and_seed(spark):
    texts = spark.createDataFrame([("s", 0, "a@b.ch c@d.ch"), ("s", 1, "c@d.ch e@f.ch"), ("t", 0, "c@d.ch"), ("t", 1, None)], "scope_id string, ord long, text string")
    out, mapping = anonymize_scopes(texts)
    assert {(r.scope_id, r.ord): r.anonymized_text for r in out.collect()} == {("s", 0): "[EMAIL_1] [EMAIL_2]", ("s", 1): "[EMAIL_2] [EMAIL_3]", ("t", 0): "[EMAIL_1]", ("t", 1): ""}
    for restore in (restore_scopes, restore_wide):
        back = restore(out, mapping, text="anonymized_text").collect()
        assert {(r.scope_id, r.ord): r.restored for r in back} == {("s", 0): "a@b.ch c@d.ch", ("s", 1): "c@d.ch e@f.ch", ("t", 0): "c@d.ch", ("t", 1): ""}
    seed = spark.createDataFrame([("s", "[MAIL_7]", "c@d.ch", "email", 0), ("s", "[MAIL_9]", "x@y.ch", "email", 1)], "scope_id string, placeholder string, original string, category string, pos long")
    out, mapping = anonymize_scopes(texts, seed=seed)
    assert {(r.scope_id, r.ord): r.anonymized_text for r in out.where("scope_id = 's'").collect()} == {("s", 0): "[EMAIL_10] [MAIL_7]", ("s", 1): "[MAIL_7] [EMAIL_11]"}


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("aB1@. -+:;äCHE756/", max_size=60), min_size=60, max_size=60))
def test_spans_equal_finditer(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    for name in ("email", "iban", "ip", "phone"):
        want = {i: [(m.start(), m.group()) for m in re.finditer(REGISTRY[name].pattern, t)] for i, t in enumerate(texts)}
        got = {r.i: [(c.start, c.original) for c in r.c or []] for r in with_candidates(df, "text", REGISTRY[name], "c").collect()}
        assert got == want, name


def test_overlaps_equal_brute_force(spark):
    import random

    random.seed(2)
    groups = [[(random.randint(0, 30), random.randint(1, 8), "x", "term", random.randint(0, 3), i) for i in range(12)] for _ in range(40)]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "i long, c array<struct<start:int,len:int,original:string,category:string,priority:int,seq:int>>")
    for row in df.select("i", resolve_overlaps(F.col("c")).alias("r")).collect():
        taken = []
        for c in sorted(groups[row.i], key=lambda c: (c[4], -c[1], c[0], c[5])):
            if not any(c[0] < a[0] + a[1] and a[0] < c[0] + c[1] for a in taken):
                taken.append(c)
        assert [tuple(x) for x in row.r] == sorted(taken)


def test_lists():
    assert parse_lines(" a \n\n b") == ("a", "b")
    assert parse_allowed("A\na\nb") == ("A", "b")
    assert allow(("A",), " a ") == ("A",) and disallow(("A", "b"), "a") == ("b",)


def test_many_values_in_one_text(spark):
    """Two thousand values, numbered and replaced as a plain loop does it, whichever columns are selected."""
    values = [f"user{i % 700}@example.org" if i % 3 else f"10.0.{i % 11}.{i % 50}" for i in range(2000)]
    text, numbers, counts, want = " und ".join(values), {}, {}, []
    for v in values:
        kind = "EMAIL" if "@" in v else "IP"
        if v not in numbers:
            counts[kind] = counts.get(kind, 0) + 1
            numbers[v] = f"[{kind}_{counts[kind]}]"
        want.append(numbers[v])
    df = anonymize_rows(spark.createDataFrame([(1, text)], "id long, text string"), Options.only("emails", "ips"))
    assert df.select("anonymized_text").first()[0] == " und ".join(want)
    row = df.first()
    assert row.anonymized_text == " und ".join(want) and [(m.placeholder, m.original) for m in row.mapping] == [(p, v) for v, p in numbers.items()]


def test_many_terms_in_any_case(spark):
    terms = tuple(f"term{i}" for i in range(300)) + ("Straße", "a.b", "x\\Ey", "\u212a9")
    df = anonymize_rows(spark.createDataFrame([(1, "TERM7 sTRASSE STRAßE A.B axb X\\eY k9 term299!"), (2, None)], "id long, text string"), Options.only("custom", custom_terms=terms, language="en"))
    got = {r.id: r.anonymized_text for r in df.collect()}
    assert got == {1: "[TERM_1] sTRASSE [TERM_2] [TERM_3] axb [TERM_4] [TERM_5] [TERM_6]!", 2: ""}


def test_marks_in_texts_stay(spark):
    text = "\ufdd0a@b.ch\ufdd1 \ufdd0"
    assert anonymize_rows(spark.createDataFrame([(1, text)], "id long, text string"), Options.only("emails")).first().anonymized_text == "\ufdd0[EMAIL_1]\ufdd1 \ufdd0"


def test_addresses_are_read_once_and_touching_ones_found(spark):
    texts = ["a@b.ch5@c.de", "x%a@b.ch.d@e.org", "@a@b.ch", "ä.a@b.ch", "a@b a@b.c a.b@c.de-f@g.hi", "\ufdd0a@b.ch\ufdd1c@d.ch", "a" * 5000 + " b@c.de"]
    assert REGISTRY["email"].entry
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    want = {i: [(m.start(), m.group()) for m in re.finditer(REGISTRY["email"].pattern, t)] for i, t in enumerate(texts)}
    assert {r.i: [(c.start, c.original) for c in r.c or []] for r in with_candidates(df, "text", REGISTRY["email"], "c").collect()} == want


def test_single_values_take_no_sums_of_positions(spark):
    """One value a text: its place is the length of what stands before it; kept, trimmed and numbered as any other."""
    df = spark.createDataFrame([(0, "Kunde: Max Am"), (1, "Kunde: Tel"), (2, "\ufdd0 Kunde: Max Am"), (3, "Kunde: Max Am, Kunde: Eva")], "i long, text string")
    found = with_candidates(df, "text", REGISTRY["keyword_name"], "c", 7)
    assert {r.i: [(c.start, c.len, c.original, c.seq) for c in r.c] for r in found.collect()} == {0: [(7, 3, "Max", 7)], 1: [], 2: [(9, 3, "Max", 7)], 3: [(7, 3, "Max", 7), (22, 3, "Eva", 8)]}


def test_entry_holds_for_all_alternatives_and_hides_no_match(spark):
    only = Detector("x", 1, "x", ("emails",), "ab|cd", entry="(?=a)")
    assert spark.range(1).select(F.regexp_replace(F.lit("ab cd"), only.regex, "-")).first()[0] == "- cd"
    texts = ["+41 79 123 45 67", "(079) 123-4567", "079 123 45 67", "x079 123 45 67", "1.2.3.4", "a::1:b2:3 ab:cd:12", "80712345678901234567", "xPolicy No. P-12 poliCy no. AB-1", "ſinistro n. AB12", "né le 01.02.1999", "GEB. 1.2.1999", "CHE-123.456.789", "٣٣.3.3.3"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for d in REGISTRY.values():
        if d.id != "email":
            flags = "(?iU)" if d.ignore_case else "(?U)"
            assert df.where(F.regexp_replace("text", d.regex, "<$0>") != F.regexp_replace("text", flags + d.pattern, "<$0>")).count() == 0, d.id


def test_pattern_of_terms_shares_how_they_begin(spark):
    terms = ("the", "them", "THEMA", "he", "hem!", "Mär", "märz", "a\\E", "x.y", "ab", "AB", *(f"absent{i}" for i in range(300)))
    assert len(re.findall("absent", any_of(tuple(f"absent{i}" for i in range(300))))) == 1
    texts = ["Thematic hem! MÄRZ", "abSENT299 a\\e x.y xzy ſ", "absen Absent7absent77", "nothing?", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: [(c.start, c.original) for c in r.c or []] for r in df.select("text", term_candidates(F.col("text"), terms).alias("c")).collect()}
    for text in texts:
        assert got[text] == [(m.start(), m[0]) for t in terms for m in re.finditer(re.escape(t), text or "", re.IGNORECASE)]
