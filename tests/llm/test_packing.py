"""Packing and fill-in-the-middle against brute force: every id in one place, no padding, exact texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilframe.llm import fill_middle, packing, units

SPEC = public_tokenizers.path("byte_bpe_50k.json")
SPACES = "ab. \n\t\x1c\x85　é"


def test_units_join_to_the_text():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(SPACES + "    ") for _ in range(rng.randint(0, 12)))
        assert " ".join(units.split_units(text)) == text and units.split_units(text) == units.CUT.split(text)
        for limit in (1, 3):
            assert " ".join(units.segments(text, limit)) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=80))
def test_first_fit_decreasing_by_tree(sizes):
    bins, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((b for b, load in enumerate(bins) if load + sizes[i] <= 64), len(bins))
        if at == len(bins):
            bins.append(0)
        bins[at] += sizes[i]
        want[i] = at
    got = packing.first_fit_decreasing(sizes, 64)
    assert got == [want[i] for i in range(len(sizes))]
    pieces = packing.close_gaps(sizes, got, 64)
    loads = {}
    for item, start, size, b, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == loads.get(b, 0) and size > 0
        loads[b] = offset + size
    assert all(n == 64 or n & (n - 1) == 0 for n in loads.values())
    for i, size in enumerate(sizes):
        own = sorted((s, n) for item, s, n, _, _ in pieces if item == i)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) == size


def odd_texts():
    rng = random.Random(5)
    words = ["Haus", "mañana,", "it's", "x\ny", "<|endoftext|>", "日本", "ﬁn", "12.5", "a" * 50]
    return [None, "", " ", "  a", "a  b \n c", "　 x", "<|endoftext|>", "a<|endoftext|> b", *(" ".join(rng.choice(words) for _ in range(rng.randint(0, 400))) for _ in range(60)), "lang " * 30_000, "z" * 5000]


def test_pieces_hold_every_id_once(spark):
    texts = odd_texts()
    ids = [i % 40 if i % 7 else None for i in range(len(texts))]  # null and repeated ids
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, start int, id string").repartition(3)
    rows = packing.pack_documents(df, SPEC, group_tokens=4000).collect()
    library = Tokenizer.from_file(SPEC)
    want = sorted(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts)
    loads = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == loads.get(r.sequence_id, 0) and len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(r.ids)
        loads[r.sequence_id] = r.offset + r.length
    assert all(n <= 1024 and n & (n - 1) == 0 for n in loads.values())
    assert sum(map(len, want)) == 4 * sum(loads.values()) and len(loads) > 3
    # documents with ids of their own are whole again
    single = {i: t for i, t in zip(ids, texts, strict=True) if i is not None and ids.count(i) == 1}
    for i, t in single.items():
        own = sorted((r.start, bytes(r.ids), r.doc_tokens) for r in rows if r.doc_id == i)
        whole = b"".join(x for _, x, _ in own)
        assert whole == np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert {n for _, _, n in own} == {len(whole) // 4} and [s for s, _, _ in own] == [sum(len(x) // 4 for _, x, _ in own[:k]) for k in range(len(own))]
    assert packing.sequences(packing.pack_documents(df, SPEC)).where("length * 4 <> length(ids)").count() == 0
    assert packing.pack_documents(df.where("false"), SPEC).count() == 0


def test_packing_query(spark, sf_dir):
    from veilframe.llm.queries import QUERIES

    rows = QUERIES["op13_packing"](spark, sf_dir).collect()
    library = Tokenizer.from_file(SPEC)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    own, loads = {}, {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
        loads[r.sequence_id] = loads.get(r.sequence_id, 0) + r.length
    assert set(own) == set(texts) and all(n <= 1024 and n & (n - 1) == 0 for n in loads.values())
    for i, t in texts.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(own[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)


def brute_middle(doc_id, text, seed=42):
    text = text or ""
    parts = re.findall(fill_middle.UNIT, text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(parts) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(parts), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(parts), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(parts), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    rng = random.Random(9)
    texts = [None, "", " ", "\n \t", "a", "<P> x y z", "x <M", "a\x00b \x00", "日本 語\n" * 400, "word " * 200_000, *("".join(rng.choice("ab é🎉\n\t <>") for _ in range(rng.randint(0, 60))) for _ in range(400))]
    ids = [None if i % 11 == 0 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, form string, n int").repartition(3)
    want = sorted((str(i), *map(str, brute_middle(i, t)), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in zip(ids, texts, strict=True))
    rows = fill_middle.fill_in_middle(df).collect()
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in rows)
    assert sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.restored_sha256) for r in rows) == want
    assert {r.form for r in rows} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="percentages"):
        fill_middle.fill_in_middle(df, share=101)
