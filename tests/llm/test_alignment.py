"""Alignment of two tokenizers against loops over tokens."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veilframe.llm import alignment, unit_tokens
from veilframe.llm.count_transducer import byte_letters

SPEC, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Rows of whole texts by the libraries alone, and the pairs' counts."""
    a_side, b_side = Tokenizer.from_file(SPEC), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a_side.encode_special_tokens = True
    plain = {c: b for b, c in byte_letters().items()}
    pieces = alignment.piece_bytes(b_side)
    out, pairs = [], Counter()
    for text in texts:
        goal = (" " + (text or "")).encode()
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [bytes(plain[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [pieces[i] for i in b]
        if not text or b"".join(a_bytes) != goal or b"".join(b_bytes) != goal:
            out.append((0, 0, 0, [], ""))
            continue
        i = j = at_a = at_b = 0
        links, groups, group = [], [], ([], [])
        fresh_a = fresh_b = True
        end_a, end_b = len(a_bytes[0]), len(b_bytes[0])
        while i < len(a):
            links.append((a[i], b[j]))
            if fresh_a:
                group[0].append(a[i])
            if fresh_b:
                group[1].append(b[j])
            fresh_a, fresh_b = end_a <= end_b, end_b <= end_a
            if fresh_a and fresh_b:
                groups.append(",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1])))
                group = ([], [])
            if fresh_a:
                i += 1
                end_a_next = end_a + len(a_bytes[i]) if i < len(a) else end_a
            if fresh_b:
                j += 1
                end_b = end_b + len(b_bytes[j]) if j < len(b) else end_b
            if fresh_a:
                end_a = end_a_next
        pairs.update(links)
        out.append((len(a), len(b), len(groups), links, ";".join(groups)))
    most = {}
    for (_, b), n in pairs.items():
        most[b] = max(most.get(b, 0), n)
    rows = [(na, nb, ng, len(links), sum(pairs[x] == most[x[1]] for x in links), sum(pairs[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for na, nb, ng, links, g in out]
    return rows, pairs, most


def odd_texts():
    rng = random.Random(3)
    words = ["Haus", "maison,", "it's", "x\ny", "<|endoftext|>", "<s>", "<0x41>", "日本語", "ﬁn", "12.5", "🎉", "a" * 40, "▁", "the"]
    plain = [w for w in words if w != "▁"]
    return [None, "", " ", "  a", "a  b \n c ", "　 x", "a▁b", "▁", "\x00 x", "é́ x", *(" ".join(rng.choice(plain) for _ in range(rng.randint(0, 200))) for _ in range(80)), " ".join(rng.choice(words) for _ in range(50))]


@pytest.mark.parametrize("small_parts", [False, True])
def test_alignment_equals_loops(spark, monkeypatch, small_parts):
    texts = odd_texts() * 2
    if small_parts:  # texts cut into segments, memory forgotten, counts handed on early, stripes in parts
        for module, name, value in ((alignment, "SEGMENT", 300), (alignment, "UNITS", 30), (alignment, "PAIRS", 200), (alignment, "ENTRIES", 7), (alignment, "PART", 1000), (alignment, "DOCS", 3)):
            monkeypatch.setattr(module, name, value)
        import veilframe.llm.units as units

        monkeypatch.setattr(alignment, "segments", lambda text: units.segments(text, 300))
        # the functions run here: what is patched is not seen by other processes
        aligner = alignment.Aligner(open(SPEC, "rb").read(), open(MODEL, "rb").read(), 5)
        import pyarrow as pa

        task, batches, number = alignment.TaskLinks(aligner, pa.int64(), True), [], 0
        for text in texts:
            ids = pa.array([number], pa.int64())
            batches += task.block(ids, [text], number) if len(text or "") <= 300 else task.long_document(ids, text, number)
            number += 1
        batches += task.counts()
        rows = [r for b in batches for r in b.to_pylist()]
        want, pairs, _ = brute(texts)
        docs = {r["doc_no"]: r for r in rows if r["stripe"] is None}
        assert [(docs[i]["n_a"], docs[i]["n_b"], docs[i]["n_groups"], docs[i]["n_links"], docs[i]["groups_sha256"]) for i in range(len(texts))] == [(*w[:4], w[6]) for w in want]
        got = Counter()
        import numpy as np

        for r in rows:
            if r["stripe"] is not None and r["docs"] is None:
                key = np.frombuffer(r["keys"], "<u4").astype(int)
                for k, n in zip(key.tolist(), alignment.read_small(r["times"], len(key)).tolist(), strict=True):
                    got[(k % aligner.width, k // aligner.width * 5 + r["stripe"])] += n
        assert got == pairs
        return
    df = spark.createDataFrame([(None if i % 9 == 0 else i // 2, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, stripe string, n_a int").repartition(3)
    want, pairs, most = brute([r.text for r in df.collect()])
    ids = [r.doc_id for r in df.collect()]
    made = alignment.Alignment(df, SPEC, MODEL, stripes=7, keep_groups=True)
    rows = made.report().collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows), key=key) == sorted(((i, *w) for i, w in zip(ids, want, strict=True)), key=key)
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in rows)
    assert {(r.b, r.a, r["count"]) for r in made.best_partners().collect()} == {(b, a, n) for (a, b), n in pairs.items() if n == most[b]}
    assert alignment.align_tokenizers(df.where("false"), SPEC, MODEL).count() == 0


def test_unit_tokens_equal_library():
    model = unit_tokens.ByteLevel(open(SPEC, "rb").read(), special=False)
    library = Tokenizer.from_file(SPEC)
    library.encode_special_tokens = True
    for text in odd_texts():
        assert model.encode(text or "") == library.encode(text or "", add_special_tokens=False).ids


def test_alignment_query(spark, sf_dir):
    from veilframe.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want, _, _ = brute(list(texts.values()))
    rows = {r.doc_id: r for r in QUERIES["op11_alignment"](spark, sf_dir).collect()}
    for i, w in zip(texts, want, strict=True):
        r = rows[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w
