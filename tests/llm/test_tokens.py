"""Token counts and BPE against the public libraries, edits against re-encoding."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilframe.llm import bpe, common, count_transducer as ct

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPEC = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "ab'sreveldtm  \n\t 1²é<|>endoftext日🎉\x00!?ABC"


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe.PrefixEncoder(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sample_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    return [*texts, None, "", "'", "x'r", "''ll", " ", "a  ", "<|endoftext|>", "a<|endoftext|>  <|endoftext|>b", "a" * 3000, "don't we'll  \n\n x " * 300, " " * 500, "word " * 100_000]


def test_queries_equal_libraries(spark, library):
    texts = sample_texts()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, id int").repartition(3)
    rows = {r.doc_id: r for r in bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        assert (rows[i].n_tokens, rows[i].ids_sha256, bytes(rows[i].ids)) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), ids)
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    want = [len(e.ids) for e in Tokenizer.from_file(SPEC).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {r.doc_id: r for r in ct.count_tokens(df, SPEC).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want[i] > 512) for i, t in enumerate(texts))


def test_empty_table_and_odd_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ct.count_tokens(empty, SPEC).count() == 0 and bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in ct.count_tokens(df, SPEC).collect()) == [0, 1, 1]


@settings(max_examples=60, deadline=None)
@given(st.text("abcdefgh THE.", max_size=40), st.text("abTH e", max_size=12), st.integers(0, 40), st.integers(0, 10))
def test_edits(encoder, text, new, at, length):
    data, new = text.encode(), new.encode()
    editable = bpe.EditableEncoding(encoder, data)
    editable.append(new)
    assert editable.ids() == encoder.encode_piece(data + new)
    editable.replace(min(at, len(data)), min(at + length, len(data)), new)
    assert editable.ids() == encoder.encode_piece(editable.data) == [encoder.ranks[t] for t in bpe.merge(encoder.ranks, editable.data)]


def test_edit_far_from_the_end(encoder):
    data = b"thequickbrownfox" * 40
    editable = bpe.EditableEncoding(encoder, data)
    editable.replace(10, 12, b"zz")
    assert editable.ids() == encoder.encode_piece(data[:10] + b"zz" + data[12:])
    assert bpe.decode_ids(encoder, bpe.pack(editable.ids())) == editable.data


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 11), max_size=60), st.integers(1, 7))
def test_scan_equals_one_pass(classes, chunk):
    classes = np.array([*classes, ct.SEP], np.uint8)
    assert (ct.piece_starts(classes, chunk=chunk) == ct.piece_starts(classes, chunk=len(classes))).all()
    maps = np.stack([ct.TO[:, c] for c in classes])
    now = np.arange(12)
    for row, c in zip(ct.compose_scan(maps), classes, strict=True):
        now = ct.TO[now, c]
        assert (row == now).all()


def test_long_texts_are_counted_in_blocks(monkeypatch):
    with open(SPEC, "rb") as f:
        counter = ct.TokenCounter(f.read())
    texts = [t or "" for t in sample_texts()][-12:] + ["x" * 900 + " y", "don't  \n" * 200, "a<|endoftext|>" * 90]
    whole = [counter.counts([t])[0] for t in texts]
    monkeypatch.setattr(ct, "BLOCK", 64)
    assert [counter.counts([t])[0] for t in texts if len(t) < 100_000] == [n for t, n in zip(texts, whole, strict=True) if len(t) < 100_000]


def test_unsupported_tokenizers_are_refused():
    with open(SPEC, encoding="utf-8") as f:
        spec = f.read()
    assert '"add_prefix_space":false' in spec.replace(" ", "").replace("\n", "")
    changed = json.loads(spec)
    changed["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError, match="prefix space"):
        ct.TokenCounter(json.dumps(changed).encode())


def test_memo_keeps_recent_entries():
    calls = []
    memo = common.Memo(lambda x: calls.append(x) or -x, 3)
    for x in (1, 2, 3, 1, 4, 1, 5, 2):
        assert memo[x] == -x
    assert calls == [1, 2, 3, 4, 5]
    for x in range(100):
        assert memo[x] == -x and len(memo) <= 3


def test_few_states_count_alike(monkeypatch, library):
    """A machine that may have few states counts what one with many does."""
    with open(SPEC, "rb") as f:
        counter = ct.TokenCounter(f.read())
    monkeypatch.setattr(ct, "STATE_LIMIT", 3)
    rng = random.Random(8)
    for text in ["don't", "internationalisation", "x" * 300, *("".join(rng.choice("abcdefgh'é日") for _ in range(rng.randint(1, 40))) for _ in range(100))]:
        assert sum(counter.machine.count(p.encode()) for p in regex.findall(public_tokenizers.PATTERN, text)) == len(library.encode_ordinary(text))
        assert len(counter.machine.states) <= 3


def test_merges_must_reach_every_token():
    spec = json.loads(open(SPEC, encoding="utf-8").read())
    letters = ct.byte_letters()
    spec["model"]["vocab"] = {letters[b]: b for b in range(256)}
    spec["model"]["merges"] = ["b c", "a b", "ab c"]
    with pytest.raises(ValueError, match="every token"):
        ct.TokenCounter(json.dumps(spec).encode())
