"""Language ID, substring and SimHash de-duplication, decontamination, personal data and the pipeline."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilframe.llm import common, decontaminate, graph, jaccard, langid, pii, simhash, superkmer

SPACE = r"[^\x20\x09-\x0D]+"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- language ID


def test_language_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    train = [(i, "the cat sat on that mat with them", "en", 0) for i in range(40)] + [(100 + i, "der hund und die katze sind nicht hier", "de", 0) for i in range(40)]
    odd = [(900, None, None, 1), (901, "", "en", 1), (902, "12 34 !!", None, 1), (None, "the cat", None, 1), (903, "the cat sat on that mat " * 30 + "der hund und die katze " * 10, None, 1), (903, "und die katze", None, 1)]
    df = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, score int")
    got = {(r.doc_id, r.lang_pred): r.score for r in langid.identify(df).where("doc_id is null or doc_id >= 900").collect()}
    assert got[(900, "und")] == got[(901, "und")] == got[(902, "und")] == 0
    assert got[(None, "en")] == 1 and got[(903, "de")] == 1 and 0.6 < got[(903, "en")] < 0.9
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_texts_do_not_disturb_each_other():
    model = langid.Model.of({"a": np.bincount(langid.trigram_bins(["xyx yxy xxy"])[0], minlength=langid.BINS), "b": np.bincount(langid.trigram_bins(["pqp qpq ppq"])[0], minlength=langid.BINS)})
    texts = ["xyx\nyxy", "", "pqp qpq", "1\n2", "xxy pqp pqp"]
    together = model.predict(texts)
    assert together == tuple(map(list, zip(*((n[0], s[0]) for n, s in (model.predict([t]) for t in texts)), strict=True)))


def brute_mixture(logs, words, penalty=2.0):
    """The method in plain loops: EM over all languages, then sets that grow while the gain beats the penalty."""

    def em(share, rounds):
        for _ in range(rounds):
            total = [0.0] * len(share)
            for w in words:
                odds = [math.exp(x - max(w)) * p for x, p in zip(w, share, strict=True)]
                for k, o in enumerate(odds):
                    total[k] += o / sum(odds)
            share = [t / len(words) for t in total]
        return share, sum(math.log(sum(math.exp(x - max(w)) * p for x, p in zip(w, share, strict=True))) + max(w) for w in words)

    n = len(words[0])
    full, _ = em([1 / n] * n, 10)
    order = sorted(range(n), key=lambda k: -full[k])
    chosen, value = [float(k == order[0]) for k in range(n)], sum(w[order[0]] for w in words)
    for size in range(2, n + 1):
        guess = [full[k] + 1e-3 if k in order[:size] else 0.0 for k in range(n)]
        share, likelihood = em([g / sum(guess) for g in guess], 5)
        if likelihood - value <= penalty * 0.5 * math.log(len(words) + 1):
            break
        chosen, value = share, likelihood
    return chosen


def test_mixtures_equal_plain_loops(spark, sf_dir):
    rows = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect() if r.text and r.lang]
    counts = {}
    for r in rows[:120]:
        counts.setdefault(r.lang, np.zeros(langid.BINS, np.int64))
        counts[r.lang] += np.bincount(langid.trigram_bins([r.text])[0], minlength=langid.BINS)
    model = langid.Model.of(counts)
    texts = [r.text[:600] for r in rows[100:130]] + [" ".join(rows[i].text[: 100 * (1 + i % 4)] for i in pick) for pick in ((0, 50, 90), (3, 60), (7, 70, 110, 20), (5, 66, 77))]
    names, scores = model.predict(texts)
    mixed = 0
    for text, name, score in zip(texts, names, scores, strict=True):
        bins, first, _ = langid.trigram_bins([text])
        words = [model.logs[part].astype(float).sum(axis=0).tolist() for part in np.split(bins, first[1:])]
        share = brute_mixture(model.logs, words)
        assert name == model.languages[max(range(len(share)), key=share.__getitem__)] and abs(score - max(share)) < 1e-3
        mixed += sum(s > 0 for s in share) > 1
    assert mixed


def test_many_languages_share_fewer_bins(spark, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_CELLS", 5 * 4096)
    rows = [(i, f"{'abcde'[i % 5]}{'xyzuv'[i % 5]}o " * 20, f"l{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.fit(df).logs) == 4096
    assert {(r.doc_id, r.lang_pred) for r in langid.identify(df).collect()} == {(i, lang) for i, _, lang in rows}


# --- substring de-duplication


def brute_repeats(rows, k=13):
    words = [(10**18 if d is None else d, re.findall(SPACE, t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            least[key] = min(least.get(key, 10**19), d)
    out = []
    for (doc, _), (d, w) in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if least[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        out.append((doc, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(spark):
    rng = random.Random(5)
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(rng.choice([None, *range(9)]), None if rng.random() < 0.05 else " ".join("ab"[rng.random() < 0.5] if rng.random() < 0.03 else "x" for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    rows += [(20 + i, f"own{i} start  {passage}\nend{i} " + passage * (i % 2)) for i in range(20)] + [(50, ""), (51, " \t"), (20, rows[-1][1]), (20, rows[-1][1])]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, key int").repartition(5)
    assert rows_of(superkmer.remove_repeats(df)) == brute_repeats(rows)
    assert superkmer.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["string", "int"])
def test_repeats_with_other_ids(spark, kind):
    base = " ".join(f"w{i}" for i in range(30))
    ids = ["b", "a", "ab", None] if kind == "string" else [2, 1, 3, None]
    rows = [(i, f"{base} own{n}") for n, i in enumerate(ids)]
    out = superkmer.remove_repeats(spark.createDataFrame(rows, f"doc_id {kind}, text string"), keep_text=True)
    assert out.schema["doc_id"].dataType.simpleString() == kind
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in out.collect()}
    least = min(i for i in ids if i is not None)
    assert got == {i: (0, t) if i == least else (30, t.split()[-1]) for i, t in rows}


def test_hot_minimisers_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdef") if rng.random() < 0.2 else "hot" for _ in range(50))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(superkmer, "SAMPLE", 1)
    assert superkmer.hot_minimisers(df, "doc_id", "text", 13, 2, 128)
    assert rows_of(superkmer.remove_repeats(df)) == brute_repeats(rows)


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(superkmer, "mix", lambda v: v * np.uint64(0))
    rows = [(b"a b c", 5, [(1, 0)]), (b"a b d", 3, [(1, 7)]), (b"a b c", 4, [(2, 9)])]
    docs, tags, starts = superkmer.judge([superkmer.pack_rows(rows)], window=3)
    assert (docs.tolist(), tags.tolist(), starts.tolist()) == ([5], [1], [0])


# --- SimHash


def brute_fingerprint(text):
    words = re.findall(SPACE, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", "A", "a B", "a b C", "a b c d", "Ä É a\tb\nc\x0bd\xa0e", "x " * 500):
        assert simhash.fingerprint(text) == brute_fingerprint(text), text
    assert simhash.fingerprint("a b c") != simhash.fingerprint("a")


def test_links_are_complete(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, np.uint64)
    fps = list(base)
    for b in base[:25]:
        for _ in range(6):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            fps.append(b ^ np.uint64(sum(1 << int(f) for f in flips)))
    fps = sorted({int(f) for f in fps})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(u & (1 << 64) - 1, v & (1 << 64) - 1) for u, v in simhash.links_between(df).collect()]
    assert all((u ^ v).bit_count() <= 3 for u, v in edges)

    def classes(pairs):
        parent = {f: f for f in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in pairs:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
        return [root(f) for f in fps]

    assert classes(edges) == classes((a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3)


def test_large_groups_are_looked_up(monkeypatch):
    rng = np.random.default_rng(4)
    fps = np.unique(np.array([int(b) ^ sum(1 << int(f) for f in rng.choice(64, 3, replace=False)) for b in rng.integers(0, 2**63, 4, np.uint64) for _ in range(40)], np.uint64))
    keys, owners = simhash.index_entries(fps)

    def sets():
        links = simhash.Links()
        simhash.link_bucket(keys, owners, links)
        assert all((a ^ b).bit_count() <= 3 for a, b in links.made)
        return [links.root(int(f)) for f in fps]

    compared = sets()
    monkeypatch.setattr(simhash, "LARGE", 1)
    assert sets() == compared and len(set(compared)) < len(compared)


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (200, 201)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == 200
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, text), (3, text.upper()), (9, text + " "), (4, "something else entirely"), (7, None), (8, ""), (None, text), (4, "something else entirely")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.group(df).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (4, 4), (7, 7), (8, 7), (None, 3)}
    assert sorted(str(r.doc_id) for r in simhash.keep_one(df).collect()) == ["3", "4", "4", "7", "None"]
    assert simhash.group(df.limit(0)).count() == 0


# --- near-duplicates by Jaccard similarity


def brute_kept(rows, k=5):
    sets = []
    for _, t in rows:
        w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                part = [part[j] if p == part[i] else p for p in part]
    least = {}
    for (d, _), p in zip(rows, part, strict=True):
        least[p] = min(least.get(p, 10**18), 10**18 if d is None else d)
    return sorted(None if v == 10**18 else v for v in least.values())


def test_near_duplicates_are_those_of_jaccard(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for i in range(30):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice((12, 60, 150)))] + ["common"] * 8
        for j in range(8):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
            rows.append((1000 * j + i, " ".join(words) + " the same last line of all of these texts"))
    rows += [(90_000, None), (90_001, " "), (90_002, "a B"), (90_003, "A b")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(t, d, "x") for d, t in rows], "text string, doc_id long, uid string").repartition(4)
    # also with every group cut into parts of about three sets, and hubs of each that find next to nothing
    for frequent, part, hubs in ((1, 1 << 16, 8), (10**6, 1 << 16, 8), (1, 3, 8), (1, 3, 1)):
        monkeypatch.setattr(jaccard, "SAMPLE", 1)
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        monkeypatch.setattr(jaccard, "PART", part)
        monkeypatch.setattr(jaccard, "HUBS", hubs)
        out = jaccard.keep_one(df)
        assert sorted(r.doc_id for r in out.collect()) == brute_kept(rows) and out.columns == df.columns
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) != brute_kept(rows)
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_sketches_keep_all_similar_pairs():
    rng = np.random.default_rng(4)
    ruled_out = 0
    for _ in range(400):
        n, m = rng.integers(0, 400, 2)
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.concatenate((a[: max(0, len(a) - rng.integers(0, 60))], rng.integers(0, 2**64, m // rng.integers(1, 40), np.uint64))))
        may = jaccard.may_be_similar(jaccard.sketch(a), jaccard.sketch(b), len(a) + len(b))
        assert may or not jaccard.similar(a, b)
        ruled_out += not may
    assert ruled_out > 100


def test_pipeline_leaves_no_similar_documents(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[:at], f"x{i}", *words[at + 1 :]])) for i, at in enumerate((10, 50, 90))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "bpe"]
    docs = dict(pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert [r.doc_id for r in docs.collect()] == brute_kept(rows) == [0]


def test_fingerprints_propose_and_similarity_judges(spark, monkeypatch):
    """With and without the index, and with the prefix filter alone: the classes are those of brute force."""
    rng = random.Random(19)
    rows = []
    for i in range(25):
        base = [f"v{rng.randint(0, 4000)}" for _ in range(rng.choice((30, 120)))]
        for j in range(6):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = f"y{rng.randint(0, 10**6)}"
            rows.append((100 * j + i, " ".join(words)))
    rows += [(7000, None), (7001, " "), (None, rows[0][1]), (7002, rows[0][1])]
    df = spark.createDataFrame([(t, d, 1) for d, t in rows], "text string, doc_id long, fp int").repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_similar(df).collect()) == brute_kept(rows)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert sorted(r.doc_id for r in simhash.keep_similar(df).collect()) == brute_kept(rows)
    assert simhash.keep_similar(df.limit(0)).count() == 0


def test_hot_keys_are_split(spark, monkeypatch):
    """A hub, a giant component and very many copies, with every frequent key split over tasks."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 130)] + [(59, 130), (500, 501)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in [*range(60), *range(100, 131)]} | {500: 500, 501: 500}
    rows = [(i, "one and the same text") for i in range(40)] + [(None, "one and the same text"), (50, "another text of its own"), (50, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.group(df).collect()} == {(d, 0 if t and "same" in t else 50) for d, t in rows}


def test_simhash_judges_rows_not_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    df = spark.createDataFrame([(4, a), (4, b), (2, b), (None, "c")], "doc_id long, text string")
    assert rows_of(simhash.keep_one(df)) == [(2, b), (4, a), (None, "c")]


def test_rows_are_judged_not_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    df = spark.createDataFrame([(4, a), (4, b), (2, b), (2, b), (None, b), (None, a + " end")], "doc_id long, text string")
    assert rows_of(jaccard.keep_one(df)) == [(2, b), (4, a)]


# --- decontamination

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_contamination(text, items):
    def words(t):
        return re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    own, found, hit = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            window = w[i : i + 10]
            for at in range(len(own) - len(window) + 1):
                if own[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    if item is not None:
                        found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))) for i in range(9)] + [(10, None), (None, "z é Z"), (2, "q r s"), (11, "Über-Größe 7"), (12, "!!")]
    texts = [" ".join(rng.choice("ABCabc") for _ in range(rng.randint(0, 80))) for _ in range(60)] + [None, "", "z, É? z é z!", "xx q r s q r s", "über größe 7", "ÜBER Größe 7"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.find_contamination(df, bench, spans=True).collect():
        assert tuple(r)[1:6] == brute_contamination(texts[r.doc_id], items), texts[r.doc_id]
        assert sum(len(re.findall(WORD, texts[r.doc_id][s.start : s.end].lower())) for s in r.hit_spans) == r.n_hit
    assert {r.n_hit for r in decontaminate.find_contamination(df, bench.limit(0)).collect()} == {0}


@pytest.mark.parametrize("nodes", [1, 150, 10**6])
def test_benchmark_blocks_are_united(spark, nodes):
    rng = random.Random(18)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(8)] + [(8, None), (None, "q r")]
    texts = [" ".join(rng.choice("abcq") for _ in range(rng.randint(0, 200))) for _ in range(30)] + [None, "", "q r s"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert (len(list(decontaminate.item_blocks(bench, "item_id", "text", 10, nodes))) == 1) == (nodes > 1000)
    if nodes == 1:  # a pass for every block: a few items are enough
        items = [(i, t and " ".join(t.split()[:11])) for i, t in items[:2] + items[8:]]
        bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, b"x", "y") for i, t in enumerate(texts)], "doc_id long, text string, h binary, o string").repartition(2)
    for r in decontaminate.find_contamination(df, bench, spans=True, keep=("h", "o"), nodes=nodes).collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_contamination(texts[r.doc_id], items) and (bytes(r.h), r.o) == (b"x", "y")
        assert sum(len(re.findall(WORD, texts[r.doc_id][s.start : s.end].lower())) for s in r.hit_spans) == r.n_hit


# --- personal data


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(d := re.sub("[^0-9]", "", x)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(re.sub("[^0-9]", "", x)) <= 15),
)


def test_personal_data(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1.@+-_%( )25é\x01 0\n日") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["".join(rng.choice("a1.@-_") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["4111 1111 1111 1111, 4111-1111-1111-1112, +1 (555) 123-4567", "a@b.c " * 700, "a@" + "b." * 5000 + "c", "1 " * 9000, "1" * 3000, None, "", "000.0001.255.9 256.1.1.1"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(4)
    for r in pii.report(df).collect():
        spans = sorted((m.start(), i, m.end(), k) for i, (k, rx, ok) in enumerate(KINDS) for m in re.finditer(rx, texts[r.doc_id] or "") if ok(m.group()))
        listed = [f"{k}:{a}:{b}" for a, _, b, k in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), (texts[r.doc_id] or "")[:100]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in dict((k[0], 1) for k in KINDS)] == listed


def test_added_kinds_scores_and_masks(spark):
    rows = [(1, "Konto GB82 WEST 1234 5698 7654 32 und GB82 WEST 1234 5698 7654 33, call (555) 123-4567", 3), (2, None, 0), (3, "card 4111111111111111 / 4111111111111111", 1), (None, "+1 (555) 123-4567", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found long")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    phone = rows[0][1].index("(555)")
    assert got[1].spans == f"iban:6:33,local_phone:{phone}:{phone + 14}" and got[1].top_score == 1.0 and got[2].top_score is None
    masked = {r.doc_id: r for r in pii.mask(df).collect()}
    assert masked[1].text == "Konto [IBAN] und GB82 WEST 1234 5698 7654 33, call [LOCAL_PHONE]" and masked[1].found == 3
    assert masked[2].text is None and masked[3].text == "card [CARD] / [CARD]" and masked[None].text == "[PHONE]"
    assert pii.report(df.limit(0)).count() == 0
    odd = df.withColumn("__none", F.lit(True)).withColumn("t", F.lit(1)).withColumn("k0", F.lit("x"))
    assert [(r["__none"], r.t, r.k0) for r in pii.mask(odd).collect()] == [(True, 1, "x")] * 4 and pii.mask(odd).columns == odd.columns


# --- pipeline


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "123", "en", "s", 3)], docs.schema)
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs = docs.unionByName(extra)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        kept = {r.doc_id: r.text for r in stage(spark, docs, sf_dir).collect()}
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        gone = set(texts) - set(kept)
        if name == "language_id":
            assert gone == {10**6, 10**6 + 1}
        if name == "near_duplicates":
            assert sorted(kept) == brute_kept(sorted(texts.items()))
        if name == "decontamination":
            assert gone == {i for i, t in texts.items() if brute_contamination(t, bench)[4]}
        if name == "personal_data":
            assert not gone and all(not re.search(KINDS[0][1], t or "") for t in kept.values())
        texts, docs = kept, pipeline.common.materialize(out, name)
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(texts)


def test_decontamination_of_odd_tables(spark):
    """Null and repeated ids, repeated rows, short items, an empty table: every row is judged by itself."""
    words = [f"w{i}" for i in range(30)]
    items = spark.createDataFrame([(None, " ".join(words[:10])), (2, " ".join(words[5:25])), (2, " ".join(words[20:30])), (3, "Two WORDS"), (4, None), (5, " .,; ")], "item_id long, text string")
    texts = [(None, " ".join(words[:12])), (None, " ".join(words[:12])), (1, " ".join(words)), (1, " ".join(words)), (1, "x two words, w1 w2"), (2, None), (3, ""), (4, "two xx words"), (5, ("a " * 50_000) + " ".join(words[5:15]) + " b" * 50_000)]
    rows = decontaminate.find_contamination(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows)
    assert got == sorted([("None", 12, 10, 0, True)] * 2 + [("1", 30, 30, 1, True)] * 2 + [("1", 5, 2, 1, True), ("2", 0, 0, 0, False), ("3", 0, 0, 0, False), ("4", 3, 0, 0, False), ("5", 100_010, 10, 1, True)])
    assert decontaminate.find_contamination(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0
