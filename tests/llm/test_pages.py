"""WARC records, URL filters and media columns."""

import datetime
import gzip
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veilframe.llm import common, media, url_filter, warc

BIG = "é" * 200_000
PAGES = [(1, "http://a/", BIG), (7, "http://b/\r\nX: y", BIG), (3, None, BIG), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", None), (None, "u", BIG), (8, "u", ""), (7, "http://b/", BIG), (9, "u", "WARC/1.1\r\n\r\n\r\n\r\n"), (10, "u", "y" * 1000), (11, "u", "y" * 1000)]


def test_warc_report(spark):
    df = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    last = {}
    for page, _, html in PAGES:
        if page is not None and len((html or "").encode()) >= 1000:
            last[html] = max(page, last.get(html, -1))
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        refers = last.get(html)
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), *(("revisit", refers) if refers is not None and refers != page else ("response", None))))
    assert sorted(map(tuple, warc.archive_report(df).collect()), key=str) == sorted(want, key=str)
    assert warc.archive_report(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["string", "smallint", "date"])
def test_warc_ids_are_kept(spark, kind):
    ids = {"string": [" b", "a\n1 ", "%0A", "é", None], "smallint": [3, -2, None], "date": [datetime.date(2020, 1, 2), None]}[kind]
    df = spark.createDataFrame([(i, f"http://x/ {n} ", "same " * 300) for n, i in enumerate(ids)], f"page_id {kind}, url string, html string")
    out = warc.archive_report(df)
    assert out.schema["page_id"].dataType == df.schema["page_id"].dataType == out.schema["refers_to"].dataType
    rows = {r.page_id: r for r in out.collect()}
    best = max(i for i in ids if i is not None)
    assert set(rows) == set(ids) and {r.refers_to for i, r in rows.items() if i != best} == {best} and rows[best].record_type == "response"


def test_written_chunks_carry_running_digests(spark):
    df = spark.createDataFrame([(5, "u", BIG), (6, "u", None)], "page_id long, url string, html string").coalesce(1)
    rows = sorted(warc.payload_chunks(df, "page_id", "url", "html", 1000).collect(), key=lambda r: (r.page_id, r.chunk_no))
    so_far, n = hashlib.sha1(), 0
    for r in rows[:-1]:
        part = zlib.decompress(r.data)
        so_far.update(part)
        n += len(part)
        assert (r.bytes_so_far, r.sha1_so_far) == (n, so_far.hexdigest()) and len(part) <= 1000
    assert n == len(BIG.encode()) == rows[0].payload_bytes and rows[-2].sha1_so_far == rows[0].digest
    assert (rows[-1].page_id, rows[-1].bytes_so_far, rows[-1].sha1_so_far) == (6, 0, hashlib.sha1().hexdigest())


def test_warc_chunks(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:2], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(df, f"file://{tmp_path}/w", chunk=50_000)
    rows = warc.read_chunks(manifest, f"file://{tmp_path}/w", chunk=30_000).orderBy("page_id", "chunk_no").collect()
    data = b"".join(r.data for r in rows if r.page_id == 7)
    assert data.decode() == BIG and max(len(r.data) for r in rows) == 30_000
    so_far = hashlib.sha1()
    for r in (r for r in rows if r.page_id == 7):
        so_far.update(r.data)
        assert r.sha1_so_far == so_far.hexdigest()
    assert [r.record_type for r in rows if r.page_id == 1] == ["revisit"] and not [p for p in tmp_path.rglob("*.tmp")]
    plain = gzip.decompress(next(tmp_path.rglob("*.warc.gz")).read_bytes())
    assert plain.count(b"WARC/1.1\r\n") == 2 and plain.endswith(b"\r\n\r\n") and b"\r\nX: y" not in plain


def test_damaged_archives():
    record = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n")
    with pytest.raises(ValueError):
        list(warc.read_records(iter([record])))
    assert list(warc.read_records(iter([]))) == []


def brute_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else default


def test_url_filter(spark):
    rng = random.Random(1)
    urls = [None, "", "no scheme", "http://NET/", "http://net", "http://.net/", "https://a.example.NET/en/x?q#f", "http://example.net/en", "http://example.net/?/en/", "x://sub.example.com/de/#a", "http://a.org/fr/y", "http://xnet/", "http://a.b.c.example.org/fr/", "http://é.net/a://b", "http://example.com:80/de/"]
    urls += ["http://" + ".".join(rng.choice(["a", "example", "net", "com", "org"]) for _ in range(rng.randint(1, 5))) + rng.choice(["", "/", "/en/", "/de/x", "/fr/", "?x", "/e"]) for _ in range(300)]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(3)
    for r in url_filter.filter_urls(df).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(urls[r.page_id], url_filter.RULES), urls[r.page_id]
    plan = url_filter.filter_urls(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SortMergeJoin" not in plan
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_rules_of_many_shapes(spark):
    """Some hundred lengths of paths and numbers of labels: the plan does not grow with them."""
    rng = random.Random(12)
    rules = [url_filter.Rule(rng.choice(["allow", "block"]), ".".join(rng.choice("ab") for _ in range(n % 7 + 1)), "/" + "x" * (n // 2)) for n in range(400)]
    rules = tuple(sorted({r.key: r for r in reversed(rules)}.values(), key=lambda r: r.key))
    urls = ["http://" + ".".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) + "/" + "x" * rng.randint(0, 210) + rng.choice(["", "/y", "?x"]) for _ in range(200)] + [None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for r in url_filter.filter_urls(df, rules).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(urls[r.page_id], rules), urls[r.page_id]
    assert {r.verdict for r in url_filter.filter_urls(df, ()).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.where("cast(substring(key, 2) as int) % 7 = 0")
    cascade = url_filter.build_cascade(spark, listed, universe, bits_per_key=2)
    assert len(cascade.levels) > 2
    wrong = universe.select("key", cascade.contains(F.col("key")).alias("c")).where("c <> (cast(substring(key, 2) as int) % 7 = 0)")
    assert wrong.count() == 0


def test_media_report(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "hello world " * 5000, "hello world " * 5000]
    df = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, media binary").repartition(3)
    rows = {r.doc_id: r for r in media.text_media_report(df).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.to_wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and bytes(media.from_wav(stored)[1]) == payload
    assert tuple(rows[5])[1:] == tuple(rows[6])[1:] and rows[0].feature == rows[1].feature
    assert media.text_media_report(df.limit(0)).count() == 0


def test_blocks_equal_one_piece(monkeypatch):
    samples = memoryview(np.random.default_rng(2).integers(0, 256, 100_000, np.uint8).tobytes())
    whole = np.concatenate(list(media.Features().blocks(samples)))
    monkeypatch.setattr(media, "BLOCK", 64)
    parts = list(media.Features().blocks(samples))
    assert len(parts) > 5 and np.allclose(np.concatenate(parts)[: len(whole)], whole, atol=1e-3) and sum(map(len, parts)) == len(whole)


def test_features_equal_plain_sums():
    """Resampling, spectrum, bands and segments against their definitions."""
    rng = np.random.default_rng(7)
    samples = np.clip(128 + rng.standard_normal(3000) * np.repeat([2, 60, 10, 1, 50], 600), 0, 255).astype(np.uint8)
    features = media.Features()
    x = samples.astype(float) / 128 - 1
    taps = media.polyphase_filters()[:, ::-1].T.ravel()
    up = np.zeros(len(x) * media.UP)
    up[:: media.UP] = x
    low = [sum(taps[k] * up[n * media.DOWN - k] for k in range(len(taps)) if n * media.DOWN >= k) for n in range(len(x) * media.UP // media.DOWN)]
    n = -(-(len(low) - media.FRAME + media.HOP) // media.HOP)
    low = np.concatenate((low, np.zeros(n * media.HOP + media.FRAME - len(low))))
    wave = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
    power = np.stack([np.abs(wave @ (low[i * media.HOP :][: media.FRAME] * np.hanning(media.FRAME))) ** 2 / media.FRAME for i in range(n)])
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 4000 / 700), media.MELS + 2) / 2595) - 1)
    bands = np.zeros((n, media.MELS))
    for b in range(media.MELS):
        for k in range(media.FRAME // 2 + 1):
            hz = k * 8000 / media.FRAME
            rise, fall = (hz - edges[b]) / (edges[b + 1] - edges[b]), (edges[b + 2] - hz) / (edges[b + 2] - edges[b + 1])
            bands[:, b] += power[:, k] * max(0, min(rise, fall))
    got = np.concatenate(list(features.blocks(memoryview(samples.tobytes()))))
    assert np.allclose(got, 10 * np.log10(bands + 1e-10), atol=0.02)
    energy, on, runs = media.frame_energy(got), False, []
    for i, e in enumerate(energy):
        was, on = on, e >= media.UPPER or (on and e >= media.LOWER)
        if on and not was:
            runs.append([i, i])
        if on:
            runs[-1][1] = i + 1
    assert features.segments(energy) == list(map(tuple, runs)) and len(runs) > 1


def test_stored_tensors_and_features(spark, tmp_path):
    rng = np.random.default_rng(3)
    level = np.repeat(rng.choice([1, 8, 60], 40), 1000)
    samples = np.clip(128 + rng.standard_normal(len(level)) * level, 0, 255).astype(np.uint8).tobytes()
    stored = spark.createDataFrame([(4, 1, 2, media.to_wav(samples)), (5, 1, 2, media.to_wav(bytes(64)))], "uid long, id long, n_bytes long, media binary").coalesce(1)
    recordings = media.store_features(stored, f"file://{tmp_path}/t")
    table = pq.read_table(str(tmp_path / "t" / recordings.first().file))
    assert table.schema.field("tensor").type == media.TENSOR and table.column("window_no").to_pylist()[-1] == 0
    features = media.Features()
    whole = np.concatenate(list(features.blocks(memoryview(samples))))
    tensors = np.concatenate([c.to_numpy_ndarray() for c in table.column("tensor").chunks])[:-1].reshape(-1, media.MELS)
    assert np.abs(tensors[: len(whole)] - np.maximum(whole, media.FLOOR)).max() <= 0.5 / media.STEPS + 1e-4 and (tensors[len(whole) :] == media.FLOOR).all()
    segments = features.segments(media.frame_energy(whole))
    means = tensors[: len(whole)].astype(float).reshape(len(whole), 8, -1).mean(axis=(0, 2))
    found = dict(map(tuple, media.summaries(recordings, f"file://{tmp_path}/t").collect()))
    parts = dict(p.split("=") for p in found[4].split(";"))
    assert int(parts["frames"]) == len(whole) and int(parts["segments"]) == len(segments) > 1
    assert abs(float(parts["active"]) - sum(b - a for a, b in segments) / len(whole)) < 6e-4
    assert np.allclose([float(x) for x in parts["mel"].split(",")], means, atol=0.06)


def test_resampling_keeps_a_tone():
    n = np.arange(6000)
    out = media.resample(np.sin(2 * np.pi * 440 * n / 12000).astype(np.float32), media.polyphase_filters())
    spectrum = np.abs(np.fft.rfft(out[1000:3000] * np.hanning(2000)))
    assert len(out) == 4000 and abs(spectrum.argmax() * 8000 / 2000 - 440) <= 4 and 0.9 < np.abs(out[1000:3000]).max() < 1.1


def test_windows_are_tensors(spark):
    loud = (np.sin(np.arange(24_000) / 3) * 120 + 128).astype(np.uint8).tobytes()
    df = spark.createDataFrame([(1, media.to_wav(bytes([128]) * 12_000 + loud)), (2, None)], "id long, m binary")
    rows = media.window_features(df, "id", "m").orderBy("window_no").collect()
    assert {len(r.tensor) for r in rows} == {media.FRAMES * media.MELS} and {r.id for r in rows} == {1}
    assert rows[0].start_s == 0 and all(a.end_s == b.start_s for a, b in zip(rows, rows[1:], strict=False))
    assert not rows[0].active and rows[-1].active
    tensors = media.as_tensors(pa.array([r.tensor for r in rows], pa.list_(pa.float32())))
    assert tensors.type.shape == [media.FRAMES, media.MELS] and len(tensors) == len(rows)


def test_window_spans_are_segments_of_the_whole(spark):
    rng = np.random.default_rng(2)
    # loudness changes slowly, so that segments last over window and block borders
    level = np.interp(np.arange(900_000), np.arange(0, 900_001, 9_000), rng.choice([0.5, 2, 6, 15, 60], 101))
    samples = np.clip(128 + rng.standard_normal(900_000) * level, 0, 255).astype(np.uint8).tobytes()
    rows = media.window_features(spark.createDataFrame([(1, media.to_wav(samples))], "id long, m binary"), "id", "m").orderBy("window_no").collect()
    features = media.Features()
    whole = np.concatenate(list(features.blocks(memoryview(samples))))
    step, joined = media.HOP / features.rate, []
    for a, b in ((round(s.start_s / step), round(s.end_s / step)) for r in rows for s in r.active):
        if joined and joined[-1][1] == a:
            a = joined.pop()[0]
        joined.append((a, b))
    expected = features.segments(media.frame_energy(whole))
    assert len(whole) > media.BLOCK and expected and joined == expected
    assert len(rows) == -(-len(whole) // media.FRAMES) and all(round((r.end_s - r.start_s) / step) == media.FRAMES for r in rows[:-1])


def test_long_urls_and_rows_of_one_record(spark, tmp_path, monkeypatch):
    """A header is as long as its url; rows of one id and payload are split, and each is read back."""
    url = "https://example.org/" + "x" * (3 << 20)
    rows = [(1, url, "p" * 2000), (2, None, "p" * 2000), (3, "https://a.b/", url)] + [(None, "https://c.d/", "q" * 1500)] * 40 + [(7, "https://e.f/", "r" * 1200)] * 30
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write_archives(pages, folder)
    read = warc.read_chunks(manifest, folder).where("last").collect()
    assert len(read) == len(rows) and {r.url for r in read if r.page_id == 1} == {url}
    assert {(r.page_id, r.record_type, r.refers_to) for r in read} == {(1, "revisit", 2), (2, "response", None), (3, "response", None), (None, "response", None), (7, "response", None)}
    with pytest.raises(ValueError, match="within its header"):
        list(warc.read_records(iter([gzip.compress(b"WARC/1.1\r\nWARC-Type: response")])))


def test_lists_of_any_size(spark):
    urls = [(i, f"https://h{i % 50}.example.{'net' if i % 2 else 'org'}/p{i % 7}/x") for i in range(300)] + [(None, None), (5, "no url")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    rules = tuple(url_filter.Rule.parse("block" if k % 3 else "allow", f"h{k}.example.net/p{k % 7}") for k in range(0, 60, 2)) + (url_filter.Rule.parse("block", "net/"),)
    want = sorted(map(str, url_filter.filter_urls(df, rules).collect()))
    assert sorted(map(str, url_filter.filter_urls(df, rules, limit=64).collect())) == want
    assert url_filter.level_bits(10, 10**12) >= 6 * 10 * (10**11) ** (1 / 6) and url_filter.level_bits(1, 0) == 1024
