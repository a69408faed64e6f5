"""Audio columns: lossless 8-bit samples and features of fixed shape.

A waveform is resampled by a polyphase filter (``UP`` output samples for every ``DOWN`` input samples), cut into
overlapping frames, turned into log-mel energies and segmented by energy with hysteresis: a segment begins above
the upper threshold and lasts until the energy falls below the lower one.

Frames are gathered into tensors of ``FRAMES`` x ``MELS`` with their time spans, in steps of 1/8 dB, and stored as
fixed-shape Arrow tensors in Parquet files (``store_features``).  A recording is processed in blocks of fixed length from its start, so equal recordings have equal
features whatever else is in the batch, and memory does not grow with a recording.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, shared_path

#: Samples a second of the stored form, and the resampling ratio: 12 kHz to 8 kHz.
RATE, UP, DOWN = 12_000, 2, 3
TAPS = 12
#: Samples of a frame, of its hop, bands and frames of a tensor.
FRAME, HOP, MELS, FRAMES = 256, 128, 32, 32
#: Frames processed at once, a multiple of FRAMES.
BLOCK = 4096
#: Energy (dB of full scale) that begins a segment, and that ends it.
UPPER, LOWER = -18.0, -24.0
UNIT = 64
#: Steps of a decibel in stored tensors, and what frames that are not there hold.
STEPS, FLOOR = 8, -100.0
#: Windows written at once.
WRITTEN = 512
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    """Bytes 0 appended up to a positive multiple of ``unit``."""
    return payload + bytes(-len(payload) % unit or (0 if payload else unit))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """One channel of unsigned 8-bit samples; the payload's length must be even."""
    n = len(payload)
    return HEADER.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload


def from_wav(media: bytes) -> tuple[int, memoryview]:
    """Rate and samples; chunks other than ``fmt`` and ``data`` are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("only one channel of 8-bit samples is supported")
        elif name == b"data":
            return rate, memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def polyphase_filters(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """A windowed-sinc low-pass filter, split into ``up`` phases of ``taps`` coefficients."""
    n = up * taps
    t = (np.arange(n) - (n - 1) / 2) / max(up, down)
    h = np.sinc(t) * np.hamming(n)
    return (h / h.sum() * up).reshape(taps, up).T[:, ::-1].astype(np.float32).copy()


def resample(x: np.ndarray, filters: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """``len(x) * up // down`` samples.  Output n is phase ``n * down % up`` over the inputs up to ``n * down // up``."""
    n, taps = len(x) * up // down, filters.shape[1]
    padded = np.concatenate((np.zeros(taps - 1, np.float32), x, np.zeros(1, np.float32)))
    spans = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):
        phase, at = first * down % up, first * down // up
        number = -(-(n - first) // up)
        out[first::up] = spans[at : at + (number - 1) * down + 1 : down] @ filters[phase]
    return out


def mel_filters(rate: int, bands: int = MELS, size: int = FRAME) -> np.ndarray:
    """Triangles, evenly spaced on the mel scale, over the spectrum's bins."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    bins = np.arange(size // 2 + 1) * rate / size
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def frame_energy(block: np.ndarray) -> np.ndarray:
    """The mean power of the frames' bands, in dB."""
    return np.log10((10 ** (block / 10)).mean(axis=1)) * 10


class Features:
    """Log-mel frames and segments of 8-bit recordings."""

    def __init__(self, rate: int = RATE):
        self.rate = rate * UP // DOWN
        self.filters, self.mel, self.window = polyphase_filters(), mel_filters(self.rate), np.hanning(FRAME).astype(np.float32)

    def blocks(self, samples: memoryview) -> Iterator[np.ndarray]:
        """Log-mel energies (frames x bands), at most ``BLOCK`` frames at a time; the last frame is padded."""
        outputs = BLOCK * HOP
        inputs = outputs * DOWN // UP
        keep, before, rest = np.zeros(0, np.float32), np.zeros(0, np.uint8), np.frombuffer(samples, np.uint8)
        for at in range(0, max(1, len(rest)), inputs):
            part = rest[at : at + inputs]
            warm = len(before) // DOWN * DOWN
            x = np.concatenate((before[len(before) - warm :], part)).astype(np.float32) / 128 - 1
            y = np.concatenate((keep, resample(x, self.filters)[warm * UP // DOWN :]))
            before = part[-TAPS * DOWN :]
            last = at + inputs >= len(rest)
            n = max(1, -(-max(0, len(y) - FRAME + HOP) // HOP)) if last else (len(y) - FRAME) // HOP + 1
            if last:
                y = np.concatenate((y, np.zeros(max(0, (n - 1) * HOP + FRAME - len(y)), np.float32)))
            frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[: (n - 1) * HOP + 1 : HOP] * self.window
            spectrum = np.fft.rfft(frames, axis=1)
            power = (spectrum.real**2 + spectrum.imag**2) / FRAME
            yield np.log10(power @ self.mel + 1e-10) * 10
            keep = y[n * HOP :]

    def segments(self, energy: np.ndarray, on: bool = False) -> list[tuple[int, int]]:
        """Runs of frames that begin above ``UPPER`` and last while not below ``LOWER``; ``on`` if one lasts from before."""
        state = np.where(energy >= UPPER, 1, np.where(energy < LOWER, -1, 0))
        known = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
        active = np.where(known >= 0, state[np.maximum(known, 0)] == 1, on)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], active, [False])).astype(np.int8)))
        return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))




def store_text_as_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: each text's UTF-8 bytes, padded, as the samples of a WAVE file.  Null: empty."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array([to_wav(pad(t)) for t in texts], pa.binary())})

    return map_arrow(df.select(df[id_col].alias("id"), df[text_col].alias("t")), store, f"id {df.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def windows(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The blocks' frames, ``FRAMES`` at a time; only the last window may be shorter."""
    rest = np.zeros((0, MELS), np.float32)
    for block in blocks:
        rest = np.concatenate((rest, block))
        whole = len(rest) // FRAMES * FRAMES
        yield from (rest[at : at + FRAMES] for at in range(0, whole, FRAMES))
        rest = rest[whole:]
    if len(rest):
        yield rest


@dataclass(frozen=True)
class Window:
    number: int
    start_s: float
    end_s: float
    frames: int
    tensor: np.ndarray
    #: spans of segments in seconds; ``continues`` if the first began in the window before
    active: list[dict[str, float]]
    continues: bool


def windows_of(features: Features, samples: memoryview) -> Iterator[Window]:
    """A recording's windows; hysteresis goes on over their borders."""
    step, on = HOP / features.rate, False
    for number, part in enumerate(windows(features.blocks(samples))):
        first, n = number * FRAMES, len(part)
        found = features.segments(frame_energy(part), on)
        continues = on and bool(found) and found[0][0] == 0
        on = bool(found) and found[-1][1] == n
        tensor = np.full((FRAMES, MELS), FLOOR, np.float32)
        tensor[:n] = np.maximum(np.round(part * STEPS) / STEPS, FLOOR)
        yield Window(number, first * step, (first + n) * step, n, tensor, [{"start_s": (first + a) * step, "end_s": (first + b) * step} for a, b in found], continues)


SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
TENSOR = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
STORED = pa.schema([("uid", pa.int64()), ("window_no", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("tensor", TENSOR), ("active", SPANS), ("continues", pa.bool_())])


def window_features(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row for every ``FRAMES`` frames: the id, ``window_no``, ``start_s``, ``end_s``, ``tensor`` (``FRAMES * MELS`` floats by
    frame, the last window padded with the floor) and ``active`` (spans in seconds).  A null recording has no rows."""
    kind = df.schema[id_col].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, media in zip(batch.column(0), batch.column(1), strict=True):
                if not media.is_valid:
                    continue
                rate, samples = from_wav(media.as_py())
                for w in windows_of(Features(rate), samples):
                    columns = {"window_no": pa.array([w.number], pa.int64()), "start_s": pa.array([w.start_s]), "end_s": pa.array([w.end_s])}
                    columns |= {"tensor": pa.array([w.tensor.ravel()], pa.list_(pa.float32())), "active": pa.array([w.active], SPANS)}
                    yield pa.RecordBatch.from_pydict({"id": pa.array([id_.as_py()], batch.column(0).type)} | columns)

    schema = f"id {kind}, window_no long, start_s double, end_s double, tensor array<float>, active array<struct<start_s:double,end_s:double>>"
    return map_arrow(df.select(df[id_col].alias("id"), df[media_col].alias("m")), extract, schema).withColumnRenamed("id", id_col)


class TensorFile:
    """A task's Parquet file of windows, written a bounded number at a time under a name of its own."""

    def __init__(self, folder: str):
        self.store, root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(root, recursive=True)
        task = TaskContext.get()
        self.name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.parquet"
        self.path, self.rows, self.writer = f"{root}/{self.name}", [], None

    def add(self, uid: int, window: Window) -> None:
        self.rows.append((uid, window))
        if len(self.rows) >= WRITTEN:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.writer = self.writer or pq.ParquetWriter(self.path, STORED, compression="zstd", filesystem=self.store)
            found = [w for _, w in self.rows]
            columns = [pa.array([uid for uid, _ in self.rows], pa.int64())]
            columns += [pa.array([getattr(w, name) for w in found], STORED.field(column).type) for name, column in (("number", "window_no"), ("start_s", "start_s"), ("end_s", "end_s"), ("frames", "frames"))]
            columns += [pa.FixedShapeTensorArray.from_numpy_ndarray(np.stack([w.tensor for w in found])), pa.array([w.active for w in found], SPANS), pa.array([w.continues for w in found], pa.bool_())]
            self.writer.write_table(pa.Table.from_arrays(columns, schema=STORED), row_group_size=WRITTEN * 32)
            self.rows = []

    def close(self) -> None:
        self.flush()
        if self.writer:
            self.writer.close()


def store_features(stored: DataFrame, folder: str) -> DataFrame:
    """Read the recordings of ``stored(uid, id, n_bytes, media)`` back and write their tensors and spans to ``folder``.

    Returns a table with a row per recording: ``uid``, ``id``, ``n_bytes``, sizes and digests of what was read, and the name of
    the file that holds its windows.  Only files that it names are of use: others are of attempts that were lost.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, known = TensorFile(folder), {}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "file")}
            for uid, value in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                media = memoryview(value.as_buffer())
                rate, samples = from_wav(media)
                out["payload_bytes"].append(len(samples))
                out["payload_sha256"].append(hashlib.sha256(samples).hexdigest())
                out["tail_crc32"].append(zlib.crc32(samples[-UNIT:]))
                out["media_bytes"].append(len(media))
                out["media_sha256"].append(hashlib.sha256(media).hexdigest())
                out["file"].append(file.name)
                if rate not in known:
                    known[rate] = Features(rate)
                for window in windows_of(known[rate], samples):
                    file.add(uid, window)
            kinds = {k: pa.int64() if k in ("payload_bytes", "tail_crc32", "media_bytes") else pa.string() for k in out}
            yield pa.RecordBatch.from_pydict(dict(zip(("uid", "id", "n_bytes"), batch.columns[:3], strict=True)) | {k: pa.array(v, kinds[k]) for k, v in out.items()})
        file.close()

    kind = stored.schema["id"].dataType.simpleString()
    schema = f"uid long, id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, file string"
    return materialize(map_arrow(stored.select("uid", "id", "n_bytes", "media"), describe, schema), "recordings")


def summaries(recordings: DataFrame, folder: str, rate: int = RATE) -> DataFrame:
    """``(uid, feature)`` from the stored tensors and spans: frames, mean energy of eight band groups (dB), number of segments
    and their share of frames.  All sums are of integers, so equal recordings have equal features."""
    spark, step = recordings.sparkSession, HOP / (rate * UP // DOWN)
    files = [f"{folder}/{r.file}" for r in recordings.select("file").distinct().collect()]  # one for each task that wrote
    schema = "uid long, frames int, tensor array<float>, active array<struct<start_s:double,end_s:double>>, continues boolean"
    windows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    bands = [f"b{i}" for i in range(8)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            frames = batch.column(1).to_numpy().astype(np.int64)
            tensors = batch.column(2).flatten().to_numpy().reshape(n, FRAMES, MELS)
            there = np.arange(FRAMES)[None, :] < frames[:, None]
            sums = (np.round(tensors * STEPS).astype(np.int64) * there[:, :, None]).sum(axis=1).reshape(n, 8, MELS // 8).sum(axis=2)
            spans = batch.column(3).to_pylist()
            segments = np.array([len(s) for s in spans], np.int64) - batch.column(4).to_numpy(zero_copy_only=False)
            active = np.array([sum(round((x["end_s"] - x["start_s"]) / step) for x in s) for s in spans], np.int64)
            uid = batch.column(0).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], uid[1:] != uid[:-1])))
            both = np.add.reduceat(np.concatenate((frames[:, None], segments[:, None], active[:, None], sums), axis=1), first, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(uid[first]), *(pa.array(c) for c in both.T.copy())], ["uid", "n", "segments", "active", *bands])

    parts = map_arrow(windows.select("uid", "frames", "tensor", "active", "continues"), add, ", ".join(f"{c} long" for c in ("uid", "n", "segments", "active", *bands)))
    whole = parts.groupBy("uid").agg(*(F.sum(c).alias(c) for c in ("n", "segments", "active", *bands)))
    means = [F.col(b) / (F.col("n") * (STEPS * MELS // 8)) for b in bands]
    shape = "frames=%d;mel=" + ",".join(["%.1f"] * 8) + ";segments=%d;active=%.3f"
    return whole.select("uid", F.format_string(shape, "n", *means, "segments", F.col("active") / F.col("n")).alias("feature"))


def as_tensors(column: pa.Array) -> pa.Array:
    """The ``tensor`` column as Arrow fixed-shape tensors."""
    flat = pa.FixedSizeListArray.from_arrays(column.flatten(), FRAMES * MELS)
    return pa.ExtensionArray.from_storage(TENSOR, flat)


def text_media_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as a recording, read the stored bytes back and describe them.

    One row per input row: the id column, ``n_bytes``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` (of the last 64
    samples), ``media_bytes``, ``media_sha256``, ``feature``.  Media, and the tensors that features are read from, are tables
    in the shared folder.

    Null and empty texts are recordings of 64 zeros.  Null or repeated ids pass through; further columns are ignored, so
    their names cannot clash.  An empty table gives an empty table.
    """
    folder = shared_path(df.sparkSession, "tensors")
    stored = materialize(store_text_as_media(df, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "media")
    recordings = store_features(stored, folder)
    joined = recordings.join(summaries(recordings, folder), "uid")
    return joined.select(F.col("id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
