"""Audio features of media columns: polyphase resampling, log-mel filterbanks and hysteresis energy segmentation.

A medium is a WAV file of unsigned 8-bit mono samples at RATE.  Samples are resampled by UP/DOWN with one windowed-sinc
sub-filter per phase, framed with overlap, turned into log-mel energies, and segmented: sound starts where a frame's
energy passes the upper threshold and ends where it falls below the lower one.  Features are stored as fixed-shape
tensors (FRAMES x MELS floats, zero-padded at the end) with their time spans.

Defined cases: a null or empty text is a payload of 192 spaces; texts of any length are processed whole, a block of frames at a
time; null doc_ids and repeated rows are kept; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctframe.llm import _io, _text

UNIT = 192
RATE, UP, DOWN, TAPS = 16_000, 2, 3, 12
OUT_RATE = RATE * UP / DOWN
WIN, HOP, MELS, FRAMES = 256, 128, 24, 64
#: Samples of a phase, or frames, that are worked on at once.
BLOCK = 4096
#: Where sound starts and ends, as shares of the range of a medium's frame energies.
START, END = 0.6, 0.4


def sub_filters() -> np.ndarray:
    """(UP, TAPS): the low-pass filter's taps that make outputs of each phase."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = np.sinc(n * cut) * cut * np.hamming(UP * TAPS)
    h = h.reshape(TAPS, UP).T[:, ::-1]
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


def mel_bank() -> np.ndarray:
    """(WIN/2+1, MELS) triangular filters, evenly spaced in mel."""
    hz = np.linspace(0, OUT_RATE / 2, WIN // 2 + 1)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    up = (hz[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - hz[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


PHASES, BANK, WINDOW = sub_filters(), mel_bank(), np.hanning(WIN).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + (n & 1), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)
    return head + payload + b"\0" * (n & 1)


def from_wav(media: memoryview) -> memoryview:
    """The samples of a medium, found by its chunks."""
    at = 12
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP/DOWN times its rate."""
    n = len(x) * UP // DOWN
    padded = np.concatenate((np.full(TAPS, x[0], np.float32), x, np.full(TAPS + DOWN, x[-1], np.float32)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n, np.float32)
    for first in range(UP):
        for a in range(first, n, UP * BLOCK):
            m = np.arange(a, min(n, a + UP * BLOCK), UP)
            out[m] = windows[m * DOWN // UP + TAPS // 2] @ PHASES[(first * DOWN) % UP]
    return out


def log_mel(x: np.ndarray) -> np.ndarray:
    """(frames, MELS) log energies of overlapping windows; at least one frame."""
    if len(x) < WIN:
        x = np.concatenate((x, np.zeros(WIN - len(x), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(x, WIN)[::HOP]
    out = np.empty((len(frames), MELS), np.float32)
    for a in range(0, len(frames), BLOCK):
        spectrum = np.fft.rfft(frames[a : a + BLOCK] * WINDOW, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[a : a + BLOCK] = np.log10(power @ BANK + 1e-6)
    return out


def segments(energy: np.ndarray) -> np.ndarray:
    """(n, 2) frame ranges of sound, by hysteresis between two thresholds of the medium's own range."""
    low, high = float(energy.min()), float(energy.max())
    if high - low < 1e-6:
        return np.zeros((0, 2), np.int64)
    start, end = low + START * (high - low), low + END * (high - low)
    state = np.where(energy >= start, 1, np.where(energy < end, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(known >= 0, state[np.maximum(known, 0)], 0) == 1
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


def features(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel frames, segments) of 8-bit samples."""
    mel = log_mel(resample((samples.astype(np.float32) - 128) / 128))
    return mel, segments(mel.mean(axis=1))


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offs in _text.text_slices(batches):
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
        media = [to_wav(t + b" " * (max(UNIT, -(-len(t) // UNIT) * UNIT) - len(t))) for t in texts]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media: the WAV file that holds the text, padded to a multiple of UNIT."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_media, "doc_id long, n_bytes long, media binary")


TENSOR = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])


def tensor_array(values: pa.Array) -> pa.Array:
    """A column of flat lists of FRAMES * MELS floats as Arrow's fixed-shape tensors."""
    return pa.ExtensionArray.from_storage(TENSOR, values.cast(TENSOR.storage_type))


#: Floats that are gathered before a batch of rows is handed on.
GATHERED = 1 << 20
STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("blocks", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("tensor", pa.list_(pa.float32())), ("sound_s", pa.list_(pa.list_(pa.float64())))])))])
STORED_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, blocks array<struct<start_s: double, end_s: double, tensor: array<float>, sound_s: array<array<double>>>>"


def _blocks(mel: np.ndarray, sound: np.ndarray) -> tuple[list, list, np.ndarray, list]:
    """(start_s, end_s, tensors, sound_s) of the blocks of FRAMES frames."""
    cuts = range(0, len(mel), FRAMES)
    tensor = np.zeros((len(cuts), FRAMES, MELS), np.float32)
    tensor.reshape(-1, MELS)[: len(mel)] = mel
    spans = [[] for _ in cuts]
    for a, b in sound.tolist():
        for k in range(a // FRAMES, (b - 1) // FRAMES + 1):
            spans[k].append([float(max(a, k * FRAMES)) * HOP / OUT_RATE, float(min(b, (k + 1) * FRAMES)) * HOP / OUT_RATE])
    return [c * HOP / OUT_RATE for c in cuts], [(min(c + FRAMES, len(mel)) - 1) * HOP / OUT_RATE + WIN / OUT_RATE for c in cuts], tensor, spans


def _analysed_batch(rows: list, blocks: list) -> pa.RecordBatch:
    starts, ends, tensor, spans = (list(x) for x in zip(*blocks, strict=True))
    flat = np.concatenate([t.reshape(-1) for t in tensor])
    n = np.cumsum([0, *map(len, starts)])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n[-1] + 1) * (FRAMES * MELS), pa.int32()), pa.array(flat))
    each = pa.StructArray.from_arrays([pa.array(sum(starts, [])), pa.array(sum(ends, [])), lists, pa.array(sum(spans, []), pa.list_(pa.list_(pa.float64())))], names=["start_s", "end_s", "tensor", "sound_s"])
    cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), STORED, strict=False)]
    return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(n, pa.int32()), each)], names=STORED.names)


def _analysed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, blocks, held = [], [], 0
    for batch in batches:
        for doc_id, n, medium in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
            raw = memoryview(medium.as_buffer())
            payload = from_wav(raw)
            rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest()))
            blocks.append(_blocks(*features(np.frombuffer(payload, np.uint8))))
            held += blocks[-1][2].size
            if held >= GATHERED:
                yield _analysed_batch(rows, blocks)
                rows, blocks, held = [], [], 0
    if rows:
        yield _analysed_batch(rows, blocks)


def analysed(media: DataFrame) -> DataFrame:
    """One row per medium: doc_id, digests of the text and the medium, and blocks: of each FRAMES frames the time span, the flat
    FRAMES x MELS tensor, and the spans of sound in it."""
    return media.mapInArrow(_analysed, STORED_DDL)


def tensors(media: DataFrame) -> DataFrame:
    """One row per FRAMES frames: doc_id, block, time span, the flat FRAMES x MELS tensor, and the spans of sound in it."""
    each = analysed(media).select("doc_id", F.posexplode("blocks").alias("block", "b"))
    return each.select("doc_id", F.col("block").cast("long").alias("block"), "b.start_s", "b.end_s", "b.tensor", "b.sound_s")


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The feature text of each row of analysed(), from its tensors and spans alone."""
    frame = lambda t: round(t * OUT_RATE / HOP)
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column("blocks")
        each = col.flatten()
        tensor = each.field("tensor").flatten().to_numpy(zero_copy_only=False).reshape(-1, MELS)
        ends, spans = each.field("end_s").to_numpy(), each.field("sound_s").to_pylist()
        at, out = 0, []
        for n in np.diff(col.offsets.to_numpy()).tolist():
            frames = frame(ends[at + n - 1] - WIN / OUT_RATE) + 1
            mean = ",".join(f"{v:.2f}" for v in tensor[at * FRAMES : at * FRAMES + frames].mean(axis=0, dtype=np.float64))
            sound, length, last = 0, 0, -1
            for x in spans[at : at + n]:
                for a, b in x:
                    sound += frame(a) != last  # what goes on over a block's border is one sound
                    length, last = length + frame(b) - frame(a), frame(b)
            out.append(f"frames={frames};sound={sound};sound_frames={length};mel={mean}")
            at += n
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in STORED.names[:-1]), pa.array(out, pa.string())], names=[*STORED.names[:-1], "feature"])


def digests(found: DataFrame) -> DataFrame:
    """doc_id, digests and feature of the rows of analysed()."""
    return found.mapInArrow(_summary, STORED_DDL[: STORED_DDL.index("blocks")] + "feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = _io.stored(to_media(_io.table(spark, sf_dir, "documents")), "media")
    found = _io.stored(analysed(media), "tensors")
    _io.drop_stored(media)
    return digests(found)
