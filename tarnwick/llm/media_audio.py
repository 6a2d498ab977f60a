"""Audio features: polyphase resampling, overlapped log-mel filterbanks, hysteresis energy segments.

Media are mono 8-bit WAV. A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of FRAME, are the
samples, one byte each, so the stored form is lossless. Reading parses the RIFF chunks again. Features come from the
samples read back: 16 kHz is resampled to 12 kHz by a polyphase FIR filter (3 up, 4 down), cut in overlapped Hann
windows, and passed through a mel filterbank; segments are runs of frames whose energy rises above an upper level until
it falls below a lower one. Frames are pooled to a fixed-shape tensor of SLOTS x MELS with each slot's time span.
`audio_features` makes the media columns: the stored file, the tensor in the storage form of Arrow's fixed-shape tensors (the
column's metadata names the extension type and shape; `fixed_shape` gives the typed array without a copy), and spans in seconds. The
query reads these columns back, and returns the tensor and spans beside its digests.
A signal is worked on in blocks of windows, so memory doesn't grow with its length beyond the signal itself.

Defined results: null and empty text have one block of 576 bytes 255; equal texts give equal values, as every value
depends on the text alone; repeated rows give equal rows; an empty table gives an empty result; further columns of the documents
play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarnwick.llm.common import table

FRAME = 576
RATE, UP, DOWN = 16_000, 3, 4
WINDOW, HOP, MELS, SLOTS = 384, 192, 24, 16
#: Windows transformed at once.
BLOCK = 512


def store(payload: bytes, rate: int = RATE) -> bytes:
    """RIFF WAVE file of 8-bit mono samples; odd data are padded by one byte, as the format asks."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + payload + b"\0" * (n % 2)


def load(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a stored file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def _filter(up: int, down: int, taps: int = 8) -> np.ndarray:
    """Windowed-sinc low pass as up rows of phases."""
    half = taps * max(up, down) // 2
    t = np.arange(-half, half) / max(up, down)
    h = np.sinc(t) * np.hamming(2 * half) * up / max(up, down)
    h = np.append(h, np.zeros(-len(h) % up))
    return h.reshape(-1, up).T.astype(np.float32)


_PHASES = _filter(UP, DOWN)


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP / DOWN: output m uses phase (m * DOWN) % UP only."""
    taps = _PHASES.shape[1]
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(taps, np.float32)])
    n = -(-len(x) * UP // DOWN)
    out = np.zeros(n, np.float32)
    for first in range(UP):
        m = np.arange(first, n, UP)
        if not len(m):
            continue
        phase = (first * DOWN) % UP
        start = first * DOWN // UP  # the inputs of these outputs are DOWN apart
        acc = np.zeros(len(m), np.float32)
        for j in range(taps):
            lo = start + taps - 1 - j
            acc += _PHASES[phase, j] * padded[lo : lo + DOWN * len(m) : DOWN][: len(m)]
        out[m] = acc
    return out


def _mel() -> np.ndarray:
    """Triangular filters, WINDOW // 2 + 1 bins by MELS."""
    top = RATE * UP / DOWN / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(top), MELS + 2) / 2595) - 1)
    f = np.linspace(0, top, WINDOW // 2 + 1)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


_BANK, _HANN = _mel(), np.hanning(WINDOW).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log energies, frame energies) of overlapped windows; the last is filled with zeros."""
    frames = max(1, -(-(len(y) - WINDOW) // HOP) + 1)
    y = np.append(y, np.zeros(max(0, (frames - 1) * HOP + WINDOW - len(y)), np.float32))
    views = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
    out, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for a in range(0, frames, BLOCK):
        w = views[a : a + BLOCK]
        energy[a : a + BLOCK] = np.einsum("ij,ij->i", w, w) / WINDOW
        spectrum = np.fft.rfft(w * _HANN)
        out[a : a + BLOCK] = np.log10((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _BANK + 1e-6)
    return out, energy


def segments(energy: np.ndarray, high: float = 1.15, low: float = 0.85) -> list[tuple[int, int]]:
    """[start, end) frames of runs that begin above high and last until below low, both times the mean energy."""
    mean = float(energy.mean()) + 1e-9
    state = np.where(energy >= high * mean, 1, np.where(energy < low * mean, 0, -1))
    known = np.where(state >= 0, np.arange(len(state)), -1)
    last = np.maximum.accumulate(known)
    on = np.where(last >= 0, state[np.maximum(last, 0)] == 1, False)
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """(SLOTS x MELS tensor, segments in frames, SLOTS x 2 spans in frames) of 8-bit samples."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x))
    edges = np.arange(SLOTS + 1) * len(mel) // SLOTS
    lo, hi = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
    total = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel, axis=0, dtype=np.float64)])
    return ((total[hi] - total[lo]) / (hi - lo)[:, None]).astype(np.float32), segments(energy), np.stack([lo, hi], 1)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\xff" * (FRAME - len(raw) if not raw else -len(raw) % FRAME), len(raw)


def _describe(tensor: np.ndarray, spans: list[tuple[float, float]]) -> str:
    mean = "".join(f"{round(v * 8) & 255:02x}" for v in tensor.mean(0, dtype=np.float64).tolist())
    digest = hashlib.sha256(np.round(tensor * 8).astype("<i2").tobytes() + repr(spans).encode()).hexdigest()[:16]
    return f"mel={mean};segments={len(spans)};voiced={sum(b - a for a, b in spans):.3f};sha={digest}"


#: Seconds from one frame to the next, and steps of a tensor's values.
HOP_SECONDS, STEPS = HOP * DOWN / (RATE * UP), 64
_SPANS = "array<struct<start: double, end: double>>"
_SPAN = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
_EXTENSION = {"ARROW:extension:name": "arrow.fixed_shape_tensor", "ARROW:extension:metadata": json.dumps({"shape": [SLOTS, MELS]})}


def _seconds(spans) -> list[dict[str, float]]:
    return [{"start": round(a * HOP_SECONDS, 6), "end": round(b * HOP_SECONDS, 6)} for a, b in spans]


def _media(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            size, media, tensors, slots, segs = [], [], [], [], []
            for text in part.column("text").to_pylist():
                payload, n = payload_of(text)
                file = store(payload)
                tensor, found, bounds = features(load(file)[0])
                size.append(n)
                media.append(file)
                tensors.append(np.round(tensor.ravel() * STEPS) / np.float32(STEPS))
                slots.append(_seconds(bounds.tolist()))
                segs.append(_seconds(found))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(tensors)), SLOTS * MELS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(media, pa.binary()), flat, pa.array(slots, _SPAN), pa.array(segs, _SPAN)], names=["doc_id", "n_bytes", "media", "tensor", "slot_spans", "segments"])


def audio_features(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, tensor, slot_spans, segments): unpadded bytes, the stored file, SLOTS x MELS values row by row, and spans in seconds."""
    out = docs.select("doc_id", "text").mapInArrow(_media, f"doc_id long, n_bytes long, media binary, tensor array<float>, slot_spans {_SPANS}, segments {_SPANS}")
    return out.withMetadata("tensor", _EXTENSION)


def fixed_shape(column: pa.Array) -> pa.Array:
    """A tensor column as an Arrow fixed-shape tensor array."""
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (SLOTS, MELS)), column.cast(pa.list_(pa.float32(), SLOTS * MELS)))


def _digests(batches):
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        tensors = fixed_shape(batch.column("tensor")).to_numpy_ndarray() if batch.num_rows else ()
        for media, tensor, spans in zip(batch.column("media").to_pylist(), tensors, batch.column("segments").to_pylist(), strict=True):
            back, _ = load(media)
            row = (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), _describe(tensor, [(x["start"], x["end"]) for x in spans]))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *(batch.column(c) for c in ("tensor", "slot_spans", "segments"))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensor", "slot_spans", "segments"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = audio_features(table(spark, sf_dir, "documents"))
    out = media.mapInArrow(_digests, f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensor array<float>, slot_spans {_SPANS}, segments {_SPANS}")
    return out.withMetadata("tensor", _EXTENSION)


ORACLE = None
