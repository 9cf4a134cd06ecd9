"""Media columns: texts' bytes as 8-bit audio, and audio features from the stored form.

A payload is stored as a WAV file: one channel of unsigned 8-bit samples, one sample per byte, so reading it back
gives the payload unchanged. Features are computed from the stored bytes alone:

- polyphase resampling from RATE to RATE * UP / DOWN with a windowed-sinc filter,
- log-mel filterbanks over frames that overlap by half,
- segments by hysteresis of the frames' energy: one begins where the energy passes the upper threshold and ends
  where it falls below the lower one; thresholds follow from the file's own mean and deviation,
- the log-mel matrix as fixed-shape Arrow tensors of FRAMES frames with their time spans, in an Arrow IPC stream.

Long files are worked through in blocks, so memory beyond the file and its features is bounded.

Defined cases: a null text is an empty one; an empty text becomes one unit of padding. Equal texts give equal
values, whatever rows are about them. Empty tables give empty ones. Bytes that are no WAV of this form raise an error. Other columns pass
through; columns named `media`, or `audio` in `features`, are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import by_parts, one_blas_thread

RATE, UP, DOWN, TAPS = 16000, 2, 3, 12
FRAME, HOP, MELS = 256, 128, 20
#: Frames of a tensor, and of a block of work (a multiple of it).
FRAMES, BLOCK_FRAMES = 64, 4096
UNIT, PAD = 576, b"\xff"
HEADER = "<4sI4s4sIHHIIHH4sI"
HEADER_BYTES = struct.calcsize(HEADER)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes padded to a positive multiple of UNIT, and their number before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + PAD * (-len(raw) % UNIT if raw else UNIT), len(raw)


def to_wav(payload: bytes) -> bytes:
    return struct.pack(HEADER, b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file as written by to_wav."""
    head = struct.unpack_from(HEADER, media)
    if head[0] != b"RIFF" or head[2] != b"WAVE" or head[5:7] != (1, 1) or head[10] != 8 or head[12] != len(media) - HEADER_BYTES:
        raise ValueError("not a WAV file of one channel of 8-bit samples")
    return media[HEADER_BYTES :]


def low_pass() -> np.ndarray:
    """The resampling filter by phase: row r holds the taps that make the outputs of phase r."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = np.sinc(t * cut) * np.hanning(n + 2)[1:-1]
    return (h / h.sum() * UP).reshape(TAPS, UP).T.astype(np.float32).copy()


def mel_bank() -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale: one column for each."""
    top = RATE * UP / DOWN / 2
    mel = np.linspace(0, 2595 * np.log10(1 + top / 700), MELS + 2)
    at = (700 * (10 ** (mel / 2595) - 1)) / top * (FRAME // 2)
    k = np.arange(FRAME // 2 + 1)[:, None]
    rise, fall = (k - at[:-2]) / (at[1:-1] - at[:-2]), (at[2:] - k) / (at[2:] - at[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


PHASES, MEL, WINDOW = low_pass(), mel_bank(), np.hanning(FRAME + 1)[:-1].astype(np.float32)


def resampled(samples: np.ndarray, low: int, high: int) -> np.ndarray:
    """Outputs low (a multiple of UP) to high of the resampled signal; beyond the samples there is silence."""
    rows = -(-(high - low) // UP)
    first = low // UP * DOWN - TAPS // 2
    need = rows * DOWN + DOWN + TAPS
    x = np.zeros(need, np.float32)
    a, b = max(first, 0), min(first + need, len(samples))
    if a < b:
        x[a - first : b - first] = (samples[a:b].astype(np.float32) - 128) / 128
    out = np.empty((rows, UP), np.float32)
    for r in range(UP):
        shift, phase = divmod(DOWN * r, UP)
        acc = np.zeros(rows, np.float32)
        for j in range(TAPS):
            acc += PHASES[phase, j] * x[shift + TAPS - 1 - j :: DOWN][:rows]
        out[:, r] = acc
    return out.reshape(-1)[: high - low]


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Frames by MELS."""
    length = -(-len(samples) * UP // DOWN)
    n = 1 + max(0, -(-(length - FRAME) // HOP))
    out = np.empty((n, MELS), np.float32)
    for f in range(0, n, BLOCK_FRAMES):
        g = min(n, f + BLOCK_FRAMES)
        y = resampled(samples, f * HOP, (g - 1) * HOP + FRAME)
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * WINDOW
        frames -= frames.mean(1, keepdims=True)
        spectrum = np.fft.rfft(frames, axis=1)
        out[f:g] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ MEL + 1e-6)
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of the stretches of high energy, by hysteresis."""
    mean, spread = float(energy.mean()), float(energy.std())
    marks = np.zeros(len(energy), np.int8)
    marks[energy > mean + 0.5 * spread] = 1
    marks[energy < mean - 0.25 * spread] = -1
    at = np.flatnonzero(marks)
    on = np.zeros(len(energy), bool)
    if at.size:
        last = np.maximum.accumulate(np.where(marks != 0, np.arange(len(marks)), -1))
        on = (last >= 0) & (marks[last] == 1)
    edges = np.flatnonzero(np.diff(np.r_[False, on, False]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow IPC stream of (start_s, end_s, n_frames, log_mel) rows: tensors of FRAMES by MELS, the last one padded."""
    n = -(-len(mel) // FRAMES)
    full = np.zeros((n * FRAMES, MELS), np.float32)
    full[: len(mel)] = mel
    step = HOP * DOWN / UP / RATE
    starts = np.arange(n) * FRAMES
    ends = np.minimum(starts + FRAMES, len(mel))
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, FRAMES, MELS))
    batch = pa.RecordBatch.from_arrays([pa.array(starts * step), pa.array((ends - 1) * step + FRAME * DOWN / UP / RATE), pa.array(ends - starts), column], names=["start_s", "end_s", "n_frames", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def analysed(media: bytes) -> tuple:
    """payload bytes, its sha256, the crc32 of its last 32 bytes, the file's sha256, tensors, segments, summary."""
    payload = from_wav(media)
    mel = log_mel(np.frombuffer(payload, np.uint8))
    step = HOP * DOWN / UP / RATE
    found = [{"start_s": a * step, "end_s": b * step} for a, b in segments(mel.mean(1))]
    means = ",".join(f"{x:.2f}" for x in (np.round(mel.mean(0), 2) + 0.0).tolist())
    summary = f"frames={len(mel)};segments={len(found)};active_s={sum(s['end_s'] - s['start_s'] for s in found):.3f};mel={means}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(media).hexdigest(), tensors(mel), found, summary


def store(docs: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """docs with `out`: a struct of the WAV file `data` and `n_bytes`, the text's bytes before padding."""

    def written(part: pd.Series) -> pd.DataFrame:
        made = [payload_of(t) for t in part]
        return pd.DataFrame({"data": [to_wav(p) for p, _ in made], "n_bytes": [n for _, n in made]})

    @F.pandas_udf("data binary, n_bytes long")
    def wav(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from by_parts(written)(texts)

    return docs.withColumn(out, wav(F.col(text_col)))


def features(docs: DataFrame, media_col: str = "media.data", out: str = "audio") -> DataFrame:
    """docs with `out`: payload_bytes, payload_sha256, tail_crc32, media_sha256, tensors (an Arrow stream), segments
    (time spans) and a summary, all from the stored file."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, tensors binary, segments array<struct<start_s double, end_s double>>, summary string")
    def analyse(files: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "tensors", "segments", "summary"]
        with one_blas_thread():
            yield from by_parts(lambda part: pd.DataFrame([analysed(f) for f in part], columns=names))(files)

    return docs.withColumn(out, analyse(F.col(media_col)))
