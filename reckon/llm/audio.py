"""Media columns: audio features of 8-bit sound.

A payload is stored as the samples of an 8-bit PCM WAV file and read back. Features: a polyphase
resampler (one windowed-sinc branch for each output phase), overlapped log-mel frames, and segments by
energy with hysteresis (they open above one level, close below a lower one). Frames are kept as an
Arrow IPC stream of fixed-shape tensors (``frames x mels``), each row with its time span.
"""

from __future__ import annotations

import io
import wave
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, text_rows

RATE, TARGET, WINDOW, HOP, FFT, MELS = 16_000, 10_000, 250, 100, 256, 24
#: Frames in one tensor, and tensors computed at once (bounds the memory of a long text).
FRAMES, CHUNK = 50, 40
OPEN_DB, CLOSE_DB, TAPS = 3.0, -3.0, 8


def payload(data: bytes, block: int = 64) -> bytes:
    """The bytes and zeros up to a positive multiple of the block."""
    return data + bytes(-len(data) % block or (0 if data else block))


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframesraw(samples)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


class Resampler:
    """x[n] at ``rate`` to ``target``; output k sits at input time k*rate/target. Zeros beyond the ends."""

    def __init__(self, rate: int = RATE, target: int = TARGET, taps: int = TAPS):
        g = gcd(rate, target)
        self.up, self.down = target // g, rate // g
        cut = min(1.0, self.up / self.down)
        self.half = int(np.ceil(taps / cut))
        first = [p * self.down // self.up for p in range(self.up)]
        self.width = first[-1] + 2 * self.half
        self.bank = np.zeros((self.width, self.up), np.float32)
        for p, f in enumerate(first):  # phase p of each block of `up` outputs
            t = np.arange(f - self.half + 1, f + self.half + 1) - p * self.down / self.up
            h = cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / self.half, -1, 1)))
            self.bank[f : f + 2 * self.half, p] = h / h.sum()

    def __call__(self, x: np.ndarray) -> np.ndarray:
        n = -(-len(x) * self.up // self.down)
        blocks = -(-n // self.up)
        padded = np.zeros(max(blocks * self.down + self.width, self.half + len(x)), np.float32)
        padded[self.half - 1 : self.half - 1 + len(x)] = x
        out = np.empty((blocks, self.up), np.float32)
        view = np.lib.stride_tricks.sliding_window_view(padded, self.width)[:: self.down]
        for at in range(0, blocks, 1 << 15):
            out[at : at + (1 << 15)] = view[at : min(at + (1 << 15), blocks)] @ self.bank
        return out.reshape(-1)[:n]


def mel_filters(rate: int = TARGET, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, (fft/2+1) x mels."""
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 1400), mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    up, down = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


class Features:
    """Frames, segments and tensors of one sound at a time; equal sounds give equal values."""

    def __init__(self):
        self.resample, self.mel = Resampler(), mel_filters()
        self.hann = np.hanning(WINDOW).astype(np.float32)
        self.kind = pa.fixed_shape_tensor(pa.float16(), [FRAMES, MELS])

    def frames(self, samples: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Log-mel frames (float16) and their energies in dB; at least one frame, zeros fill the last."""
        x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
        y = self.resample(x)
        n = 1 + max(0, -(-(len(y) - WINDOW) // HOP))
        y = np.pad(y, (0, (n - 1) * HOP + WINDOW - len(y)) if (n - 1) * HOP + WINDOW > len(y) else (0, 0))
        view = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP][:n]
        mel, energy = np.empty((n, MELS), np.float16), np.empty(n, np.float32)
        for at in range(0, n, FRAMES * CHUNK):
            part = view[at : at + FRAMES * CHUNK] * self.hann
            spectrum = np.fft.rfft(part, FFT, axis=1)
            power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
            mel[at : at + FRAMES * CHUNK] = np.log10(power @ self.mel + 1e-6)
            energy[at : at + FRAMES * CHUNK] = 10 * np.log10(np.mean(part**2, axis=1) + 1e-9)
        return mel, energy

    def segments(self, energy: np.ndarray) -> list[tuple[float, float]]:
        """Time spans (seconds) that open OPEN_DB above the mean energy and close CLOSE_DB from it."""
        mean = float(energy.mean())
        state = np.where(energy > mean + OPEN_DB, 1, np.where(energy < mean + CLOSE_DB, -1, 0))
        last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))  # the last frame that decided
        on = np.where(last >= 0, state[last], -1) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
        return [(a * HOP / TARGET, ((b - 1) * HOP + WINDOW) / TARGET) for a, b in edge.reshape(-1, 2).tolist()]

    def tensors(self, mel: np.ndarray) -> bytes:
        """An Arrow IPC stream: start, end (seconds) and a FRAMES x MELS tensor; the last is filled with zeros."""
        n = -(-len(mel) // FRAMES)
        full = np.zeros((n * FRAMES, MELS), np.float16)
        full[: len(mel)] = mel
        starts = np.arange(n) * FRAMES * HOP / TARGET
        ends = ((np.minimum((np.arange(n) + 1) * FRAMES, len(mel)) - 1) * HOP + WINDOW) / TARGET
        flat = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), FRAMES * MELS)
        batch = pa.record_batch([pa.array(starts), pa.array(ends), pa.ExtensionArray.from_storage(self.kind, flat)], ["start", "end", "mel"])
        out = io.BytesIO()
        with pa.ipc.new_stream(out, batch.schema) as w:
            w.write_batch(batch)
        return out.getvalue()


def audio_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (WAV), samples (read back), tensors (Arrow IPC), segments (time spans).

    Null and empty texts are one block of zeros; equal texts have equal values, repeated rows stay, an empty table
    gives no rows. Other columns are left out. Features of a long text are computed CHUNK tensors at a time.
    """

    def make():
        features = Features()

        def f(b):
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            step = 64
            for at in range(0, len(texts), step):
                cols = {"n_bytes": [], "media": [], "samples": [], "tensors": [], "segments": []}
                for t in texts[at : at + step]:
                    media = write_wav(payload(t))
                    back = read_wav(media)
                    mel, energy = features.frames(back)
                    for k, v in zip(cols, (len(t), media, back, features.tensors(mel), [{"start": a, "end": z} for a, z in features.segments(energy)]), strict=True):
                        cols[k].append(v)
                yield {"doc_id": ids.slice(at, step), **cols}

        return f

    rows = text_rows(docs)
    return map_batches(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, samples binary, tensors binary, segments array<struct<start:double,end:double>>")


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are one block of zero samples; feature digests tensors and segments."""
    spans = F.array_join(F.transform("segments", lambda s: F.concat_ws("-", F.format_number(s["start"], 4), F.format_number(s["end"], 4))), ",")
    return audio_columns(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.sha2("tensors", 256), F.size("segments").cast("string"), F.sha2(spans, 256)).alias("feature"),
        F.size("segments").cast("long").alias("n_segments"),
    )
