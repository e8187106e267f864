"""PCM WAV files: shape, samples, cuts with metrics, quiet boundaries, silences."""

from __future__ import annotations

import io
import math
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PCM, EXTENSIBLE = 1, 0xFFFE
#: Fixed value: the tail of every sub-format GUID of WAVE_FORMAT_EXTENSIBLE.
GUID_TAIL = bytes.fromhex("000000001000800000aa00389b71")
SHAPE_TYPE = "struct<sample_rate:int,channels:int,bits_per_sample:int,frame_count:bigint,duration_seconds:double,error:string>"
METRICS_TYPE = "struct<sample_rate:int,channels:int,bits_per_sample:int,frame_count:bigint,duration_seconds:double,peak_dbfs:double,rms_dbfs:double,clipping_samples:bigint>"


@dataclass
class Wav:
    rate: int
    channels: int
    bits: int
    data: bytes

    @property
    def frames(self) -> int:
        return len(self.data) // (self.channels * self.bits // 8)

    def samples(self) -> np.ndarray:
        """[frames, channels] of whole numbers; 8-bit files are unsigned on disk and centred here."""
        raw = np.frombuffer(self.data[: self.frames * self.channels * self.bits // 8], np.uint8)
        if self.bits == 8:
            flat = raw.astype(np.int64) - 128
        elif self.bits == 24:
            b = raw.reshape(-1, 3).astype(np.int64)
            flat = b[:, 0] | b[:, 1] << 8 | (b[:, 2] - ((b[:, 2] & 0x80) << 1)) << 16
        else:
            flat = raw.view({16: "<i2", 32: "<i4"}[self.bits]).astype(np.int64)
        return flat.reshape(-1, self.channels)


def parse(content: bytes) -> Wav:
    """Raises ValueError for what is no PCM WAV of 8, 16, 24 or 32 bits."""
    f = io.BytesIO(content)
    if f.read(4) != b"RIFF" or len(f.read(4)) != 4 or f.read(4) != b"WAVE":
        raise ValueError("not a WAV file")
    form = data = None
    while len(head := f.read(8)) == 8:
        kind, size = struct.unpack("<4sI", head)
        body = f.read(size + size % 2)[:size]
        if kind == b"fmt ":
            form = body
        elif kind == b"data":
            data = body
    if form is None or data is None or len(form) < 16:
        raise ValueError("a format or data chunk is missing")
    tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
    if tag == EXTENSIBLE:
        if len(form) < 40 or form[26:40] != GUID_TAIL or struct.unpack("<H", form[18:20])[0] != bits:
            raise ValueError("unsupported extensible format")
        tag = struct.unpack("<H", form[24:26])[0]
    if tag != PCM or bits not in (8, 16, 24, 32) or not channels or not rate:
        raise ValueError("not PCM of a supported width")
    return Wav(rate, channels, bits, data)


def written(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit WAV of [frames, channels]."""
    data = samples.astype("<i2").tobytes()
    n = samples.shape[1]
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, PCM, n, rate, rate * n * 2, n * 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def dbfs(x: float) -> float:
    return 20.0 * math.log10(x / 32768.0) if x > 0 else -math.inf


def metrics(samples: np.ndarray, rate: int) -> dict:
    size = np.abs(samples.astype(np.int64))
    n = len(samples)
    return {"sample_rate": rate, "channels": samples.shape[1], "bits_per_sample": 16, "frame_count": n, "duration_seconds": n / rate, "peak_dbfs": dbfs(float(size.max(initial=0))), "rms_dbfs": dbfs(float(np.sqrt(np.mean(size.astype(float) ** 2))) if size.size else 0.0), "clipping_samples": int((size >= 32767).sum())}


def cut(samples: np.ndarray, rate: int, start: int, end: int, fade_ms: float = 5.0) -> np.ndarray:
    """Samples start to end, clamped, with linear fades at both ends of half the cut at most."""
    part = samples[max(0, start) : min(len(samples), end)].astype(float)
    n = min(len(part) // 2, round(rate * fade_ms / 1000))
    if n:
        ramp = (np.arange(n) / n)[:, None]
        part[:n] *= ramp
        part[-n:] *= ramp[::-1]
    return np.rint(part).astype(np.int64)


def _levels(mono: np.ndarray, window: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and RMS of windows."""
    at = np.arange(0, max(0, len(mono) - window) + 1, hop)
    total = np.r_[0.0, np.cumsum(mono.astype(float) ** 2)]
    return at, np.sqrt(np.maximum(0.0, total[np.minimum(at + window, len(mono))] - total[at]) / max(1, window))


def quietest_boundary(samples: np.ndarray, rate: int, proposed: int, low: int, high: int, search: float = 0.2, window: float = 0.02, hop: float = 0.005, most_dbfs: float = -42.0) -> int:
    """The middle of the quietest window near `proposed`, the nearest of equals; `proposed` where none is quiet enough."""
    low, high = max(low, proposed - round(search * rate), 0), min(high, proposed + round(search * rate), len(samples))
    w, h = max(1, round(window * rate)), max(1, round(hop * rate))
    if high - low < w:
        return proposed
    at, level = _levels(samples[low:high].mean(1), w, h)
    middle = low + at + w // 2
    best = min(range(len(at)), key=lambda i: (level[i], abs(int(middle[i]) - proposed)))
    return int(middle[best]) if dbfs(float(level[best])) <= most_dbfs else proposed


def first_quiet_boundary(samples: np.ndarray, rate: int, low: int, high: int, window: float = 0.02, hop: float = 0.005, most_dbfs: float = -42.0) -> int | None:
    low, high = max(0, low), min(high, len(samples))
    w = max(1, round(window * rate))
    if high - low < w:
        return None
    at, level = _levels(samples[low:high].mean(1), w, max(1, round(hop * rate)))
    return next((int(low + a + w // 2) for a, x in zip(at, level) if dbfs(float(x)) <= most_dbfs), None)


def silences(samples: np.ndarray, rate: int, most_dbfs: float = -42.0, least: float = 0.2, window: float = 0.02) -> list[tuple[float, float]]:
    """(start, end) in seconds of runs of quiet windows that last `least` or more."""
    w = max(1, round(window * rate))
    at, level = _levels(samples.mean(1) if len(samples) else np.zeros(0), w, w)
    quiet = np.array([dbfs(float(x)) <= most_dbfs for x in level], bool)
    edge = np.flatnonzero(np.diff(np.r_[False, quiet, False].astype(int)))
    runs = [(at[a] / rate, min(len(samples), at[b - 1] + w) / rate) for a, b in zip(edge[::2], edge[1::2])]
    return [(float(a), float(b)) for a, b in runs if b - a >= least]


def shape_of(content: Column) -> Column:
    @F.pandas_udf(SHAPE_TYPE)
    def run(c: pd.Series) -> pd.DataFrame:
        rows = []
        for x in c:
            try:
                w = parse(x)
                rows.append((w.rate, w.channels, w.bits, w.frames, w.frames / w.rate, None))
            except (ValueError, TypeError) as e:
                rows.append((None, None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["sample_rate", "channels", "bits_per_sample", "frame_count", "duration_seconds", "error"])

    return run(content)


def cut_metrics(files: DataFrame, fade_ms: float = 5.0) -> DataFrame:
    """files (content, start_sample, end_sample, ...): adds clip (16-bit WAV bytes) and metrics of each cut."""

    @F.pandas_udf(f"struct<clip:binary,metrics:{METRICS_TYPE}>")
    def run(c: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, start, end in zip(c, a, b):
            w = parse(x)
            s = w.samples()
            s = s if w.bits == 16 else np.clip(np.rint(s * 2.0 ** (16 - w.bits)), -32768, 32767).astype(np.int64)
            part = cut(s, w.rate, int(start), int(end), fade_ms)
            rows.append((written(part, w.rate), metrics(part, w.rate)))
        return pd.DataFrame(rows, columns=["clip", "metrics"])

    return files.withColumn("__c", run("content", "start_sample", "end_sample")).select(*files.columns, "__c.clip", "__c.metrics")


def inventory(spark, folder: str) -> DataFrame:
    """(path, name, size_bytes, sha256, shape) of a folder's WAV files."""
    from .tables import files

    found = files(spark, folder, "*.wav")
    return found.withColumn("shape", shape_of(F.col("content"))).drop("content")
