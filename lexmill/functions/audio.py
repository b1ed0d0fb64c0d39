"""Clips as columns: struct<samples array<float>, sample_rate int>; levels, gain, resampling, trimming, audio mark.

Arrow hands a clip over as one array; its NumPy work sees one clip at a time, so memory is bounded by the longest."""

from __future__ import annotations

import hashlib
import hmac
import io
import wave
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.outcomes import TextError

CLIP = "struct<samples:array<float>,sample_rate:int>"
PCM_TOP = 32767
# Fixed values of the mark: bits, least samples a bit, band as shares of the Nyquist frequency, amplitude, least certainty,
# the text that (with the bit's number after it) seeds a bit's phases.
BITS, LEAST_BLOCK = 32, 256
BAND = (0.58, 0.92)
STRENGTH, CERTAIN = 0.008, 0.06
SEEDED_BY = "chip:"


class AudioError(TextError):
    def __init__(self, message: str):
        super().__init__(message, "audio_error")


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1] and rate of a PCM WAV file of 8, 16, 24 or 32 bits; channels are averaged."""
    try:
        with wave.open(io.BytesIO(data)) as f:
            channels, width, rate, raw = f.getnchannels(), f.getsampwidth(), f.getframerate(), f.readframes(f.getnframes())
    except (wave.Error, EOFError) as e:
        raise AudioError(f"not a PCM WAV file: {e}") from e
    b = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], np.uint8).reshape(-1, width)
    if not len(b):
        raise AudioError("no samples")
    if width == 1:
        x = b[:, 0] / 128.0 - 1
    else:
        full = np.zeros((len(b), 4), np.uint8)
        full[:, 4 - width :] = b
        x = full.view("<i4")[:, 0] / 2.0**31
    return x.reshape(-1, channels).mean(axis=1).astype(np.float32), rate


def pcm16(x: np.ndarray) -> bytes:
    return (np.clip(x, -1, 1) * PCM_TOP).astype("<i2").tobytes()


def wav_header(rate: int, data_bytes: int = 0xFFFFFFF) -> bytes:
    """44 bytes before mono samples of 16 bits; by default of a length that isn't known yet."""
    n = lambda v, size: int(v).to_bytes(size, "little")
    form = n(1, 2) + n(1, 2) + n(rate, 4) + n(2 * rate, 4) + n(2, 2) + n(16, 2)
    return b"RIFF" + n(36 + data_bytes, 4) + b"WAVEfmt " + n(len(form), 4) + form + b"data" + n(data_bytes, 4)


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    data = pcm16(x)
    return wav_header(rate, len(data)) + data


def rms_db(x: np.ndarray) -> float:
    return float(10 * np.log10(np.mean(np.square(x, dtype=np.float64)) + 1e-12))


@lru_cache
def _weighting(rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two filters (b, a) before the mean square of BS.1770: a high shelf and a high pass, for any rate."""
    out = []
    for shelf, gain, q, f in ((True, 4.0, 1 / np.sqrt(2), 1500.0), (False, 0.0, 0.5, 38.0)):
        w = 2 * np.pi * f / rate
        al, c = np.sin(w) / (2 * q), np.cos(w)
        if shelf:
            g = 10 ** (gain / 40)
            root = 2 * np.sqrt(g) * al
            b = [g * (g + 1 + (g - 1) * c + root), -2 * g * (g - 1 + (g + 1) * c), g * (g + 1 + (g - 1) * c - root)]
            a = [g + 1 - (g - 1) * c + root, 2 * (g - 1 - (g + 1) * c), g + 1 - (g - 1) * c - root]
        else:
            b, a = [(1 + c) / 2, -(1 + c), (1 + c) / 2], [1 + al, -2 * c, 1 - al]
        out.append((np.array(b) / a[0], np.array(a) / a[0]))
    return out


def _filtered(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Second-order filter, by multiplication with its response on a grid padded far beyond its ringing."""
    n = 1 << int(np.ceil(np.log2(len(x) + 16384)))
    z = np.exp(-2j * np.pi * np.arange(n // 2 + 1) / n)
    response = (b[0] + b[1] * z + b[2] * z**2) / (a[0] + a[1] * z + a[2] * z**2)
    return np.fft.irfft(np.fft.rfft(x, n) * response, n)[: len(x)]


def loudness(x: np.ndarray, rate: int) -> tuple[float, str]:
    """Integrated loudness in LUFS by gated blocks of 400 ms every 100 ms; the RMS level of shorter clips and of
    those that the gates leave nothing of."""
    size, step = int(0.4 * rate), int(0.1 * rate)
    if len(x) >= size > 0:
        y = x.astype(np.float64)
        for b, a in _weighting(rate):
            y = _filtered(y, b, a)
        total = np.concatenate([[0.0], np.cumsum(y * y)])
        starts = np.arange((len(x) - size) // step + 1) * step
        power = np.maximum((total[starts + size] - total[starts]) / size, 0)
        level = lambda p: -0.691 + 10 * np.log10(np.maximum(p, 1e-30))
        heard = power[level(power) >= -70]
        if len(heard):
            heard = heard[level(heard) > level(heard.mean()) - 10]
            return float(level(heard.mean())), "itu_bs1770"
    return rms_db(x), "rms_dbfs"


def normalized_loudness(x: np.ndarray, rate: int, *, target: float = -23.0, ceiling: float = -1.0, most: float = 30.0) -> tuple[np.ndarray, float, str]:
    """Clip at the target, as far as gain limit and peak ceiling let it; with level and method of the clip before."""
    peak = float(np.abs(x).max()) if len(x) else 0.0
    if peak == 0:
        raise AudioError("silence has no loudness")
    level, method = loudness(x, rate)
    gain = min(target - level, most, ceiling - 20 * np.log10(peak))
    return np.clip(x * 10 ** (gain / 20), -1, 1).astype(np.float32), level, method


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """By cutting or padding the spectrum: band-limited, so nothing aliases."""
    if to <= 0:
        raise AudioError("a sample rate is positive")
    n = max(1, round(len(x) * to / rate))
    if to == rate or not len(x):
        return x.astype(np.float32)
    spectrum = np.fft.rfft(x.astype(np.float64))[: n // 2 + 1]
    return (np.fft.irfft(spectrum, n) * (n / len(x))).astype(np.float32)


@lru_cache(maxsize=16)
def _phasors(key: bytes, size: int) -> tuple[slice, np.ndarray]:
    """Where the band lies in a block's spectrum, and the keyed phase of each of its frequencies, a row a bit."""
    band = slice(*(int(share * (size // 2)) for share in BAND))
    seeds = [hmac.digest(key, f"{SEEDED_BY}{bit}".encode(), hashlib.sha256)[:8] for bit in range(BITS)]
    turns = [np.random.default_rng(int.from_bytes(s, "big")).uniform(0, 2 * np.pi, band.stop - band.start) for s in seeds]
    return band, np.exp(1j * np.array(turns))


def marked(x: np.ndarray, payload: int, key: bytes, strength: float = STRENGTH) -> np.ndarray:
    """Clip with a 32-bit payload, highest bit first: the clip is a matrix of 32 rows, and each row gets noise of the mean
    level `strength`, built from its bit's phases and turned over for a 0, by one inverse transform of the whole matrix."""
    size = len(x) // BITS
    if not key or not 0 <= payload < 1 << BITS:
        raise AudioError("a mark needs a key and a payload of 32 bits")
    if size < LEAST_BLOCK:
        raise AudioError(f"too short for a mark: {len(x)} of {LEAST_BLOCK * BITS} samples")
    band, phasors = _phasors(key, size)
    signs = np.unpackbits(np.frombuffer(payload.to_bytes(4, "big"), np.uint8)) * 2.0 - 1
    spectrum = np.zeros((BITS, size // 2 + 1), complex)
    # Of k unit phasors the inverse transform has the mean square 2k / size^2.
    spectrum[:, band] = signs[:, None] * phasors * (strength * size / np.sqrt(2 * phasors.shape[1]))
    noise = np.pad(np.fft.irfft(spectrum, size, axis=1).ravel(), (0, len(x) - size * BITS))
    return np.clip(x + noise, -1, 1).astype(np.float32)


def mark_of(x: np.ndarray, key: bytes, least: float = CERTAIN) -> tuple[int | None, float]:
    """Payload, if one is found, and the mean size of the correlations of the rows' spectra with the key's phases. A clip's
    level cancels out of them; nothing outside the band is looked at."""
    size = len(x) // BITS
    if size < LEAST_BLOCK:
        return None, 0.0
    band, phasors = _phasors(key, size)
    spectra = np.fft.rfft(np.reshape(x[: size * BITS], (BITS, size)).astype(np.float64), axis=1)[:, band]
    energy = np.sqrt((np.abs(spectra) ** 2).sum(axis=1) * phasors.shape[1])
    alike = np.einsum("ij,ij->i", spectra, phasors.conj()).real / np.where(energy > 0, energy, np.inf)
    certain = float(np.abs(alike).mean())
    return (int.from_bytes(np.packbits(alike > 0).tobytes(), "big") if certain >= least else None), certain


def stub_seconds(phones: Column, speed: float = 1.0) -> Column:
    """Length of the stand-in voice: 85 ms a phoneme, a long one 1.6 times that."""
    return F.aggregate(phones, F.lit(0.0), lambda s, p: s + F.lit(0.085 / speed) * F.when(p.endswith("ː"), 1.6).otherwise(1.0))


def sliced(samples: Column, rate: Column, start: Column, end: Column) -> Column:
    """Samples of [start, end) seconds, cut to the clip."""
    a = F.greatest((start * rate).cast("int"), F.lit(0))
    b = F.least((end * rate).cast("int"), F.size(samples))
    return F.slice(samples, a + 1, F.greatest(b - a, F.lit(0)))


def _on_clips(f: Callable[..., object], value_type: str) -> Callable[..., Column]:
    """Column function of f(samples, rate, ...): struct<value, error_code, error_message>; a null argument: all null."""

    def run(batches: Iterator[tuple[pd.DataFrame, ...]]) -> Iterator[pd.DataFrame]:
        for clip, *more in batches:
            out = []
            for samples, rate, *args in zip(clip["samples"], clip["sample_rate"], *more, strict=True):
                if samples is None or any(a is None or a != a for a in (rate, *args)):
                    out.append((None, None, None))
                    continue
                try:
                    out.append((f(np.asarray(samples, np.float32), int(rate), *args), None, None))
                except AudioError as e:
                    out.append((None, e.code, str(e)))
            yield pd.DataFrame(out, columns=["value", "error_code", "error_message"], dtype=object)

    kind = f"value {value_type}, error_code string, error_message string"

    def column(*args: Column) -> Column:
        if len(args) == 1:
            return F.pandas_udf(_single, kind)(*args)
        return F.pandas_udf(_several, kind)(*args)

    def _single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run((b,) for b in batches)

    def _several(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from run(batches)

    return column


def loudness_column(clip: Column) -> Column:
    return _on_clips(lambda x, r: dict(zip(("loudness", "method"), loudness(x, r), strict=True)), "struct<loudness:double,method:string>")(clip)


def normalized_column(clip: Column, *, target: float = -23.0) -> Column:
    def one(x, r):
        y, level, method = normalized_loudness(x, r, target=target)
        return {"samples": y, "sample_rate": r, "loudness": level, "method": method}

    return _on_clips(one, "struct<samples:array<float>,sample_rate:int,loudness:double,method:string>")(clip)


def resampled_column(clip: Column, to: int) -> Column:
    return _on_clips(lambda x, r: {"samples": resampled(x, r, to), "sample_rate": to}, CLIP)(clip)


def marked_column(clip: Column, payload: Column, key: bytes) -> Column:
    return _on_clips(lambda x, r, p: {"samples": marked(x, int(p), key), "sample_rate": r}, CLIP)(clip, payload)


def mark_column(clip: Column, key: bytes) -> Column:
    def one(x, r):
        payload, certain = mark_of(x, key)
        return {"detected": payload is not None, "payload": payload, "confidence": round(certain, 4)}

    return _on_clips(one, "struct<detected:boolean,payload:long,confidence:double>")(clip)


def wav_column(clip: Column) -> Column:
    return _on_clips(lambda x, r: encode_wav(x, r), "binary")(clip)
