"""Quality report, gate, speech segments and trimming of single clips (operators/signal.py has them for sample rows)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.audio import _on_clips
from lexmill.functions.columns import reasons

REPORT = "struct<duration_seconds:double,peak_dbfs:double,clipping_ratio:double,dc_offset:double,silence_ratio:double,estimated_snr_db:double>"
FRAME_SECONDS, WINDOW, MANY = 0.02, 25, 50


def energies(x: np.ndarray, rate: int) -> np.ndarray:
    """Level in dB of whole frames of 20 ms; of a shorter clip one level."""
    size = int(rate * FRAME_SECONDS)
    n = len(x) // size if size else 0
    frames = x[: n * size].reshape(n, size) if n else x.reshape(1, -1)
    return 20 * np.log10(np.sqrt(np.mean(frames.astype(np.float64) ** 2, axis=1)) + 1e-12)


def floor_of(e: np.ndarray) -> float:
    if len(e) < MANY:
        return float(np.percentile(e, 5))
    return float(np.percentile(e[: len(e) // WINDOW * WINDOW].reshape(-1, WINDOW).min(axis=1), 10))


def report(x: np.ndarray, rate: int) -> dict[str, float]:
    e = energies(x, rate)
    low, level = floor_of(e), np.abs(x)
    peak = float(level.max())
    return {
        "duration_seconds": len(x) / rate,
        "peak_dbfs": float(20 * np.log10(peak)) if peak else float("-inf"),
        "clipping_ratio": float(np.mean(level >= 0.99)),
        "dc_offset": float(np.mean(x, dtype=np.float64)),
        "silence_ratio": float(np.mean(e < low + 6)),
        "estimated_snr_db": float(np.percentile(e, 90) - low),
    }


def speech(x: np.ndarray, rate: int, *, margin: float = 10.0, idle: int = 9, least: int = 5) -> list[tuple[float, float]]:
    """Start and end in seconds of runs of frames over the tenth percentile plus margin. A run that quiet frames
    close ends where its last loud frame starts; the run open at the end goes on to it."""
    e = energies(x, rate)
    loud = np.flatnonzero(e > np.percentile(e, 10) + margin)
    out = []
    for run in np.split(loud, np.flatnonzero(np.diff(loud) - 1 > idle) + 1) if len(loud) else []:
        end = len(e) if len(e) - 1 - run[-1] <= idle else run[-1]
        if end - run[0] >= least:
            out.append((run[0] * FRAME_SECONDS, min(max(end, run[0] + 1) * FRAME_SECONDS, len(x) / rate)))
    return out


def trimmed(x: np.ndarray, rate: int, pad: float = 0.05) -> np.ndarray:
    """From the first speech to the last, with padding; all of it where there is no speech."""
    found = speech(x, rate)
    if not found:
        return x
    return x[max(0, int((found[0][0] - pad) * rate)) : min(len(x), int((found[-1][1] + pad) * rate))]


def report_column(clip: Column) -> Column:
    return _on_clips(report, REPORT)(clip)


def gate(r: Column) -> Column:
    """Reason codes of a report that the gate refuses, in fixed order; empty if it passes."""
    return reasons(
        (r["duration_seconds"] < 0.5, "too_short"), (r["duration_seconds"] > 30.0, "too_long"), (r["estimated_snr_db"] < 20.0, "noisy"), (r["clipping_ratio"] > 0.001, "clipped"),
        (r["silence_ratio"] > 0.6, "mostly_silence"), (F.abs(r["dc_offset"]) > 0.01, "dc_offset"), (r["peak_dbfs"] < -40.0, "too_quiet"),
    )


def rounded(r: Column) -> Column:
    """Report as a map, as manifests hold it."""
    digits = {"duration_seconds": 4, "peak_dbfs": 2, "clipping_ratio": 6, "dc_offset": 6, "silence_ratio": 4, "estimated_snr_db": 2}
    return F.create_map(*[c for k, d in digits.items() for c in (F.lit(k), F.round(r[k], d))])
