"""Distances between two signals: cepstra under time warping, and third-octave intelligibility.

Everything works within a row, on Arrow batches; a signal's spectra are made in
blocks of frames, so memory follows its cepstra or bands and not its spectra.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.operators.arrays import resampled

#: Fixed values of the intelligibility measure: rate, frame, step, transform, bands,
#: lowest centre in Hz, frames a segment, bound of distortion and dynamic range in dB.
RATE, FRAME, STEP, FFT, BANDS, LOWEST, SEGMENT, BOUND_DB, RANGE_DB = 10_000, 256, 128, 512, 15, 150.0, 30, 15.0, 40.0
BLOCK = 512


def _frames(x: np.ndarray, size: int, step: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)[::step] if len(x) >= size else np.zeros((0, size))


def _banded(x: np.ndarray, window: np.ndarray, step: int, fft: int, bank: np.ndarray) -> np.ndarray:
    """Power of each frame in each band of ``bank``."""
    made = _frames(x, len(window), step)
    parts = [abs(np.fft.rfft(made[k : k + BLOCK] * window, fft)) ** 2 @ bank.T for k in range(0, len(made), BLOCK)]
    return np.concatenate(parts) if parts else np.zeros((0, len(bank)))


def mel_bank(rate: int, fft: int, bands: int) -> np.ndarray:
    """Triangles of equal area on a mel scale that is linear up to 1000 Hz and logarithmic above."""
    slope, bend, octave = 200 / 3, 1000.0, math.log(6.4) / 27
    top = rate / 2
    most = top / slope if top < bend else bend / slope + math.log(top / bend) / octave
    mel = np.linspace(0, most, bands + 2)
    edges = np.where(mel < bend / slope, mel * slope, bend * np.exp(octave * (mel - bend / slope)))
    at = np.arange(fft // 2 + 1) * rate / fft
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((at - lo) / (mid - lo), (hi - at) / (hi - mid)), 0, None) * 2 / (hi - lo)


def mel_cepstra(x: np.ndarray, rate: int, n: int = 13, fft: int = 2048, step: int = 512, bands: int = 128) -> np.ndarray:
    """``n`` coefficients of each frame, frames centred on multiples of ``step``."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(fft) / fft)
    power = _banded(np.pad(x, fft // 2), window, step, fft, mel_bank(rate, fft, bands))
    level = 10 * np.log10(np.maximum(power, 1e-10))
    level = np.maximum(level, level.max() - 80) if level.size else level
    wave = np.cos(np.pi * np.arange(n)[:, None] * (2 * np.arange(bands) + 1) / (2 * bands)) * math.sqrt(2 / bands)
    wave[0] /= math.sqrt(2)
    return level @ wave.T


def warped(a: np.ndarray, b: np.ndarray, band: int) -> float | None:
    """Mean distance of frames on the cheapest warping path within ``band`` of the diagonal.

    A step along one side weighs 1, along both 2, so every path weighs len(a) + len(b)
    and ties don't matter. Within a row the steps along ``b`` are a prefix minimum
    over sums of costs; only one row is kept. ``band`` 0 with equal lengths compares
    frame by frame; with others the band is at least the difference. None without frames.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return None
    band = max(band, abs(n - m))
    above = np.full(m + 1, np.inf)  # above[j + 1] is the cost of reaching (i - 1, j)
    for i in range(n):
        lo, hi = max(0, i - band), min(m, i + band + 1)
        cost = np.sqrt(((a[i] - b[lo:hi]) ** 2).sum(axis=1))
        come = np.minimum(above[lo + 1 : hi + 1] + cost, above[lo:hi] + 2 * cost)
        if i == 0:
            come[0] = 2 * cost[0]
        total = np.cumsum(cost)
        above = np.full(m + 1, np.inf)
        above[lo + 1 : hi + 1] = total + np.minimum.accumulate(come - total)
    return float(above[m]) / (n + m)


#: From the distance of cepstra to dB.
DB = 10 * math.sqrt(2) / math.log(10)


def _pairwise(one: Callable[[np.ndarray, np.ndarray], float | None]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64").astype("Float64")

    return run


def _matrix(frames) -> np.ndarray:
    return np.array([np.asarray(f, dtype=float) for f in frames]) if len(frames) else np.zeros((0, 1))


def cepstral_distance(a: Column, b: Column, band: int = 0) -> Column:
    """Distortion in dB of two arrays of cepstra, without each frame's first coefficient (its energy).

    Null where one is null or has no frames.
    """

    def one(x, y):
        d = warped(_matrix(x)[:, 1:], _matrix(y)[:, 1:], band)
        return None if d is None else DB * d

    return _pairwise(one)(a, b)


def cepstral_distortion(reference: Column, degraded: Column, rate: int, band: int | None = None, n: int = 13) -> Column:
    """Mel cepstral distortion in dB of two signals.

    Without ``band`` frames are compared one by one up to the shorter signal's end,
    with it along a warping path. Null where one is null or empty.
    """

    def one(x, y):
        if not len(x) or not len(y):
            return None
        p, q = (mel_cepstra(np.asarray(v, dtype=float), rate, n)[:, 1:] for v in (x, y))
        k = min(len(p), len(q))
        return DB * (warped(p[:k], q[:k], 0) if band is None else warped(p, q, band))

    return _pairwise(one)(reference, degraded)


def third_octaves() -> np.ndarray:
    """The bins of each third-octave band as rows of zeros and ones."""
    centre = LOWEST * 2 ** (np.arange(BANDS) / 3)
    lo, hi = (np.rint(centre * 2 ** (s / 6) * FFT / RATE).astype(int)[:, None] for s in (-1, 1))
    k = np.arange(FFT // 2 + 1)
    return ((k >= lo) & (k < hi)).astype(float)


def _voiced(x: np.ndarray, y: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both signals without the frames in which the first is silent, the others overlapped and added."""
    p, q = _frames(x, FRAME, STEP), _frames(y, FRAME, STEP)
    level = np.array([np.sum((f * window) ** 2) for f in p])
    keep = np.flatnonzero(level > level.max() * 10 ** (-RANGE_DB / 10))
    out = np.zeros((2, (len(keep) - 1) * STEP + FRAME if len(keep) else 0))
    for k, f in enumerate(keep):
        out[:, k * STEP : k * STEP + FRAME] += np.stack([p[f], q[f]]) * window
    return out[0], out[1]


def intelligible(x: np.ndarray, y: np.ndarray) -> float | None:
    """Mean correlation of bands over segments of 30 frames; None for signals below one segment."""
    n = min(len(x), len(y))
    if n < FRAME:
        return None
    window = np.hanning(FRAME + 2)[1:-1]
    x, y = _voiced(x[:n], y[:n], window)
    bank, tiny = third_octaves(), np.finfo(float).eps
    p, q = (np.sqrt(_banded(v, window, STEP, FFT, bank)) for v in (x, y))
    total, made = 0.0, len(p) - SEGMENT + 1
    if made < 1:
        return None
    for k in range(made):
        a, b = p[k : k + SEGMENT], q[k : k + SEGMENT]
        b = b * np.sqrt((a * a).sum(axis=0) / ((b * b).sum(axis=0) + tiny))
        b = np.minimum(b, a * (1 + 10 ** (BOUND_DB / 20)))
        a, b = a - a.mean(axis=0), b - b.mean(axis=0)
        total += float(((a * b).sum(axis=0) / (np.sqrt((a * a).sum(axis=0) * (b * b).sum(axis=0)) + tiny)).mean())
    return total / made


def intelligibility(reference: Column, degraded: Column, rate: int) -> Column:
    """Short-time objective intelligibility of a degraded signal, about 0 to 1.

    Signals are cut to the shorter one and taken to 10 kHz; frames 40 dB below the
    reference's loudest are left out. Null where one is null or where fewer than 30
    frames are left (384 ms).
    """
    taken = lambda x: resampled(np.asarray(x, dtype=float), rate, RATE)
    return _pairwise(lambda x, y: intelligible(taken(x), taken(y)))(reference, degraded)
