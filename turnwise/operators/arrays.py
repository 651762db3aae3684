"""Signals and token arrays as array columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x).cast("double"))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once a row, also where ``f`` uses it in a lambda."""
    return F.transform(F.array(value), f)[0]


def rms(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sqrt(_sum(a, lambda x: x * x) / F.size(a))).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, null where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(_sum(a, lambda x: x * x.cast("double"))) * F.sqrt(_sum(b, lambda x: x * x.cast("double")))
    return F.when(norm > 0, dot / norm)


def frame_energies(a: Column, frame: int) -> Column:
    """RMS of each whole frame; a short tail is ignored."""
    n = F.floor(F.size(a) / frame).cast("int")
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda k: rms(F.slice(a, k * frame + 1, frame)))
    return F.when(n > 0, made).otherwise(F.array().cast("array<double>"))


def active_ratio(a: Column, frame: int = 1600, threshold: float = 0.01) -> Column:
    """Share of frames above the threshold; short signals are one frame."""
    e = frame_energies(a, frame)
    share = F.size(F.filter(e, lambda x: x > threshold)) / F.size(e)
    return F.when(F.size(e) > 0, share).otherwise(F.when(rms(a) > threshold, 1.0).otherwise(0.0))


def estimated_snr(a: Column, quantile: float = 0.05) -> Column:
    """dB of the RMS over a low quantile of magnitudes (the noise floor)."""
    mags = F.array_sort(F.transform(a, lambda x: F.abs(x.cast("double"))))
    at = (F.size(a) - 1) * quantile
    low = F.floor(at).cast("int")
    noise = mags[low] + (F.coalesce(F.get(mags, low + 1), mags[low]) - mags[low]) * (at - low)
    return 20 * F.log10(rms(a) / (noise + 1e-8))


def signal_to_noise(signal: Column, noise: Column) -> Column:
    """dB of two signals' powers; 100 without noise, 0 without signal."""
    power = lambda a: _sum(a, lambda x: x * x.cast("double")) / F.greatest(F.size(a), F.lit(1))
    s, n = power(signal), power(noise)
    return F.when(n < 1e-10, 100.0).when(s < 1e-10, 0.0).otherwise(10 * F.log10(s / n))


def silence_ratio(a: Column, threshold_db: float = -40.0, frame: int = 1024, hop: int = 512) -> Column:
    """Share of overlapping frames whose RMS is below the threshold; 0 for short signals."""
    n = F.ceil((F.size(a) - frame) / hop).cast("int")
    quiet = F.filter(F.sequence(F.lit(0), n - 1), lambda k: rms(F.slice(a, k * hop + 1, frame)) < 10 ** (threshold_db / 20))
    return F.when(n > 0, F.size(quiet) / n).otherwise(0.0)


def clip_ratio(a: Column, limit: float = 0.99) -> Column:
    return F.size(F.filter(a, lambda x: F.abs(x) >= limit)) / F.greatest(F.size(a), F.lit(1))


def dbfs(a: Column) -> Column:
    return 20 * F.log10(rms(a) + 1e-8)


def loudness_normalised(a: Column, target_db: float = -23.0, peak: float = 0.95) -> Column:
    """Peak to 0.95, then RMS to the target, clipped to [-1, 1]."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = peak / F.when(top > 0, top)
    level = rms(a) * scale
    gain = F.coalesce(scale * (10 ** (target_db / 20)) / F.when(level > 0, level), F.lit(1.0))
    return let(gain, lambda g: F.transform(a, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") * g))))


def masked(a: Column, spans: Column, rate: float) -> Column:
    """Samples within any span (structs start, end in seconds), else 0."""
    return F.transform(a, lambda x, i: F.when(F.exists(spans, lambda s: (i >= (s["start"] * rate).cast("int")) & (i < (s["end"] * rate).cast("int"))), x).otherwise(F.lit(0).cast("float")))


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: (x + y) / 2)


def fingerprint(a: Column) -> Column:
    """Sum, mean, first and last three samples."""
    total = _sum(a)
    return F.struct(total.alias("sum"), (total / F.greatest(F.size(a), F.lit(1))).alias("mean"), F.slice(a, 1, 3).alias("first"), F.slice(a, -3, 3).alias("last"))


def quality_issues(snr: Column, clipped: Column, level: Column, least_snr: float = 20.0) -> Column:
    """Names of the limits that a reference voice misses."""
    rules = [(snr < least_snr, "low_snr"), (clipped > 0.001, "clipping"), (level < -40, "too_quiet"), (level > -10, "too_loud")]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in rules)))


def quality_advice(issues: Column, silence: Column, most_silence: float = 0.3) -> Column:
    """What to do about the issues, and about much silence."""
    advice = {"low_snr": "record_quieter", "clipping": "lower_input", "too_quiet": "raise_level", "too_loud": "reduce_level"}
    todo = [F.when(F.array_contains(issues, k), F.lit(v)) for k, v in advice.items()]
    return F.array_compact(F.array(*todo, F.when(silence > most_silence, F.lit("trim_silence"))))


def span(a: Column, seconds: float, rate: float, mode: str = "start") -> Column:
    """The first or last frames of a fixed duration."""
    n = int(seconds * rate)
    return F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, n) if mode == "end" else F.slice(a, 1, n)


def span_bounds(total: Column, seconds: float, rate: float, mode: str = "start") -> Column:
    n = F.least(F.lit(int(seconds * rate)), total)
    return F.struct((total - n).alias("start"), total.alias("end")) if mode == "end" else F.struct(F.lit(0).alias("start"), n.alias("end"))


def free_regions(total: Column, start: Column, end: Column, least: Column | int) -> Column:
    """What a span leaves of [0, total), each longer than ``least``."""
    both = F.array(F.struct(F.lit(0).alias("start"), start.alias("end")), F.struct(end.alias("start"), total.alias("end")))
    return F.filter(both, lambda r: r["end"] - r["start"] > least)


def word_span(tokens: Column, pad: int, first: int, words: int, margin: int = 2) -> Column:
    """Frames of the first .. (first + words - 1)-th token that isn't padding, with a margin."""
    at = F.filter(F.transform(tokens, lambda t, i: F.when(t != pad, i)), lambda i: i.isNotNull())
    n = F.size(tokens)
    whole = F.struct(F.lit(0).alias("start"), n.alias("end"))
    part = F.struct(F.greatest(at[first] - margin, F.lit(0)).alias("start"), F.least(at[first + words - 1] + margin + 1, n).alias("end"))
    return F.when(F.size(at) <= words, whole).when(F.size(at) < first + words, whole).otherwise(part)


def with_prompt(codes: Column, prompt: Column) -> Column:
    """Prompt in front of codes, and a mask that is false over the prompt."""
    mask = F.concat(F.transform(prompt, lambda _: F.lit(False)), F.transform(codes, lambda _: F.lit(True)))
    return F.struct(F.concat(prompt, codes).alias("codes"), mask.alias("mask"))


def scaled_codes(a: Column, scale: int) -> Column:
    """Integer codes of values: scaled in single precision (a float times an integer is a double in Spark), then cut towards zero."""
    return F.transform(a, lambda x: (x.cast("float") * F.lit(scale).cast("float")).cast("int"))


def pad_codebooks(codes: Column, rows: int, pad: int) -> Column:
    """An array of codebooks padded to ``rows`` of them."""
    empty = F.transform(codes[0], lambda _: F.lit(pad).cast("int"))
    return F.concat(codes, F.array_repeat(empty, F.greatest(F.lit(rows) - F.size(codes), F.lit(0))))


def stereo(left: Column, right: Column, rate: int) -> Column:
    """Two sides as one signal of pairs, the shorter one padded with zeros, and totals of each side."""
    n = F.greatest(F.size(left), F.size(right))
    padded = [F.concat(x.cast("array<double>"), F.array_repeat(F.lit(0.0), n - F.size(x))) for x in (left, right)]
    seconds = lambda x: F.round(F.size(F.filter(x, lambda v: F.abs(v) > 0)) / F.lit(float(rate)), 6)
    frames = F.zip_with(*padded, lambda a, b: F.array(a, b))
    return F.struct(frames.alias("samples"), (n / F.lit(float(rate))).alias("duration"), seconds(left).alias("left_seconds"), seconds(right).alias("right_seconds"), rms(left).alias("left_rms"), rms(right).alias("right_rms"))


def pad_window(samples: Column, length: int) -> Column:
    """Samples of a window, the last one filled up with zeros."""
    return F.concat(samples.cast("array<double>"), F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - F.size(samples), F.lit(0))))


def sinc_filters(old: int, new: int, zeros: int = 6, rolloff: float = 0.99) -> tuple[np.ndarray, int]:
    """Windowed-sinc filters of the ``new`` phases of a reduced ratio, and how far they reach before a sample.

    Output n lies at old * n / new input samples. The filter is a sinc cut off at
    ``rolloff`` times the lower Nyquist frequency, under a Hann window of ``zeros``
    zero crossings a side.
    """
    band = min(old, new) * rolloff
    reach = math.ceil(zeros * old / band)
    at = np.arange(-reach, reach + old)[None, :] / old - np.arange(new)[:, None] / new
    t = at * band
    return np.where(abs(t) < zeros, np.sinc(t) * np.cos(np.pi * t / (2 * zeros)) ** 2, 0.0) * (band / old), reach


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """A signal at another rate; every output is a dot product over the few inputs around it."""
    shared = math.gcd(rate, to)
    old, new = rate // shared, to // shared
    if old == new or not len(x):
        return x
    filters, reach = sinc_filters(old, new)
    taps, blocks = filters.shape[1], -(-len(x) // old)
    padded = np.zeros(blocks * old + taps)
    padded[reach : reach + len(x)] = x
    views = np.lib.stride_tricks.sliding_window_view(padded, taps)[::old][:blocks]
    return (views @ filters.T).ravel()[: -(-len(x) * new // old)]


def resample(samples: Column, rate: int, to: int) -> Column:
    """Samples at another rate by a polyphase filter; ceil(n * to / rate) of them.

    Runs on Arrow batches. Null stays null, empty stays empty.
    """

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda a: None if a is None else resampled(np.asarray(a, dtype=float), rate, to))

    return run(samples)
