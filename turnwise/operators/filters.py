"""Predicates and the layered cascade over training windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.text import seeded_share

#: Spellings of a speaker that isn't known. Fixed values.
UNKNOWN_SPEAKERS = ["?", "", "unknown", "n/a", "none", "null", "-", "speaker_unknown", "unidentified"]


def is_unknown(speaker: str = "speaker") -> Column:
    return F.coalesce(F.lower(F.trim(F.col(speaker))).isin(UNKNOWN_SPEAKERS), F.lit(True))


def normalize_speaker(speaker: str = "speaker", longest: int = 100) -> Column:
    return F.when(is_unknown(speaker), "UNKNOWN_SPEAKER").otherwise(F.substring(F.trim(F.col(speaker)), 1, longest))


def timestamp_error(start: str, end: str, longest: float = 3600.0) -> Column:
    """First error of a pair of time texts, null if there is none."""
    s, e = (F.expr(f"try_cast({c} AS double)") for c in (start, end))
    return (
        F.when(F.col(start).isNull() | F.col(end).isNull(), "missing_value")
        .when(s.isNull() | e.isNull(), "invalid_type")
        .when((s < 0) | (e < 0), "negative_value")
        .when(s > e, "start_after_end")
        .when(e - s > longest, "too_long")
    )


def good_words(words: DataFrame, least: float = 0.5, longest_ms: int = 3000, default: float = 1.0) -> DataFrame:
    """Words confident enough with a duration in (0, longest]; no confidence counts as ``default``."""
    d = F.col("w_end_ms") - F.col("w_start_ms")
    return words.filter((F.coalesce("confidence", F.lit(default)) >= least) & (d > 0) & (d <= longest_ms))


def main_only(words: DataFrame) -> DataFrame:
    return words.filter((F.col("role") == "main") & (F.col("w_end_ms") > F.col("w_start_ms")))


def delayed(words: DataFrame, delay_ms: int) -> DataFrame:
    """Times moved forward by the delay; what ends before it goes."""
    kept = words.filter(F.col("w_end_ms") > delay_ms)
    return kept.withColumn("w_start_ms", F.greatest(F.col("w_start_ms") - delay_ms, F.lit(0))).withColumn("w_end_ms", F.col("w_end_ms") - delay_ms)


def frame_bounds(words: DataFrame, rate: float) -> DataFrame:
    """Frames [start, end) of words; empty ones go."""
    at = lambda c: (F.col(c) / 1000.0 * rate).cast("int")
    return words.withColumn("f0", at("w_start_ms")).withColumn("f1", at("w_end_ms")).filter("f1 > f0")


def case_number(main_audio: Column, main_text: Column, user_audio: Column) -> Column:
    """Which of the cases of presence a window is; 0 is never allowed."""
    one_side = F.when(main_audio & main_text & ~user_audio, 2).when(~main_audio & ~main_text & user_audio, 3)
    return F.when(main_audio & main_text & user_audio, 1).otherwise(one_side.when(~main_audio & main_text & user_audio, 4).when(main_audio & ~main_text, 5).otherwise(0))


def case_control(stats: DataFrame, allowed: tuple[int, ...] = (1, 2)) -> DataFrame:
    case = case_number(F.col("main_ms") > 0, F.col("main_words") > 0, F.col("user_ms") > 0)
    return stats.withColumn("case", case).withColumn("case_ok", F.col("case").isin(*(c for c in allowed if c > 0)))


def quality_reason(min_words: int = 3, min_ms: int = 3000, min_ratio: float = 0.1, min_user_words: int = 0, min_segment_ms: int = 10_000, max_segment_ms: int | None = None) -> Column:
    """First hard minimum that a window misses."""
    speech = F.col("main_ms") + F.col("user_ms")
    out = (
        F.when(F.col("main_ms") <= 0, "no_main_speech")
        .when(F.col("main_words") < min_words, "few_words")
        .when(F.col("main_ms") < min_ms, "short_speech")
        .when((F.lit(min_ratio) > 0) & (speech > 0) & (F.col("main_ratio") < min_ratio), "low_ratio")
        .when(F.col("user_words") < min_user_words, "few_user_words")
        .when(F.col("segment_ms") < min_segment_ms, "short_segment")
    )
    return out.when(F.col("segment_ms") > max_segment_ms, "long_segment") if max_segment_ms else out


def preference_reason(seed: int, single_p: float = 0.0, user_first_p: float = 0.7) -> Column:
    """Seeded skips of one-speaker windows and of windows the user begins."""
    u, v = seeded_share(seed, "conv_id", "window"), seeded_share(seed + 1, "conv_id", "window")
    return F.when((F.col("user_words") == 0) & (u < single_p), "single_speaker").when(F.col("user_first") & (v < user_first_p), "user_first")


def cascade(stats: DataFrame, allowed: tuple[int, ...] = (1, 2), preferences: Column | None = None, **minima) -> DataFrame:
    """Each window's first layer that rejects it, and the reason."""
    out = case_control(stats, allowed).withColumn("quality", quality_reason(**minima))
    out = out.withColumn("preference", F.lit(None).cast("string") if preferences is None else preferences)
    layer = F.when(~F.col("case_ok"), "case").when(F.col("quality").isNotNull(), "quality").when(F.col("preference").isNotNull(), "preference").otherwise("kept")
    reason = F.when(~F.col("case_ok"), F.format_string("case_%d", "case")).otherwise(F.coalesce("quality", "preference"))
    return out.withColumn("layer", layer).withColumn("reason", reason)


def cascade_counts(decided: DataFrame) -> DataFrame:
    """Counters and rates of the cascade, one row."""
    n = F.count("*")
    rate = lambda c: F.round(F.coalesce(F.try_divide(c.cast("double"), n.cast("double")), F.lit(0.0)), 6)
    count = {k: F.count_if(F.col("layer") == k) for k in ("case", "quality", "preference", "kept")}
    return decided.agg(n.alias("total"), *(c.alias(f"n_{k}") for k, c in count.items()), rate(count["kept"]).alias("keep_rate"), rate(n - count["kept"]).alias("skip_rate"))


def with_role_swap(kept: DataFrame, allowed: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Every window and, where its case is allowed, itself with roles swapped."""
    both = kept.withColumn("swapped", F.explode(F.array(F.lit(False), F.lit(True))))
    flip = lambda a, b: F.when(F.col("swapped"), F.col(b)).otherwise(F.col(a))
    names = {"main_words": "user_words", "user_words": "main_words", "main_ms": "user_ms", "user_ms": "main_ms"}
    out = both.select("conv_id", "window", "swapped", *(flip(a, b).alias(a) for a, b in names.items()))
    total = F.col("main_ms") + F.col("user_ms")
    out = out.withColumn("main_ratio", F.when(total > 0, F.round(F.col("main_ms") / total, 6)).otherwise(0.0))
    return case_control(out, allowed).filter(~F.col("swapped") | F.col("case_ok")).drop("case_ok")


def first_speaker_is_user(placed: DataFrame, roles: DataFrame) -> DataFrame:
    """Per window whether its first word is a user's."""
    w = placed.join(roles.select("conv_id", "speaker", "role"), ["conv_id", "speaker"])
    return w.groupBy("conv_id", "window").agg((F.min_by("role", F.struct("w_start_ms", "turn", "k")) == "user").alias("user_first"))


def audio_error(samples: str = "samples", rate: int = 24_000, channels: Column | None = None, expected: int = 1) -> Column:
    """First reason why an array of samples is no usable audio."""
    a = F.col(samples)
    n = F.lit(expected) if channels is None else channels
    return F.when(a.isNull(), "null").when(F.size(a) == 0, "empty").when(n != expected, "channels").when(F.forall(a, lambda x: F.abs(x) < 1e-10), "silent").when(F.size(a) < 0.1 * rate, "short")


def skip_existing(paths: DataFrame, done: DataFrame, failed: DataFrame, retry: bool = False, least: int = 1000) -> DataFrame:
    """Paths still to do: no output, no error mark (unless retried), large enough."""
    out = paths.join(done, "path", "left_anti").filter(F.col("size") >= least)
    return out if retry else out.join(failed, "path", "left_anti")


def speaker_changes(words: DataFrame) -> DataFrame:
    """Marks where the main speaker begins (bos) and where others take over (eos)."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("w_start_ms", "turn", "k"))
    main = F.col("role") == "main"
    return words.withColumn("mark", F.when(main & (before.isNull() | (before != "main")), "bos").when(~main & (before == "main"), "eos"))
