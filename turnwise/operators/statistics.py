"""Run statistics of the pipelines: counters, merges, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phase_statistics(outcomes: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Outcome counters, hours by role, bytes and speed of a run, one row.

    Sums and counts merge by addition, so partial runs combine by ``merge``.
    """
    ok = F.col("outcome") == "valid"
    hours = lambda c: F.round(F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)) / 3_600_000.0, 4)
    out = outcomes.agg(F.count("*").alias("total"), F.count_if(ok).alias("processed"), F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count_if(F.col("outcome") == "failed").alias("failed"), hours("duration_ms").alias("hours"), hours("main_ms").alias("main_hours"), hours("user_ms").alias("user_hours"))
    return out.withColumn("seconds", F.lit(float(seconds))).withColumn("speed", F.round(F.col("hours") * 3600 / F.greatest("seconds", F.lit(1.0)), 4))


def merge(parts: DataFrame) -> DataFrame:
    """Statistics of parallel runs: sums, but the longest time."""
    sums = [c for c in parts.columns if c not in ("seconds", "speed")]
    out = parts.agg(*(F.sum(c).alias(c) for c in sums), F.max("seconds").alias("seconds"))
    return out.withColumn("speed", F.round(F.col("hours") * 3600 / F.greatest("seconds", F.lit(1.0)), 4))


def alignment_statistics(results: DataFrame) -> DataFrame:
    """Counts and mean quality of aligned conversations."""
    return results.agg(F.count("*").alias("n"), F.count_if("aligned").alias("aligned"), F.sum("words").alias("words"), F.round(F.avg(F.when(F.col("aligned"), F.col("quality"))), 6).alias("mean_quality"))


def migration_statistics(matched: DataFrame) -> DataFrame:
    """Files and segments by level of match, rates and speakers a file, one row.

    ``matched`` has conv_id, level (null: no match), matched_speaker and, where it
    is known, ``speaker`` as it was: a match that differs from it is an update.
    """
    was = F.col("speaker") if "speaker" in matched.columns else F.lit(None).cast("string")
    hit, changed = F.col("level").isNotNull(), F.col("level").isNotNull() & ~F.col("matched_speaker").eqNullSafe(was)
    levels = [F.count_if(F.col("level") == k).alias(f"l{k}") for k in (1, 2, 3)]
    per = matched.groupBy("conv_id").agg(F.count_distinct("matched_speaker").alias("s"), F.count("*").alias("n"), *levels, F.count_if(hit).alias("hit"), F.count_if(changed).alias("updated"), F.count_if(hit & F.col("matched_speaker").isNull()).alias("unnamed"))
    out = per.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("updated") > 0).alias("files_updated"),
        F.count_if(F.col("hit") == F.col("n")).alias("files_whole"),
        F.count_if(F.col("hit") == 0).alias("files_unmatched"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("segments"),
        *(F.coalesce(F.sum(f"l{k}"), F.lit(0)).alias(name) for k, name in ((1, "exact"), (2, "near"), (3, "far"))),
        F.coalesce(F.sum(F.col("n") - F.col("hit")), F.lit(0)).alias("unmatched"),
        F.coalesce(F.sum("updated"), F.lit(0)).alias("updated"),
        F.coalesce(F.sum("unnamed"), F.lit(0)).alias("unnamed"),
        F.coalesce(F.max("s"), F.lit(0)).alias("max_speakers"),
        F.count_if(F.col("s") > 1).alias("multi_speaker"),
    )
    share = lambda x, empty: F.when(F.col("segments") > 0, F.round(100 * x / F.col("segments"), 4)).otherwise(empty)
    return out.withColumn("match_rate", share(F.col("segments") - F.col("unmatched"), 100.0)).withColumn("update_rate", share(F.col("updated"), 0.0))


def overflow_statistics(layout: DataFrame) -> DataFrame:
    """How many windows have more tokens than frames, and how many tokens that loses."""
    over = F.greatest(F.col("n_tokens") - F.col("n_frames"), F.lit(0))
    return layout.agg(F.count("*").alias("windows"), F.count_if(over > 0).alias("overflowing"), F.sum(over).alias("lost_tokens"), F.max(over).alias("most_lost"))


def training_columns(log: DataFrame) -> DataFrame:
    """Derived columns of a training log: real-token share, percent done, GB."""
    return log.withColumn("real_share", F.col("real_tokens") / F.greatest("tokens", F.lit(1))).withColumn("percent_done", 100.0 * F.col("step") / F.greatest("max_steps", F.lit(1))).withColumn("gb", F.col("bytes") / F.lit(1024.0**3))


def two_speaker_loss(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Losses by speaker and kind over their tokens, and their weighted sum."""
    per = rows.groupBy("speaker", "kind").agg((F.sum("loss") / F.greatest(F.count("*"), F.lit(1))).alias("mean"))
    w = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in weights.items()), F.lit(0.0))
    return per.groupBy("speaker").agg(F.sum(w * F.col("mean")).alias("loss"))


def speaker_word_statistics(words: DataFrame) -> DataFrame:
    """Words and speech of each original speaker, its first role and channel."""
    name = F.coalesce(F.nullif("original", F.lit("")), F.col("role"))
    d = F.col("w_end_ms") - F.col("w_start_ms")
    return words.groupBy("conv_id", name.alias("speaker")).agg(F.count("*").alias("n_words"), F.sum(d).alias("speech_ms"), F.min_by("role", F.struct("w_start_ms", "turn", "k")).alias("first_role"))


def monitor_summary(rows: DataFrame) -> DataFrame:
    """Mean precision and recall of matches and the F1 of these means."""
    p, r = F.avg("precision"), F.avg("recall")
    return rows.agg(p.alias("p"), r.alias("r")).select(F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0), 6).alias("f1"))


def segment_error(main_ms: Column, start: Column, end: Column, text: Column) -> Column:
    """First reason why a segment can't be aligned."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "no_text").when(end <= start, "no_time").when(start < 0, "negative").when(end > main_ms, "beyond_audio")


def duplicate_report(rows: DataFrame, key: str, longest: int = 5) -> DataFrame:
    """Number of repeated keys and the first of them in order."""
    twice = rows.groupBy(key).count().filter("count > 1")
    top = twice.orderBy(F.col("count").desc(), key).limit(longest)  # a report
    n = twice.agg(F.count("*").alias("duplicates"))
    return n.join(F.broadcast(top.agg(F.array_sort(F.collect_list(key)).alias("examples"))))  # one row each
