"""Speaker roles and turn-taking of conversations.

Utterances are rows (conv_id, speaker, start_ms, end_ms, dur_ms, text, pos);
``pos`` is their stable order by start within the conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def speaker_totals(utts: DataFrame) -> DataFrame:
    """Speech, turns and first place of every speaker of a conversation."""
    return utts.groupBy("conv_id", "speaker").agg(F.sum("dur_ms").alias("total_ms"), F.count("*").alias("turns"), F.min("pos").alias("first_pos"))


def hybrid_scores(totals: DataFrame, duration_weight: float = 0.6, turn_weight: float = 0.4) -> DataFrame:
    """Weighted shares of speech and turns; 0 where either total is."""
    conv = Window.partitionBy("conv_id")
    d, t = F.sum("total_ms").over(conv), F.sum("turns").over(conv)
    score = duration_weight * F.col("total_ms") / d + turn_weight * F.col("turns") / t
    return totals.withColumn("score", F.when((d > 0) & (t > 0), score).otherwise(0.0))


def rank_speakers(scored: DataFrame) -> DataFrame:
    """Rank by score, ties by first appearance; the first is main, others user."""
    order = Window.partitionBy("conv_id").orderBy(F.round("score", 12).desc(), "first_pos")
    return scored.withColumn("rank", F.row_number().over(order)).withColumn("role", F.when(F.col("rank") == 1, "main").otherwise("user"))


def sort_speakers(totals: DataFrame, by: str = "total_ms") -> DataFrame:
    if by not in ("total_ms", "turns"):
        raise ValueError(f"speakers can't be sorted by {by!r}")
    return totals.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col(by).desc(), "first_pos")))


def assign_roles(utts: DataFrame) -> DataFrame:
    return rank_speakers(hybrid_scores(speaker_totals(utts)))


def role_totals(roles: DataFrame) -> DataFrame:
    """One row a conversation: main speaker and sums by role."""
    main = F.col("role") == "main"
    return roles.groupBy("conv_id").agg(
        F.max(F.when(main, F.col("speaker"))).alias("main_speaker"),
        F.round(F.max(F.when(main, F.col("score"))), 4).alias("main_score"),
        F.round(F.sum(F.when(main, 0.0).otherwise(F.col("score"))), 4).alias("user_score"),
        F.sum(F.when(main, F.col("total_ms")).otherwise(0)).alias("main_ms"),
        F.sum(F.when(main, 0).otherwise(F.col("total_ms"))).alias("user_ms"),
        F.count("*").alias("num_speakers"),
    )


def with_roles(utts: DataFrame, roles: DataFrame) -> DataFrame:
    return utts.join(roles.select("conv_id", "speaker", "role"), ["conv_id", "speaker"])


def conversation_totals(utts: DataFrame) -> DataFrame:
    return utts.groupBy("conv_id").agg(F.max("end_ms").alias("duration_ms"), F.count("*").alias("n_turns"), F.count_distinct("speaker").alias("num_speakers"))


def validate(convs: DataFrame, shortest: float = 10.0, longest: float = 7200.0, turns: int = 2, speakers: int = 1) -> DataFrame:
    """First failing rule as ``reason`` and the outcome it means."""
    d = F.col("duration_ms") / 1000.0
    reason = (
        F.when(d < shortest, F.format_string(f"Too short: %.1fs < {shortest}s", d))
        .when(d > longest, F.format_string(f"Too long: %.1fs > {longest}s", d))
        .when(F.col("n_turns") < turns, F.format_string(f"Too few turns: %d < {turns}", "n_turns"))
        .when(F.col("num_speakers") < speakers, F.lit("No speakers found"))
    )
    outcome = F.when(F.col("reason").isNull(), "valid").when(F.col("reason").rlike("Too (short|long|few)"), "skipped").otherwise("failed")
    return convs.withColumn("reason", reason).withColumn("outcome", outcome)


def by_time_slot(rows: DataFrame, slot_ms: int, name: str = "slot") -> DataFrame:
    """A row for each slot of time that an interval touches."""
    first, last = (F.floor(F.col(c) / slot_ms) for c in ("start_ms", "end_ms"))
    return rows.withColumn(name, F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_pairs(utts: DataFrame, slot_ms: int = 60_000) -> DataFrame:
    """Overlapping pairs of utterances of different speakers, first before second.

    Joined on conversation and slot of time, so a conversation of any length
    costs in proportion to its overlaps; a pair counts in the slot where its
    overlap begins.
    """
    cols = ["conv_id", "pos", "speaker", "start_ms", "end_ms"]
    slots = by_time_slot(utts.select(cols), slot_ms)
    a, b = slots.alias("a"), slots.alias("b")
    start, end = F.greatest("a.start_ms", "b.start_ms"), F.least("a.end_ms", "b.end_ms")
    on = (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.slot") == F.col("b.slot")) & (F.col("a.pos") < F.col("b.pos")) & (F.col("b.start_ms") < F.col("a.end_ms")) & (F.col("a.speaker") != F.col("b.speaker"))
    out = a.join(b, on & (F.floor(start / slot_ms) == F.col("a.slot"))).select(F.col("a.conv_id").alias("conv_id"), F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), start.alias("start_ms"), end.alias("end_ms"))
    return out.filter("end_ms > start_ms").withColumn("overlap_ms", F.col("end_ms") - F.col("start_ms"))


def overlap_summary(pairs: DataFrame, regions: int = 10) -> DataFrame:
    """Sum, number and first regions of a conversation's overlaps."""
    rows = F.array_sort(F.collect_list(F.struct("pos_a", "pos_b", "start_ms", "end_ms")))
    return pairs.groupBy("conv_id").agg(F.sum("overlap_ms").alias("overlap_ms"), F.count("*").alias("n_overlaps"), F.slice(rows, 1, regions).alias("regions"))


def turn_statistics(utts: DataFrame) -> DataFrame:
    """Turns, their mean length, changes of speaker, changes a minute."""
    changed = utts.withColumn("changed", F.col("speaker") != F.lag("speaker").over(Window.partitionBy("conv_id").orderBy("pos")))
    out = changed.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.round(F.avg("dur_ms") / 1000.0, 3).alias("mean_turn"), F.count_if("changed").alias("transitions"), F.max("end_ms").alias("duration_ms"))
    return out.withColumn("per_minute", F.round(F.col("transitions") / F.greatest(F.col("duration_ms") / 60000.0, F.lit(0.001)), 2))


def diarization_document(utts: DataFrame) -> DataFrame:
    """One JSON document a conversation: ranked speakers, overlap, turns."""
    roles = assign_roles(utts)
    speakers = roles.groupBy("conv_id").agg(F.count("*").alias("num_speakers"), F.array_sort(F.collect_list(F.struct("rank", "speaker", "role", F.round("score", 4).alias("score"), "total_ms", "turns"))).alias("speakers"))
    pairs = overlap_summary(overlap_pairs(utts)).select("conv_id", "overlap_ms", "n_overlaps", "regions")
    joined = speakers.join(pairs, "conv_id", "left").join(turn_statistics(utts), "conv_id")
    ratio = F.round(F.coalesce("overlap_ms", F.lit(0)) / F.greatest("duration_ms", F.lit(1)), 4)
    return joined.select("conv_id", F.to_json(F.struct("num_speakers", "speakers", ratio.alias("overlap_ratio"), "n_turns", "mean_turn", "transitions", "per_minute")).alias("document"))


def role_utterances(utts: DataFrame, roles: DataFrame) -> DataFrame:
    """Role-tagged utterances in order of start, with a header of speakers by role."""
    tagged = with_roles(utts, roles)
    names = roles.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == "user", F.col("speaker")))), ",").alias("user_speakers"))
    rows = tagged.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "pos", "role", "speaker", "text"))).alias("segments"))
    return rows.join(names, "conv_id")
