"""Training windows over conversations, and the words inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(convs: DataFrame, length_ms: int, skip: int = 0, step: int = 1) -> DataFrame:
    """Windows 0, d, 2d, .. that begin before the end; the last may be padded.

    With ``step`` readers each takes every ``step``-th window after the first ``skip``.
    """
    if (skip, step) != (0, 1):
        return tumbling(convs, length_ms).filter((F.col("window") >= skip) & ((F.col("window") - skip) % step == 0))
    n = F.greatest(F.ceil(F.col("duration_ms") / length_ms).cast("int"), F.lit(0))
    k = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return convs.select("conv_id", "duration_ms", F.explode(k).alias("window")).withColumn("start_ms", F.col("window").cast("long") * length_ms)


def hopping(convs: DataFrame, length_ms: int, overlap_ms: int) -> DataFrame:
    """Overlapping chunks and the part of each that stitching keeps."""
    stride = length_ms - overlap_ms
    n = F.greatest(F.ceil((F.col("duration_ms") - overlap_ms) / stride).cast("int"), F.lit(1))
    c = convs.select("conv_id", "duration_ms", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    start = F.col("chunk").cast("long") * stride
    end = F.least(start + length_ms, F.col("duration_ms"))
    half = overlap_ms // 2
    trim = F.least(F.lit(half), ((end - start) / 4).cast("long"))
    keep_from = F.when(F.col("chunk") == 0, start).otherwise(start + trim)
    keep_to = F.when(F.col("chunk") == F.col("n") - 1, end).otherwise(end - trim)
    return c.select("conv_id", "chunk", start.alias("start_ms"), end.alias("end_ms"), keep_from.alias("keep_from"), keep_to.alias("keep_to"))


def words_in_windows(words: DataFrame, length_ms: int) -> DataFrame:
    """Words with the window of their start, and times from its start.

    The window is arithmetic on the start, so no range join is needed; a word
    whose tail spills over stays with the window of its start.
    """
    w = words.withColumn("window", F.expr(f"cast(w_start_ms div {length_ms} as int)"))
    base = F.col("window").cast("long") * length_ms
    return w.withColumn("rel_start_ms", F.col("w_start_ms") - base).withColumn("rel_end_ms", F.col("w_end_ms") - base)


def window_statistics(placed: DataFrame, roles: DataFrame) -> DataFrame:
    """Words and speech of main and other speakers in every window.

    A word counts as one at least, its duration as 0 at least.
    """
    w = placed.join(roles.select("conv_id", "speaker", "role"), ["conv_id", "speaker"])
    main, d = F.col("role") == "main", F.greatest(F.col("w_end_ms") - F.col("w_start_ms"), F.lit(0))
    n = F.greatest(F.size(F.filter(F.split(F.trim("word"), r"\s+"), lambda x: x != "")), F.lit(1))
    out = w.groupBy("conv_id", "window").agg(
        F.sum(F.when(main, n).otherwise(0)).alias("main_words"),
        F.sum(F.when(main, 0).otherwise(n)).alias("user_words"),
        F.sum(F.when(main, d).otherwise(0)).alias("main_ms"),
        F.sum(F.when(main, 0).otherwise(d)).alias("user_ms"),
    )
    both = F.col("main_ms") + F.col("user_ms")
    return out.withColumn("main_ratio", F.when(both > 0, F.round(F.col("main_ms") / both, 6)).otherwise(0.0))
