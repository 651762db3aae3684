"""Mixing and sampling of text corpora by seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.text import seeded_share


def sample_exact(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """min(n, rows) rows of the least md5(seed:key): uniform, without replacement."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def shuffle(rows: DataFrame, key: str, seed: int) -> DataFrame:
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)


def mix(native: DataFrame, english: DataFrame, key: str, total: int, native_ratio: float, switched_ratio: float, seed: int = 42) -> DataFrame:
    """int(total * ratio) rows each: first native, sampled English, next native."""
    n = {"native": int(total * native_ratio), "switched": int(total * switched_ratio)}
    n["english"] = total - n["native"] - n["switched"]
    first = native.orderBy(key).limit(n["native"] + n["switched"])  # the sizes asked for
    w = Window.orderBy(key)
    ranked = first.withColumn("_r", F.row_number().over(w))
    part = F.when(F.col("_r") <= n["native"], "native").otherwise("switched")
    return ranked.withColumn("part", part).drop("_r").unionByName(sample_exact(english, key, n["english"], seed).withColumn("part", F.lit("english")))


def weighted_order(sources: DataFrame, weight: str, key: str, seed: int) -> DataFrame:
    """Rows with ``draw``, an order in which sources interleave by weight.

    Exponential keys -ln(u) / w: the least key is from a source with a
    probability in proportion to its weight.
    """
    u = (seeded_share(seed, key) * F.lit(2.0**32) + 0.5) / F.lit(2.0**32)
    return sources.withColumn("draw", -F.log(u) / F.col(weight))


def mix_statistics(mixed: DataFrame, ratio: Column, turns: Column) -> DataFrame:
    """Dialogues by language share and their turns."""
    return mixed.agg(F.count("*").alias("n"), F.count_if(ratio == 0).alias("native_only"), F.count_if(ratio == 1).alias("english_only"), F.count_if((ratio > 0) & (ratio < 1)).alias("switched"), F.sum(turns).cast("long").alias("turns"), F.round(F.avg(turns), 6).alias("mean_turns"))


def alternate_speakers(turns: DataFrame, first: str = "main", second: str = "user", swap: Column | None = None) -> DataFrame:
    """Speakers by parity of ``pos``, swapped where ``swap`` holds."""
    odd = (F.col("pos") % 2 == 1) if swap is None else ((F.col("pos") % 2 == 1) != swap)
    return turns.withColumn("speaker", F.when(odd, second).otherwise(first))


def stratified(rows: DataFrame, stratum: str, key: str, ratios: dict[str, float], seed: int) -> DataFrame:
    """A share of each stratum by seeded hash."""
    share = F.coalesce(*(F.when(F.col(stratum) == k, F.lit(v)) for k, v in ratios.items()), F.lit(0.0))
    return rows.filter(seeded_share(seed, key) < share)


def weighted_pick(rows: DataFrame, weight: str, key: str, seed: int) -> DataFrame:
    """One row a key value, with probability in proportion to its weight."""
    u = (seeded_share(seed, key, "item") * F.lit(2.0**32) + 0.5) / F.lit(2.0**32)
    r = F.row_number().over(Window.partitionBy(key).orderBy(-F.log(u) / F.col(weight), "item"))
    return rows.withColumn("_r", r).filter("_r = 1").drop("_r")


def weighted_start(regions: DataFrame, keys: list[str], length: int, seed: int) -> DataFrame:
    """(keys, start): where a clip of ``length`` starts, all places in the regions (keys, start, end) alike.

    A region has end - start - length steps to start after its first place, so it is
    chosen in proportion to its length. Without any such step the first region's
    start stands.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    room = regions.select(*keys, "start", "end").withColumn("_n", F.greatest(F.col("end") - F.col("start") - length, F.lit(0)))
    room = room.withColumn("_to", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    at = F.floor(seeded_share(seed, *keys) * (F.col("_all") + 1))
    room = room.withColumn("_at", at).filter((F.col("_to") >= F.col("_at")) | (F.col("_all") <= 0))
    first = room.groupBy(*keys).agg(F.min_by(F.struct("start", "_n", "_to", "_at", "_all"), F.struct("start", "end")).alias("r"))
    return first.select(*keys, F.when(F.col("r._all") <= 0, F.col("r.start")).otherwise(F.col("r.start") + F.col("r._at") - (F.col("r._to") - F.col("r._n"))).cast("long").alias("start"))
