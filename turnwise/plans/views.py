"""Canonical dialogue views over the driver tables, times in whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns laid out in time; ``pos`` is their stable order by start."""
    t = read(spark, sf_dir, "conversations")
    gap = F.when(F.col("turn") == 0, 0).otherwise(100 * ((F.col("conv_id") * 7 + F.col("turn") * 13) % 11) - 300)
    t = t.select("conv_id", "turn", F.col("role").alias("speaker"), "text", (200 + 40 * F.length("text")).cast("long").alias("dur_ms"), gap.cast("long").alias("gap_ms"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    t = t.withColumn("end_ms", F.sum(F.col("dur_ms") + F.col("gap_ms")).over(order)).withColumn("start_ms", F.col("end_ms") - F.col("dur_ms"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("start_ms", "turn")) - 1
    return t.withColumn("pos", pos.cast("long")).drop("gap_ms")


def words(utts: DataFrame) -> DataFrame:
    """Words of every turn, its time dealt evenly over them."""
    from turnwise.functions.text import word_array

    w = utts.withColumn("w", word_array("text")).withColumn("n", F.size("w").cast("long"))
    w = w.select("conv_id", "turn", "speaker", "start_ms", "dur_ms", "n", F.posexplode("w").alias("k", "word"))
    at = lambda k: F.col("start_ms") + F.expr(f"(dur_ms * ({k})) div n")
    return w.select("conv_id", "turn", "speaker", F.col("k").cast("long").alias("k"), "word", at("k").alias("w_start_ms"), at("k + 1").alias("w_end_ms"))


#: The same views for the oracle, as common table expressions.
UTTERANCES_SQL = """
u0 AS (SELECT conv_id, turn, role AS speaker, text, CAST(200 + 40 * length(text) AS BIGINT) AS dur_ms,
         CASE WHEN turn = 0 THEN 0 ELSE 100 * ((conv_id * 7 + turn * 13) % 11) - 300 END AS gap_ms FROM conversations),
u1 AS (SELECT *, CAST(sum(dur_ms + gap_ms) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end_ms FROM u0),
u2 AS (SELECT conv_id, turn, speaker, text, dur_ms, end_ms, end_ms - dur_ms AS start_ms FROM u1),
utterances AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, turn) - 1 AS pos FROM u2)"""
WORDS_SQL = (
    UTTERANCES_SQL
    + """,
w0 AS (SELECT conv_id, turn, speaker, start_ms, dur_ms, list_filter(string_split(regexp_replace(trim(text, ' \t\r\n'), '[ \t\r\n]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM utterances),
w1 AS (SELECT *, len(w) AS n, unnest(range(len(w))) AS k FROM w0),
words AS (SELECT conv_id, turn, speaker, k, w[k + 1] AS word, start_ms + (dur_ms * k) // n AS w_start_ms, start_ms + (dur_ms * (k + 1)) // n AS w_end_ms FROM w1)"""
)
