"""Text corpora of dialogues as (dialogue_id, pos, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.stored import stored


def _turns(rows: DataFrame, turns: str = "turns") -> DataFrame:
    """Trimmed turns that aren't blank, of dialogues with two at least."""
    t = F.filter(F.transform(turns, lambda x: F.trim(x)), lambda x: x != "")
    good = rows.withColumn("_t", t).filter(F.size("_t") >= 2)
    return good.select("dialogue_id", F.posexplode("_t").alias("pos", "text"))


def end_marked(spark: SparkSession, path: str) -> DataFrame:
    """A dialogue a line, turns closed by ``__eou__``."""
    return _turns(spark.read.text(path).select(F.monotonically_increasing_id().alias("dialogue_id"), F.split("value", "__eou__").alias("turns")))


def csv_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of lines with one conv_id are dialogues; empty utterances go.

    A file may have any number of splits: runs are numbered within each, and one row
    a split says with which run it goes on and how many runs lie before it.
    """
    rows = spark.read.option("header", True).csv(path).select("conv_id", "utterance", F.monotonically_increasing_id().alias("_n"), F.input_file_name().alias("_f"))
    rows = stored(rows.withColumn("_p", F.shiftright("_n", 33)))
    w = Window.partitionBy("_f", "_p").orderBy("_n")
    inner = F.coalesce(~F.lag("conv_id").over(w).eqNullSafe(F.col("conv_id")), F.lit(False)) & (F.row_number().over(w) > 1)
    rows = rows.withColumn("_run", F.sum(inner.cast("int")).over(w))
    splits = rows.groupBy("_f", "_p").agg(F.min_by("conv_id", "_n").alias("first"), F.max_by("conv_id", "_n").alias("last"), F.max("_run").alias("_more"))
    by = Window.partitionBy("_f").orderBy("_p")  # a row a split
    new = ((F.row_number().over(by) == 1) | ~F.lag("last").over(by).eqNullSafe(F.col("first"))).cast("int")
    splits = splits.withColumn("_new", new).withColumn("_base", F.sum(F.col("_new") + F.col("_more")).over(by) - F.col("_more"))
    rows = rows.join(splits.select("_f", "_p", "_base"), ["_f", "_p"]).withColumn("_run", F.col("_base") + F.col("_run"))
    said = rows.filter(F.trim(F.coalesce("utterance", F.lit(""))) != "")
    g = said.groupBy("_f", "_run").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "utterance"))), lambda x: x["utterance"]).alias("turns"))
    return _turns(g.withColumn("dialogue_id", F.xxhash64("_f", "_run")))


def json_array(spark: SparkSession, path: str, field: str = "utterances") -> DataFrame:
    """One JSON array of dialogues in a file."""
    rows = spark.read.option("multiLine", True).schema(f"{field} ARRAY<STRING>").json(path)
    return _turns(rows.withColumn("dialogue_id", F.monotonically_increasing_id()), field)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``turns`` of speaker, text and language."""
    rows = spark.read.schema("turns ARRAY<STRUCT<speaker: STRING, text: STRING, language: STRING>>").json(path).filter("turns IS NOT NULL")
    rows = rows.withColumn("dialogue_id", F.monotonically_increasing_id())
    return rows.select("dialogue_id", F.posexplode("turns").alias("pos", "t")).select("dialogue_id", "pos", "t.*")


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return {"lines": end_marked, "csv": csv_runs, "array": json_array, "jsonl": json_lines}[kind](spark, path)
