"""Sinks: documents, manifests, alignments, metric logs, audio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_manifest(rows: DataFrame, path: str, append: bool = False, by_machine: bool = False) -> None:
    """JSON lines, null fields left out; a job's files appear together or not at all."""
    out = rows.write.mode("append" if append else "overwrite")
    (out.partitionBy("machine_id") if by_machine else out).json(path)


def basic_entry() -> Column:
    """The basic form of a manifest entry: two alignments, duration in milliseconds' precision, speakers."""
    return F.struct("audio", "alignment_speaker01", "alignment_speaker02", F.round("duration", 3).alias("duration"), F.coalesce("speakers", F.lit(2)).alias("speakers"))


def extended_entry() -> Column:
    """The basic form with the conversation and, where there are any, the combined and the extended alignment."""
    known = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return F.struct("audio", "alignment_speaker01", "alignment_speaker02", F.round("duration", 3).alias("duration"), F.coalesce("speakers", F.lit(2)).alias("speakers"), F.coalesce("conversation_id", F.lit("")).alias("conversation_id"), known("alignment"), known("alignment_extended"))


def write_entries(entries: DataFrame, path: str, extended: bool = False, append: bool = False) -> None:
    """A manifest of entries in one of the two forms, one JSON object a line."""
    write_manifest(entries.select((extended_entry() if extended else basic_entry()).alias("e")).select("e.*"), path, append)


def write_documents(rows: DataFrame, path: str) -> DataFrame:
    """One JSON document a row; returns ids and sizes in bytes."""
    doc = rows.select("conv_id", F.to_json(F.struct(*(c for c in rows.columns if c != "conv_id"))).alias("document"))
    doc.write.mode("overwrite").parquet(path)
    return doc.select("conv_id", F.octet_length("document").alias("bytes"))


def alignment_documents(words: DataFrame) -> DataFrame:
    """``{"alignments": [[word, [start, end], speaker], ...]}`` by start, one a conversation."""
    item = F.concat(F.lit("["), F.to_json(F.struct("word")).substr(F.lit(9), F.length(F.to_json(F.struct("word"))) - 9), F.format_string(",[%s,%s],", F.col("start").cast("string"), F.col("end").cast("string")), F.to_json(F.struct("speaker")).substr(F.lit(12), F.length(F.to_json(F.struct("speaker"))) - 12), F.lit("]"))
    rows = F.array_sort(F.collect_list(F.struct("start", "k", item.alias("item"))))
    joined = F.array_join(F.transform(rows, lambda r: r["item"]), ",")
    return words.groupBy("conv_id").agg(F.concat(F.lit('{"alignments":['), joined, F.lit("]}")).alias("document"))


def extended_documents(words: DataFrame, quality: DataFrame, basic_key: str = "basic") -> DataFrame:
    """Alignment documents of format 2.0 with the speakers' metadata, one a conversation.

    ``words``: conv_id, k, word, start, end, confidence, role (main or user),
    original (the speaker's id before roles, or null), channel, segment.
    ``quality``: conv_id, quality. The plain items also lie under ``basic_key``.
    Speakers are in order of their first word, words in order of start and k.
    """
    name = F.coalesce(F.nullif("original", F.lit("")), F.col("role"))
    at = F.struct("start", "k")
    r3 = lambda c: F.round(c, 3).alias(c)
    per = words.withColumn("_id", name).groupBy("conv_id", "_id").agg(F.min(at).alias("_at"), F.count("*").alias("word_count"), F.round(F.sum(F.col("end") - F.col("start")), 6).alias("total_duration"), F.min_by("role", at).alias("role"), F.min_by("channel", at).alias("channel"))
    stats = F.array_sort(F.collect_list(F.struct("_at", "_id", F.struct("word_count", "total_duration", "role", "channel").alias("s"))))
    known = words.filter(F.coalesce("original", F.lit("")) != "").groupBy("conv_id", "original").agg(F.min(at).alias("_at")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "original"))), lambda x: x["original"]).alias("unique_original_speakers"))
    by = per.groupBy("conv_id").agg(F.map_from_entries(F.transform(stats, lambda x: F.struct(x["_id"], x["s"]))).alias("speaker_statistics"))
    item = F.struct("start", "k", F.struct("word", r3("start"), r3("end"), r3("confidence"), F.col("role").alias("speaker_role"), F.col("original").alias("original_speaker_id"), "channel", F.col("segment").alias("segment_index")).alias("w"))
    main = F.count_if(F.col("role") == "main")
    docs = words.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("_w"), F.count("*").alias("total_words"), main.alias("main_speaker_words"), (F.count("*") - main).alias("user_speaker_words"))
    docs = docs.join(by, "conv_id").join(known, "conv_id", "left").join(alignment_documents(words.withColumn("speaker", F.col("role"))), "conv_id").join(quality, "conv_id", "left")
    meta = F.struct("total_words", "main_speaker_words", "user_speaker_words", F.coalesce("unique_original_speakers", F.array().cast("array<string>")).alias("unique_original_speakers"), "speaker_statistics", F.round("quality", 3).alias("quality_score"))
    head = F.to_json(F.struct(F.col("conv_id").alias("conversation_id"), F.lit("2.0").alias("format_version"), meta.alias("metadata"), F.transform("_w", lambda x: x["w"]).alias("alignments")))
    items = F.col("document").substr(F.lit(len('{"alignments":') + 1), F.length("document"))
    return docs.select("conv_id", F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(f',"{basic_key}":'), items).alias("document"))


def write_metrics(rows: DataFrame, path: str, kind: str = "json") -> None:
    out = rows.write.mode("append")
    out.json(path) if kind == "json" else out.option("header", True).csv(path)


def write_wav(rows: DataFrame, folder: str, rate: int = 24_000) -> DataFrame:
    """PCM-16 WAV bytes of (id, left, right) samples, as rows of path and content."""

    def run(batches):
        import io
        import wave

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            paths, contents = [], []
            for i, left, right in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                both = np.stack([np.asarray(left, float), np.asarray(right, float)], axis=1)
                out = io.BytesIO()
                with wave.open(out, "wb") as w:
                    w.setnchannels(2)
                    w.setsampwidth(2)
                    w.setframerate(rate)
                    w.writeframes((np.clip(both, -1, 1) * 32767).astype("<i2").tobytes())
                paths.append(f"{folder}/{i}.wav")
                contents.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], ["path", "content"])

    return rows.select("id", "left", "right").mapInArrow(run, "path string, content binary")
