"""Manifests in their several dialects, metadata documents, alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators.manifest import any_path

MANIFEST = (
    "conversation_id STRING, path STRING, audio STRING, audio_path STRING, metadata_path STRING, segment_alignment STRING, "
    "alignment STRING, alignment_extended STRING, alignment_speaker01 STRING, alignment_speaker02 STRING, duration DOUBLE, speakers INT, num_speakers INT"
)


def read_manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """Entries of JSON-lines manifests (plain or gzipped) in one schema; damaged lines go."""
    rows = spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(list(paths))
    return rows.withColumn("audio_file", any_path("path", "audio", "audio_path")).withColumn("n_speakers", F.coalesce("num_speakers", "speakers"))


def machine_manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """Manifests of machines with their number and line order kept."""
    rows = read_manifest(spark, pattern).withColumn("machine_id", F.regexp_extract(F.input_file_name(), r"(\d+)[^/\d]*$", 1).try_cast("int"))
    return rows.withColumn("line", F.monotonically_increasing_id())


def tasks(manifest: DataFrame, metadata: DataFrame, files: DataFrame) -> DataFrame:
    """Alignment tasks: entries whose audio exists, with the transcripts of their metadata."""
    have = manifest.join(files.select(F.col("path").alias("audio_file")).distinct(), "audio_file", "left_semi")
    text = lambda side: F.array_join(F.transform(F.col(f"segments.{side}"), lambda s: s["text"]), " ").alias(f"{side}_text")
    docs = metadata.select("conversation_id", text("main"), text("user"))
    return have.join(docs, "conversation_id", "left").select("conversation_id", "audio_file", "duration", "main_text", "user_text")


def alignment_words(rows: DataFrame, json: str = "json") -> DataFrame:
    """Words of alignment documents: word, start, end, speaker; malformed items go."""
    v = rows.withColumn("_v", F.try_parse_json(F.col(json))).withColumn("_a", F.try_variant_get("_v", "$.alignments", "array<variant>"))
    out = v.select(*rows.columns, F.posexplode("_a").alias("k", "_i"))
    get = lambda p, t: F.try_variant_get("_i", p, t)
    return out.select(*rows.columns, "k", get("$[0]", "string").alias("word"), get("$[1][0]", "double").alias("start"), get("$[1][1]", "double").alias("end"), get("$[2]", "string").alias("speaker")).filter("word IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")


def speaker_segments(rows: DataFrame, json: str = "json") -> DataFrame:
    """Segments of metadata documents whose ``segments`` are a list or lists by role.

    The original speaker is the first of three fields that is there.
    """
    v = rows.withColumn("_v", F.try_parse_json(F.col(json)))
    get = lambda p: F.try_variant_get("_v", p, "array<variant>")
    plain = F.coalesce(get("$.segments"), F.array().cast("array<variant>"))
    main, user = (F.coalesce(get(f"$.segments.{k}"), F.array().cast("array<variant>")) for k in ("main", "user"))
    out = v.select(*rows.columns, F.posexplode(F.concat(plain, main, user)).alias("k", "_i"))
    one = lambda p, t: F.try_variant_get("_i", p, t)
    speaker = F.coalesce(one("$.original_speaker_id", "string"), one("$.speaker_id", "string"), one("$.speaker", "string"))
    return out.select(*rows.columns, "k", one("$.start", "double").alias("start"), one("$.end", "double").alias("end"), one("$.text", "string").alias("text"), speaker.alias("speaker"))


def parse_sources(spec: str) -> dict[str, float]:
    """Normalised weights of ``path[:weight],...``; repeated paths and weights <= 0 are errors."""
    out: dict[str, float] = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        path, colon, weight = part.rpartition(":")
        try:
            w = float(weight) if colon else 1.0
        except ValueError:
            path, w = part, 1.0
        path = path if colon and path else part
        if path in out or w <= 0:
            raise ValueError(f"bad source {part!r}")
        out[path] = w
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def read_sources(spark: SparkSession, spec: str) -> DataFrame:
    """Rows of all sources with the weight of each; folders are searched for jsonl."""
    out = None
    for path, weight in parse_sources(spec).items():
        rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").option("pathGlobFilter", "*jsonl*").json(path)
        rows = rows.withColumn("source", F.lit(path)).withColumn("weight", F.lit(weight))
        out = rows if out is None else out.unionByName(rows)
    return out
