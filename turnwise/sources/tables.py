"""Small side inputs read on the driver or as whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of reports that lie beside metadata documents. Fixed values.
REPORTS = ["manifest", "report", "stats", "checkpoint"]


def metadata_documents(spark: SparkSession, *folders: str) -> DataFrame:
    """JSON documents of the first folder that has any, reports left out."""
    for folder in folders:
        try:
            found = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(folder)
        except Exception as e:  # the folder isn't there
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        found = found.select(F.input_file_name().alias("path"), F.col("value").alias("json")).filter(~F.regexp_extract("path", r"([^/]+)$", 1).rlike("|".join(REPORTS)))
        if not found.isEmpty():
            return found
    return spark.createDataFrame([], "path string, json string")


def paths(spark: SparkSession, path: str) -> DataFrame:
    """Paths of JSON lines, plain or gzipped."""
    return spark.read.schema("path STRING").json(path).filter("path IS NOT NULL")


def templates(spark: SparkSession, text: str) -> DataFrame:
    """Questions and answers by category from a YAML template document."""
    import yaml

    rows = []
    for category, body in (yaml.safe_load(text) or {}).items():
        for q in body.get("questions", []):
            for kind, answers in (body.get("responses") or {}).items():
                rows += [(category, q, kind, a) for a in (answers if isinstance(answers, list) else [answers])]
    return spark.createDataFrame(rows, "category string, question string, style string, answer string")


def vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pieces (id, piece) and merges (rank, left, right) of a tokenizer JSON file."""
    doc = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))
    pieces = doc.select(F.explode(F.variant_get("v", "$.model.vocab", "map<string,int>")).alias("piece", "id"))
    merges = doc.select(F.posexplode(F.variant_get("v", "$.model.merges", "array<variant>")).alias("rank", "m"))
    text = F.coalesce(F.try_variant_get("m", "$", "string"), F.lit(""))
    left = F.coalesce(F.try_variant_get("m", "$[0]", "string"), F.split(text, " ")[0])
    right = F.coalesce(F.try_variant_get("m", "$[1]", "string"), F.get(F.split(text, " "), F.lit(1)))
    return pieces.select("id", "piece"), merges.select("rank", left.alias("left"), right.alias("right"))


def shard_path(root: str, kind: str, shard: Column, name: Column, suffix: str) -> Column:
    """root/kind/NNN/name.suffix with a shard number of three digits at least."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.lit(kind), F.format_string("%03d", shard), F.concat(name, F.lit("." + suffix)))


def voice_profile(voices: DataFrame, root: str) -> DataFrame:
    """One JSON document a voice (voice_id, speaker, duration, sample_rate, issues): its paths and validity.

    A voice is valid when it has no issues and lasts at least three seconds.
    """
    issues = F.coalesce("issues", F.array().cast("array<string>"))
    short = F.when(F.coalesce("duration", F.lit(0.0)) < 3.0, F.lit("too_short"))
    every = F.array_compact(F.concat(issues, F.array(short)))
    path = lambda suffix: F.concat_ws("/", F.lit(root.rstrip("/")), "voice_id", F.lit(suffix))
    body = F.struct("voice_id", "speaker", "duration", "sample_rate", (F.size(every) == 0).alias("is_valid"), every.alias("issues"), F.struct(path("reference.wav").alias("audio"), path("embedding.npy").alias("embedding"), path("codes.npy").alias("codes")).alias("paths"))
    return voices.select("voice_id", F.to_json(body).alias("document"))
