"""Sharded conversation cuts (gzipped JSON lines) and their audio archives."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CUTS = (
    "id STRING, duration DOUBLE, recording STRUCT<id: STRING, duration: DOUBLE, sampling_rate: INT>, "
    "supervisions ARRAY<STRUCT<id: STRING, speaker: STRING, text: STRING, start: DOUBLE, duration: DOUBLE, language: STRING>>"
)


def shard_index(path: Column | None = None) -> Column:
    """Shard number of a file named cuts.N.jsonl.gz; null for other names."""
    path = F.input_file_name() if path is None else path
    return F.expr("try_cast(nullif(s, '') AS int)") if isinstance(path, str) else F.regexp_extract(path, r"cuts\.(\d+)\.jsonl(?:\.gz)?$", 1).try_cast("int")


def cut_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(path, shard) of the files named cuts.N.jsonl[.gz], from their names alone."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "cuts.*.jsonl*").load(folder).select("path")
    return names.withColumn("shard", shard_index(F.col("path"))).filter("shard IS NOT NULL")


def check_shards(shards: DataFrame) -> DataFrame:
    """(path, shard, lines, error) of each shard: whether all of it decompresses and every line is a JSON object.

    A shard is one task and streams through it a line at a time; ``error`` is null for
    whole shards.
    """
    import gzip
    import json

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for path, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines, error = 0, None
                try:
                    with _opened(path) as raw, gzip.open(raw) if path.endswith(".gz") else raw as f:
                        for line in f:
                            if line.strip():
                                lines += 1
                                if not isinstance(json.loads(line), dict):
                                    raise ValueError(f"line {lines} is no object")
                except (EOFError, OSError, ValueError, zlib.error) as e:
                    error = f"{type(e).__name__}: {e}"[:300]
                yield pa.RecordBatch.from_pydict({"path": [path], "shard": pa.array([shard], pa.int32()), "lines": [lines], "error": pa.array([error], pa.string())})

    return shards.select("path", "shard").repartition("path").mapInArrow(run, "path string, shard int, lines long, error string")


def read_cuts(spark: SparkSession, folder: str, machine: int | None = None, machines: int = 1, whole: bool = False) -> DataFrame:
    """Cuts of all shards, or of every ``machines``-th shard in order of number.

    Shards are listed by name, a row a shard on the driver. Blank lines are skipped,
    damaged ones dropped; a compressed file is one task. With ``whole`` a shard is
    read whole or not at all: those that ``check_shards`` finds broken give no rows,
    at the price of reading all of them twice.
    """
    shards = cut_shards(spark, folder)
    found = sorted((r.shard, r.path) for r in shards.collect())
    if machine is not None:
        found = found[machine::machines]
    if whole:
        good = {r.path for r in check_shards(shards).filter("error IS NULL").collect()}
        found = [(n, path) for n, path in found if path in good]
    if not found:
        return spark.createDataFrame([], f"{CUTS}, shard INT")
    return spark.read.schema(CUTS).option("mode", "DROPMALFORMED").json([path for _, path in found]).withColumn("shard", shard_index())


def conversations(cuts: DataFrame) -> DataFrame:
    """Utterances of conversations grouped by cut id, in stable order of start.

    Missing ids are "unknown"; conversations without utterances go; the last
    known recording id and sampling rate of a conversation hold.
    """
    base = cuts.withColumn("conv_id", F.coalesce("id", F.lit("unknown"))).withColumn("_cut", F.monotonically_increasing_id())
    w = Window.partitionBy("conv_id")
    last = w.orderBy("_cut").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = base.withColumn("recording_id", F.last("recording.id", ignorenulls=True).over(last)).withColumn("sample_rate", F.coalesce(F.last("recording.sampling_rate", ignorenulls=True).over(last), F.lit(16_000)))
    base = base.withColumn("conv_duration", F.max("duration").over(w))
    u = base.select("conv_id", "recording_id", "sample_rate", "conv_duration", "_cut", F.posexplode("supervisions").alias("_i", "s"))
    n = F.row_number().over(w.orderBy("_cut", "_i")) - 1
    u = u.withColumn("_n", n)
    start = F.coalesce("s.start", F.lit(0.0))
    u = u.select("conv_id", "recording_id", "sample_rate", "conv_duration", "_n", F.coalesce("s.id", F.concat("conv_id", F.lit("_"), F.col("_n").cast("string"))).alias("utt_id"), F.coalesce("s.speaker", F.lit("unknown")).alias("speaker"), F.coalesce("s.text", F.lit("")).alias("text"), start.alias("start"), (start + F.coalesce("s.duration", F.lit(0.0))).alias("end"), F.coalesce("s.language", F.lit("ko")).alias("language"))
    return u.withColumn("pos", F.row_number().over(w.orderBy("start", "_n")) - 1).drop("_n")


def dataset_statistics(utts: DataFrame) -> DataFrame:
    """Conversations, utterances, hours and mean speakers a conversation."""
    c = utts.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("conv_duration").alias("d"), F.count_distinct("speaker").alias("s"))
    return c.agg(F.count("*").alias("conversations"), F.coalesce(F.sum("n"), F.lit(0)).alias("utterances"), F.round(F.coalesce(F.sum("d"), F.lit(0.0)) / 3600, 2).alias("hours"), F.round(F.coalesce(F.avg("s"), F.lit(0.0)), 4).alias("mean_speakers"))


def _opened(path: str):
    """A seekable file by its URI."""
    import pyarrow.fs as pafs

    fs, at = pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.open_input_file(at)


def archive_index(spark: SparkSession, folder: str) -> DataFrame:
    """(path, shard, member, offset, size, error): where the members of recording.*.tar lie.

    Only the headers of an archive are read, by seeking from one to the next, one
    archive a task. A damaged archive gives its members up to the damage and a last
    row with ``error``; a member that reaches beyond the file is such damage. A file
    of no bytes gives no rows.
    """
    import tarfile

    import pyarrow as pa

    names = ["path", "shard", "member", "offset", "size", "error"]
    kinds = pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()

    def run(batches):
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                number = path.rsplit("/", 1)[-1].split(".")[1]
                shard, rows = int(number) if number.isdigit() else None, []
                table = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)  # noqa: B023, E731
                try:
                    with _opened(path) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                        for m in tar:
                            tar.members = []  # else all headers stay in memory
                            if m.isfile():
                                if m.offset_data + m.size > length:
                                    raise tarfile.ReadError(f"{m.name} is cut off")
                                rows.append((path, shard, m.name, m.offset_data, m.size, None))
                            if len(rows) == 10_000:
                                yield table()
                                rows = []
                        if any(f.read_at(512, tar.offset)):  # else the walk ended at a zero block or the end of the file
                            raise tarfile.ReadError(f"no header at {tar.offset}")
                except (tarfile.TarError, EOFError) as e:
                    rows.append((path, shard, None, None, None, f"{type(e).__name__}: {e}"[:300]))
                if rows:
                    yield table()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "recording.*.tar").load(folder).select("path", "length")
    return files.repartition("path").mapInArrow(run, "path string, shard int, member string, offset long, size long, error string")


def tar_members(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".wav", ".flac", ".mp3"), wanted: DataFrame | None = None, part_bytes: int = 64 << 20) -> DataFrame:
    """Audio members of recording.*.tar: shard, cut_id, ext, content.

    The members are looked up in ``archive_index`` and, with ``wanted`` (shard,
    cut_id), joined with that before any content is read. What is left is dealt out
    by archive and stretch of ``part_bytes``, and each member is read by its range:
    an archive may have any size, a task holds one member at a time.
    """
    import pyarrow as pa

    name = F.element_at(F.split("member", "/"), -1)
    members = archive_index(spark, folder).filter("error IS NULL").withColumn("ext", F.regexp_extract(name, r"\.([^.]*)$", 1)).withColumn("cut_id", F.regexp_replace(name, r"\.[^.]*$", ""))
    members = members.filter(F.lower(F.concat(F.lit("."), F.col("ext"))).isin(*suffixes))
    if wanted is not None:
        members = members.join(wanted.select("shard", "cut_id").distinct(), ["shard", "cut_id"], "left_semi")
    names = ["shard", "cut_id", "ext", "content"]

    def run(batches):
        now, file = None, None
        for batch in batches:
            for path, shard, cut, ext, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != now:
                    now, file = path, _opened(path)
                row = [[shard], [cut], [ext], [file.read_at(size, offset)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.binary()), strict=True)], names)

    dealt = members.repartition("path", F.expr(f"offset div {part_bytes}")).sortWithinPartitions("path", "offset")
    return dealt.select("path", "shard", "cut_id", "ext", "offset", "size").mapInArrow(run, "shard int, cut_id string, ext string, content binary")


def audio_of(cuts: DataFrame, members: DataFrame) -> DataFrame:
    """Cuts with their audio where the archive has it."""
    return cuts.join(members.select(F.col("cut_id").alias("id"), "ext", "content"), "id", "left")
