"""Tables and files in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only
where that is unset (tests, local mode) a temporary folder is used instead.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="turnwise-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage as a reliable checkpoint does, and later readers
    read only the columns they use. The files stay for the session unless
    ``drop`` is called.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables written by ``save`` that no later plan reads."""
    for table in tables:
        remove(table._shared_path)


def spread(df: DataFrame) -> DataFrame:
    """A table as it is read from files, dealt over all cores where its splits are fewer.

    Such a table is small (a split a core at most), so this shuffle doesn't grow;
    one file with one row group is a single task otherwise.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of files that a partition of a range sort takes.
RANGE_BYTES = 128 << 20


def range_parts(df: DataFrame) -> int:
    """Partitions for a sort of ``df`` by ranges: shuffle partitions, or more for more bytes of files.

    Bytes are those that the optimizer knows from the files' sizes; where it knows
    none (rows of the driver, for one) the setting stands.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // RANGE_BYTES)) if size < 1 << 60 else least


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def make_dir(uri: str) -> None:
    fs, path = _at(uri)
    fs.create_dir(path, recursive=True)


def remove(uri: str) -> None:
    fs, path = _at(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


class Writer:
    """A file that gets its name only when it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = _at(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.size = 0

    def write(self, data) -> None:
        self.out.write(data)
        self.size += memoryview(data).nbytes

    def close(self) -> None:
        """Give the file its name; another attempt may have done so with the same content."""
        self.out.close()
        try:
            self.fs.move(self.temp, self.path)
        except OSError:
            if self.fs.get_file_info(self.path).type == pafs.FileType.NotFound:
                raise
            self.fs.delete_file(self.temp)


def exists(uri: str) -> bool:
    fs, path = _at(uri)
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def read_bytes(uri: str, start: int = 0, length: int | None = None) -> bytes:
    fs, path = _at(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        return f.read_at(size - start if length is None else length, start)


def mapped(uri: str) -> np.ndarray:
    """The bytes of a file: memory-mapped where the folder is a local mount."""
    fs, path = _at(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        if fs.get_file_info(path).size == 0:
            return np.zeros(0, np.uint8)
        return np.memmap(path, dtype=np.uint8, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=np.uint8)


class Counts:
    """Sorted 64-bit keys and their counts, in two files that are mapped where they are used."""

    def __init__(self, path: str, size: int):
        self.path, self.size, self.found = path, size, None

    def __getstate__(self):
        return self.__dict__ | {"found": None}

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if self.found is None:
            self.found = (mapped(f"{self.path}.keys").view("<u8"), mapped(f"{self.path}.counts").view("<i8")) if self.size else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return self.found

    @staticmethod
    def write(path: str, counts: DataFrame) -> Counts:
        """The files of ``counts`` (key, c), written by one task as rows come."""

        def run(batches):
            keys, values, n = Writer(f"{path}.keys"), Writer(f"{path}.counts"), 0
            for batch in batches:
                keys.write(batch.column(0).to_numpy().astype("<i8").tobytes())
                values.write(batch.column(1).to_numpy().astype("<i8").tobytes())
                n += batch.num_rows
            keys.close()
            values.close()
            yield pa.RecordBatch.from_pydict({"n": [n]})

        ordered = counts.select("key", "c").repartition(1).sortWithinPartitions(F.col("key") < 0, "key")  # as unsigned integers
        return Counts(path, sum(r.n for r in ordered.mapInArrow(run, "n long").collect()))


_shipped: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session.

    Arrow batches are made smaller unless the session has set their size.
    """
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":  # the default; texts and sets of shingles are long rows
        spark.conf.set(_BATCH, "2000")
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='turnwise-')}/turnwise", "zip", package.parent, package.name)
        sc.addPyFile(made)
        _shipped.add(sc.applicationId)
