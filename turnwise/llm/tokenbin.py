"""Token files: flat unsigned integers plus 64-bit document offsets.

A token set is a folder of parts, in ascending doc_id order:

* ``part-NNNNN.bin``  ids of all its documents, little-endian ``uint16`` where
  the vocabulary fits, else ``uint32``;
* ``part-NNNNN.idx``  ``TWTOKEN1``, id width and number of documents n as
  64-bit integers, then n doc_ids and n + 1 offsets (ids before each document
  within the part), all int64;
* the base of a part (ids in all parts before it) is a prefix sum over the
  parts' totals; only one row a part reaches the driver.

Both files of a part are memory-mapped when they are read.

Defined cases: a null text is empty and yields its end id alone; rows are
ordered by (doc_id, text), null doc_ids first, written as -2**63; repeated rows
are separate documents; an empty table gives no parts; other columns are
ignored; strings of special tokens in a text are ordinary text unless ``special`` is set
(see ``toks``).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import shared, toks
from turnwise.llm import words as W

MAGIC = b"TWTOKEN1"
NULL_ID = -(2**63)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, mode: str, end_id: int, id_width: int = 2, special: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into a token set below ``path``.

    Returns one row a part: ``part`` (its rank in doc_id order), ``stem`` (file
    name without suffix), ``n_docs``, ``n_tokens`` and ``base``.
    """
    spark = docs.sparkSession
    shared.make_dir(path)
    ordered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    ordered = ordered.repartitionByRange(shared.range_parts(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    parts = ordered.mapInArrow(_writer(path, tokenizer, mode, end_id, id_width, special), "part int, stem string, n_docs long, n_tokens long")
    rows = sorted(shared.save(parts, "tokenparts").collect())  # a row a part
    base, out = 0, []
    for r in rows:
        out.append((r.part, r.stem, r.n_docs, r.n_tokens, base))
        base += r.n_tokens
    return spark.createDataFrame(out, "part int, stem string, n_docs long, n_tokens long, base long")


def _writer(path: str, tokenizer: str, mode: str, end_id: int, id_width: int, special: bool):
    dtype = np.dtype(f"<u{id_width}")

    def run(batches):
        part = TaskContext.get().partitionId()
        stem = f"part-{part:05d}-{TaskContext.get().taskAttemptId()}"
        enc, out, ids, counts = toks.encoder(tokenizer, mode, special), None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = W.text_buffers(batch.column(1))
            ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
            out = out or shared.Writer(f"{path}/{stem}.bin")
            for i, j in W.chunked(offsets, 2 * W.CHUNK):
                flat, n = enc.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                flat = np.insert(flat, np.cumsum(n), end_id)
                if len(flat) and int(flat.max()) > np.iinfo(dtype).max:
                    raise ValueError(f"an id is too large for {id_width} bytes")
                out.write(flat.astype(dtype).tobytes())
                counts.append(n + 1)
        if out is None:
            return
        out.close()
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        idx = shared.Writer(f"{path}/{stem}.idx")
        idx.write(MAGIC + np.array([id_width, len(ids)], "<i8").tobytes())
        idx.write(ids.tobytes())
        idx.write(np.append(0, np.cumsum(counts)).astype("<i8").tobytes())
        idx.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "stem": [stem], "n_docs": [len(ids)], "n_tokens": [int(counts.sum())]})

    return run


def open_part(path: str, stem: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, offsets and ids of a part, memory-mapped."""
    idx = shared.mapped(f"{path}/{stem}.idx")
    if idx[:8].tobytes() != MAGIC:
        raise ValueError(f"{stem}.idx is no token index")
    width, n = (int(x) for x in idx[8:24].view("<i8"))
    body = idx[24:].view("<i8")
    return body[:n], body[n : 2 * n + 1], shared.mapped(f"{path}/{stem}.bin").view(f"<u{width}")


def read_tokens(parts: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a token set: doc_id, start, n_tokens, ids_crc32 (and ids).

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        for batch in batches:
            for stem, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs, offsets, ids = open_part(path, stem)
                for a in range(0, len(docs), 4096):
                    b = min(a + 4096, len(docs))
                    bounds = offsets[a : b + 1].tolist()
                    each = [ids[x:y].astype("<u4") for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                    cols = {"doc_id": pa.array(docs[a:b], mask=docs[a:b] == NULL_ID), "start": pa.array(offsets[a:b] + base), "n_tokens": pa.array(np.diff(offsets[a : b + 1])), "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(cols)

    n = parts.count()
    return parts.select("stem", "base").repartition(max(n, 1)).mapInArrow(run, schema)


def token_binary(docs: DataFrame, tokenizer: str, mode: str = "spaces", end_id: int = 0, path: str | None = None, special: bool = False) -> DataFrame:
    """Write ``docs`` as a token set and read every document back from it."""
    spark: SparkSession = docs.sparkSession
    path = path or shared.fresh(spark, "tokens")
    return read_tokens(write_tokens(docs, path, tokenizer, mode, end_id, special=special), path)
