"""Sharding by a Feistel permutation over global row numbers.

DataFrame and SQL functions only. Rows are numbered from 0 in the order of
(doc_id, size, text_crc32), so numbers don't depend on files or partitions. A
keyed permutation of 0 .. n-1 takes row i to position p; its shard is ``p mod
shards`` and its slot ``p div shards``. Shards therefore differ by one row at
most, slots have no gaps, and a loader finds the row of any shard and slot, or
the place of any row, by arithmetic alone (``place_of``, ``row_at``).

The permutation is a Feistel network on pairs (x mod a, x div a) with a * b >= n
and a * b < n + a, where a is the square root of n rounded up; halves of unequal
size take part in turn. A result of n or more goes through the network again
(cycle walking) until it lies below n. A walk visits values from n to a * b - 1
and none twice, so ``a * b - n`` further runs always suffice; fewer than one row
in a walks at all, so all walks together cost about one step a row.

Numbering shuffles doc_id, size and checksum alone, by ranges of doc_id: a row's
number is its place in its range plus the rows of the ranges before, of which
there is one count a partition.

Defined cases: a null text is empty; null doc_ids come first; repeated rows are
numbered one after another, and which of them is which has no meaning; an empty
table gives no rows; other columns are ignored by ``shard_places`` and carried
along, whatever their names, by ``write_shards``; texts of any length are read
whole. Copies of one text are rows like any others and spread over the shards.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm import shared

ROUNDS = 6
_LOW = 33  # bits of a row's place in monotonically_increasing_id
_ORDER = ("doc_id", "size", "text_crc32")


def halves(n: int) -> tuple[int, int]:
    """Sides a and b of the network's domain for n rows."""
    a = max(math.isqrt(max(n - 1, 0)) + 1, 1)
    return a, max(-(-n // a), 1)


def _round(seed: int, j: int, half: int) -> int:
    return int(hashlib.md5(f"{seed}:{j}:{half}".encode()).hexdigest()[:15], 16)


def permuted(i: int, n: int, seed: int = 0) -> int:
    """Position of row ``i`` of ``n``."""
    a, b = halves(n)
    while True:
        left, right = i % a, i // a
        for j in range(ROUNDS):
            left, right = right, (left + _round(seed, j, right)) % (b if j % 2 else a)
        i = a * right + left
        if i < n:
            return i


def unpermuted(p: int, n: int, seed: int = 0) -> int:
    """Row at position ``p`` of ``n``."""
    a, b = halves(n)
    while True:
        left, right = p % a, p // a
        for j in reversed(range(ROUNDS)):
            left, right = (right - _round(seed, j, left)) % (b if j % 2 else a), left
        p = a * right + left
        if p < n:
            return p


def place_of(i: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of row ``i`` of ``n``."""
    return permuted(i, n, seed) % shards, permuted(i, n, seed) // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """Row of ``n`` that lies in ``slot`` of ``shard``."""
    return unpermuted(slot * shards + shard, n, seed)


def position(row: Column, n: int, seed: int = 0) -> Column:
    """The same permutation as a column."""
    a, b = halves(n)
    keys = F.array(*(F.lit(j) for j in range(ROUNDS)))

    def network(x: Column) -> Column:
        def one(s: Column, j: Column) -> Column:
            drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), j.cast("string"), F.lit(":"), s["right"].cast("string"))), 1, 15), 16, 10)
            return F.struct(s["right"].alias("left"), ((s["left"] + drawn.cast("long")) % F.when(j % 2 == 1, F.lit(b)).otherwise(F.lit(a))).cast("long").alias("right"))

        start = F.struct((x % a).cast("long").alias("left"), F.call_function("div", x, F.lit(a)).cast("long").alias("right"))
        return F.aggregate(keys, start, one, lambda s: s["right"] * F.lit(a) + s["left"])

    out = F.transform(F.array(network(row.cast("long"))), lambda first: F.when((first < n) | F.lit(a * b == n), first).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(max(a * b - n, 1))), first, lambda x, _: F.when(x < n, x).otherwise(network(x)))))
    return out[0]


def number_rows(rows: DataFrame, order: tuple[str, ...]) -> tuple[DataFrame, int]:
    """``rows`` with their global number ``row`` from 0 in the order of ``order``, and how many there are.

    ``rows`` is read twice, as ranges are sampled first: hand in a saved table where
    making a row costs more than reading it.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = shared.save(ranged, "ranges")
    part = F.shiftright("_at", _LOW)
    base, bases = 0, []
    for part_id, n in sorted(ranged.groupBy(part.alias("part")).count().collect()):  # a row a partition
        bases.append((part_id, base))
        base += n
    offsets = spark.createDataFrame(bases, "_part long, _base long")
    numbered = ranged.join(F.broadcast(offsets), part == F.col("_part")).withColumn("row", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << _LOW) - 1)))
    return numbered.drop("_at", "_part", "_base"), base


def shard_places(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is ``rows``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = number_rows(shared.save(rows, "sizes"), _ORDER)
    placed = numbered.withColumn("_p", position(F.col("row"), n, seed))
    return placed.select(*_ORDER, F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 0) -> DataFrame:
    """Write whole documents below ``path/shard=S``, rows in the order of their slots; returns them read back.

    Of rows that share doc_id, size and checksum each gets one of their places.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = number_rows(whole, _ORDER)
    placed = numbered.withColumn("_p", position(F.col("row"), n, seed)).select("doc", (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"))
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
