"""Best-fit packing of documents into fixed-length sequences.

Piece lengths are integers of 1..capacity, so an instance is its histogram of
lengths: capacity numbers at most, however many documents there are. The plan is
made over that histogram on the driver, for all pieces of a length at once:

1. Martello-Toth dominance reduction. From the longest length down, a set that
   provably dominates every alternative for that piece is fixed for good: the
   piece alone when nothing fits beside it; the piece with its exact complement;
   the piece with the largest partner when no two pieces fit beside it; the
   piece with its largest partner when that is as long as the best two together;
   the piece with the best two when their larger one is the largest partner and
   every smaller pair is dominated too. A set stays dominating until one of its
   lengths runs out, so it is fixed for that many pieces at once.
2. What no rule settles is packed best-fit decreasing, whole runs of equal bins
   at a time.

A plan is a list of runs "the r-th .. piece of this length go to these
consecutive sequences at this offset". Its size and the time to make it depend on
the capacity, not on the documents. Pieces then look up their rank within their length; ranks come
from counts per partition and length, prefix-summed, so no length is gathered in
one task.

Defined cases: a null text is empty (its end id alone is packed); a text of any
length is cut into pieces of the capacity; repeated rows are separate documents;
pieces of equal length are placed in the order of partitions and rows; an empty
table gives no rows; other columns are ignored; strings of special tokens in a text
are ordinary text unless ``special`` is set (see ``toks``).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm import shared, toks
from turnwise.llm import words as W

RUN = np.dtype([("length", "i8"), ("rank", "i8"), ("count", "i8"), ("sequence", "i8"), ("offset", "i8")])


class Plan:
    """Runs of a packing; ``sequences`` is how many sequences it fills."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.used = np.zeros(capacity + 1, dtype=np.int64)  # pieces of a length placed so far
        self.runs: list[tuple[int, int, int, int, int]] = []

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.used[length]), count, sequence, offset))
        self.used[length] += count

    def fix(self, lengths: list[int], count: int) -> None:
        """``count`` new sequences, each holding one piece of every length."""
        offset = 0
        for length in lengths:
            self.put(length, count, self.sequences, offset)
            offset += length
        self.sequences += count

    def table(self) -> np.ndarray:
        out = np.array(self.runs, dtype=RUN) if self.runs else np.zeros(0, RUN)
        return out[np.lexsort((out["rank"], out["length"]))]


def reduce_instance(left: np.ndarray, plan: Plan) -> None:
    """Fix dominating sets; ``left`` (pieces by length) shrinks accordingly."""
    cap = plan.capacity

    def largest(limit: int, free: np.ndarray) -> int:
        found = np.flatnonzero(free[1 : limit + 1])
        return int(found[-1]) + 1 if limit > 0 and len(found) else 0

    def smallest(free: np.ndarray) -> int:
        found = np.flatnonzero(free)
        return int(found[0]) if len(found) else 0

    def fix(lengths: list[int]) -> None:
        """As many such sets as there are pieces for: what is used up only shrinks the alternatives."""
        n = min(int(left[x]) // lengths.count(x) for x in lengths)
        for x in lengths:
            left[x] -= n
        plan.fix(lengths, n)

    for w in range(cap, 0, -1):
        while left[w]:
            room = cap - w
            others = left.copy()
            others[w] -= 1
            a = largest(room, others)
            if not a:  # nothing fits beside it
                fix([w])
                continue
            s1 = smallest(others)
            others[s1] -= 1
            s2 = smallest(others)
            if a == room or not (s2 and s1 + s2 <= room):
                fix([w, a])
                continue
            others[s2] -= 1
            s3 = smallest(others)
            others[s1] += 1
            others[s2] += 1
            if s3 and s1 + s2 + s3 <= room:  # three fit: no set of two or three is proven
                break
            best, pair = 0, (0, 0)
            for x in np.flatnonzero(others[1 : room + 1])[::-1] + 1:
                if 2 * x < best:
                    break
                others[x] -= 1
                y = largest(min(room - int(x), int(x)), others)
                others[x] += 1
                if y and x + y > best:
                    best, pair = int(x + y), (int(x), int(y))
            if a >= best:
                fix([w, a])
                continue
            y = pair[1]
            longer = np.flatnonzero(others[y + 1 : room - s1 + 1]) + y + 1
            if pair[0] != a or (longer != a).any():  # another pair holds one longer than y
                break
            fix([w, a, y])


def best_fit(left: np.ndarray, plan: Plan) -> None:
    """Best-fit decreasing over the rest, equal bins at a time."""
    cap = plan.capacity
    bins: list[list[list[int]]] = [[] for _ in range(cap + 1)]  # by room: runs [first sequence, count]
    rooms = np.zeros(cap + 1, dtype=np.int64)
    for w in range(cap, 0, -1):
        n = int(left[w])
        while n:
            open_ = np.flatnonzero(rooms[w:])
            if len(open_):
                room = int(open_[0]) + w
                first, count = bins[room].pop()
                take = min(n, count)
                if take < count:
                    bins[room].append([first + take, count - take])
            else:
                room, take = cap, -(-n // (cap // w))
                first = plan.sequences
                plan.sequences += take
                rooms[cap] += take
            rooms[room] -= take
            plan.put(w, take, first, cap - room)
            if room > w:
                bins[room - w].append([first, take])
                rooms[room - w] += take
            n -= take
        left[w] = 0


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in histogram.items():
        left[length] = count
    plan = Plan(capacity)
    reduce_instance(left, plan)
    best_fit(left, plan)
    return plan


def pieces(docs: DataFrame, tokenizer: str, mode: str, end_id: int, capacity: int, special: bool = False) -> DataFrame:
    """Token pieces of whole documents: only longer ones are cut.

    ``rank`` counts the pieces of a length within a partition ``part``.
    """

    def run(batches):
        enc, part = toks.encoder(tokenizer, mode, special), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            data, offsets = W.text_buffers(batch.column(1))
            doc_ids = batch.column(0)
            for i, j in W.chunked(offsets, 2 * W.CHUNK):
                flat, n = enc.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                flat = np.insert(flat, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                many = -(-n // capacity)
                doc = np.repeat(np.arange(j - i), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                at = (np.cumsum(n) - n)[doc] + start
                crc = [zlib.crc32(flat[a : a + b]) for a, b in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                by = length[order]
                new = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.zeros(0, np.int64)
                sizes = np.diff(np.append(new, len(by)))
                rank = np.empty(len(by), dtype=np.int64)
                rank[order] = np.arange(len(by)) - np.repeat(new, sizes) + seen[by]
                seen[by[new]] += sizes
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": doc_ids.slice(i, j - i).take(pa.array(doc)),
                        "piece": pa.array(piece, pa.int32()),
                        "start": pa.array(start),
                        "length": pa.array(length),
                        "ids_crc32": pa.array(crc, pa.int64()),
                        "part": pa.array(np.full(len(doc), part), pa.int32()),
                        "rank": pa.array(rank),
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def best_fit_packing(docs: DataFrame, tokenizer: str, mode: str = "words", end_id: int = 1, capacity: int = 4096, special: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of ``capacity`` tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id and
    offset; the pieces of a sequence lie side by side from offset 0.
    """
    cut = shared.save(pieces(docs, tokenizer, mode, end_id, capacity, special), "pieces")
    spark = cut.sparkSession
    counts = cut.groupBy("part", "length").count()
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    runs = make_plan(histogram, capacity).table()
    # the ranks of a length start, in a partition, after all of the partitions before
    before = F.sum("count").over(_by_length()) - F.col("count")
    ranked = counts.withColumn("before", before).select("part", "length", "before")
    keys = runs["length"] * (1 << 44) + runs["rank"]
    sent = spark.sparkContext.broadcast((keys, runs["sequence"].copy(), runs["offset"].copy(), runs["rank"].copy()))

    def place(batches):
        keys, sequence, offset, first = sent.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            rank = rank + batch.column(batch.schema.get_field_index("before")).to_numpy()
            at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array(sequence[at] + rank - first[at]), "offset": pa.array(offset[at])})

    return cut.join(ranked, ["part", "length"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _by_length():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("part")
