"""Jaccard self-join of shingle sets by a size-aware heavy-light scheme.

Two sets of sizes x and y link when ``100 * overlap >= 80 * union``, which is
``overlap >= t(x, y) = ceil(80 (x + y) / 180)`` (for other thresholds alike).
In any common order of shingles, the k-th common shingle of linking sets is
among the first ``x - t + k`` of the one and ``y - t + k`` of the other. Hence

* light sets (size up to ``boundary``) enumerate all 2-subsets of their first
  ``x - t + 2`` shingles: linking light sets share one;
* heavy sets scan the inverted lists of their first ``x - t + 1`` shingles; light
  sets large enough to link with a heavy one are in these lists too;
* the boundary is the cheapest by a cost over the histogram of sizes and the
  mean length of a list.

The order puts shingles in long lists last, so that a passage which many
documents share is looked up by nobody who has rarer shingles: texts that share less
than ``percent`` of their shingles with many others are no candidates of each other.

Only components are wanted, so the members of a list are first compared with
one centre of the list (a candidate a member, however long the list is). A task
that adds more than ``BLOCK`` rows to a list puts the others in blocks of their own,
which go to other tasks and have a centre each, so no task gets a long list whole.
Members that are still in different components afterwards are compared with each
other, by bands of size: no link between different components is lost. Equal sets are one class from the
start. Parity bitmaps bound the symmetric difference of two sets from below and
drop pairs that can't link; the other candidates are verified on whole sets.

Shingles are 64-bit hashes. Defined cases: a null or wordless text has an empty
set, links with nothing and is its own component; texts of fewer than ``size``
words have one shingle, their sequence; texts of any length are taken whole; of
equal sizes and frequencies the order of hashes decides; rows with the same doc_id
are one node (their sets each take part); an empty table gives no rows; other columns are
ignored; rows with a null doc_id are returned with a null component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm import shared
from turnwise.llm import words as W
from turnwise.llm.components import components

U64 = np.uint64
#: 64-bit words of the parity bitmap of a set.
PARITY = 16
_BITS = "bits struct<" + ", ".join(f"b{k}: bigint" for k in range(PARITY)) + ">"
#: Shingles that a task counts at a time.
PART = 2_000_000
#: Share of the hash range in which a shingle is passed on if it is met once in a part, too.
EXACT = 1 / 16
#: Most shingles that are ordered last (8 bytes each are sent to the workers).
FREQUENT = 1_000_000
#: Rows of a list in one task after which a new block of the list is begun.
BLOCK = 10_000
#: Counters of rows by key that a task keeps (4 bytes each).
COUNTERS = 1 << 20
#: Candidate documents up to which their ids are broadcast to fetch the texts.
BROADCAST_IDS = 1_000_000


def sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """Per text its distinct shingles, sorted."""
    for i, j in W.chunked(offsets):
        h, begin = W.shingles(W.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), size)
        for r in range(j - i):
            s = np.sort(h[begin[r] : begin[r + 1]])
            yield s[np.append(True, s[1:] != s[:-1])] if len(s) > 1 else s


def need(x, y, percent: int):
    """Least overlap of linking sets of sizes x and y."""
    return -(-(percent * (x + y)) // (100 + percent))


def smallest_partner(x, percent: int):
    return -(-(percent * x) // 100)


def parity(s: np.ndarray) -> np.ndarray:
    """Bit k is whether an odd number of shingles falls on k.

    Each shingle that only one of two sets has flips one bit, so the bits in
    which two bitmaps differ are at most the size of the symmetric difference.
    """
    odd = np.bincount((s % U64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_link(a: str, b: str, percent: int) -> str:
    """SQL: the bitmaps allow the overlap that linking takes."""
    differ = " + ".join(f"bit_count({a}.bits.b{k} ^ {b}.bits.b{k})" for k in range(PARITY))
    return f"{100 + percent} * ({differ}) <= {100 - percent} * ({a}.n + {b}.n)"


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, number of shingles, signature and bitmap of the set of every text."""

    def run(batches):
        for batch in batches:
            data, offsets = W.text_buffers(batch.column(1))
            n, sig, bits = [], [], []
            for s in sets(data, offsets, size):
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bits.append(parity(s))
            words = np.array(bits, dtype=np.int64).reshape(-1, PARITY)
            packed = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(words[:, k])) for k in range(PARITY)], [f"b{k}" for k in range(PARITY)])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.binary()), "bits": packed})

    return docs.mapInArrow(run, f"doc_id long, n long, sig binary, {_BITS}")


def _counts(docs: DataFrame, size: int) -> DataFrame:
    """How many texts hold a shingle (key, c), over all texts.

    A task counts ``PART`` shingles at a time. In the lowest ``EXACT`` of the hash
    range these counts are exact; elsewhere a shingle met once in a part isn't passed
    on, which takes one a part off its count at most and spares the many shingles
    that one text alone has. Counts order the shingles and choose the boundary, so
    they bear on the work done only, never on the links found.
    """
    limit = U64(int(EXACT * 2**64))

    def run(batches):
        held, n = [], 0

        def flush():
            every = np.concatenate(held)
            held.clear()
            every.sort()
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            c = np.diff(first, append=len(every))
            keep = (c > 1) | (every[first] < limit)
            return pa.RecordBatch.from_pydict({"key": pa.array(every[first[keep]].view(np.int64)), "c": pa.array(c[keep])})

        for batch in batches:
            data, offsets = W.text_buffers(batch.column(1))
            for s in sets(data, offsets, size):
                held.append(s)
                n += len(s)
                if n > PART:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, float]:
    """The most frequent shingles (at most ``FREQUENT``, sorted), and the mean length of a list."""
    counts = shared.save(_counts(docs, size).filter("c > 1"), "counts")
    exact = F.col("key").between(0, int(EXACT * 2**64) - 1)
    mean, every = counts.agg(F.sum(F.when(exact, F.col("c") * F.col("c"))) / F.sum(F.when(exact, F.col("c"))), F.sum("c")).first()
    many = max(32, -(-(every or 0) // FREQUENT))
    keys = np.array([r.key for r in counts.filter(F.col("c") >= many).select("key").collect()], dtype=np.int64)
    shared.drop(counts)
    return np.sort(keys.view(np.uint64)), mean or 1.0


def choose_boundary(sizes: dict[int, int], list_length: float, percent: int, most: int = 48) -> int:
    """Size up to which enumerating 2-subsets costs less than scanning lists."""
    best, cheapest = 0, math.inf
    for b in range(most + 1):
        cost = 0.0
        for x, count in sizes.items():
            p = x - need(x, smallest_partner(x, percent), percent) + 1
            if x <= b:
                cost += count * math.comb(p + 1, 2)
            if x > b or x > smallest_partner(b + 1, percent) - 1:
                cost += count * p * list_length
        if cost < cheapest:
            best, cheapest = b, cost
    return best


def _keys(docs: DataFrame, size: int, percent: int, boundary: int, frequent: np.ndarray) -> DataFrame:
    """Lookup keys of every text: 2-subsets of light sets, shingles of heavy ones."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    least = smallest_partner(boundary + 1, percent)

    def run(batches):
        frequent, seen = sent.value, set()
        out: list[list[np.ndarray]] = [[], [], [], []]
        n, counters, part = 0, np.zeros(COUNTERS, dtype=np.int32), TaskContext.get().partitionId() + 1

        def blocks(key):
            """0, or a block of its own for the rows of a list that this task makes too long."""
            slot = (key % U64(COUNTERS)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(slot[order]) != 0))
            size = np.diff(np.append(first, len(order)))
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order)) - np.repeat(first, size)
            block = (counters[slot] + place) // BLOCK
            counters[slot[order[first]]] += size.astype(np.int32)
            return np.where(block > 0, (part << 32) + block, 0)

        def table():
            key, doc, length, place = (np.concatenate(x) for x in out)
            block = blocks(key)
            apart = np.flatnonzero(block)
            if len(apart):  # the first of each block stands in the list itself too
                _, first = np.unique(np.stack([key[apart].view(np.int64), block[apart]]), axis=1, return_index=True)
                key, doc, length, place = (np.append(x, x[apart[first]]) for x in (key, doc, length, place))
                block = np.append(block, np.zeros(len(first), dtype=np.int64))
            return pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "block": pa.array(block), "doc_id": pa.array(doc), "n": pa.array(length, pa.int32()), "pos": pa.array(place, pa.int32())})

        for batch in batches:
            data, offsets = W.text_buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            for doc, s in zip(ids, sets(data, offsets, size), strict=True):
                x = len(s)
                if not x or doc is None:
                    continue
                sig = xxhash.xxh3_128_digest(s.tobytes())
                if sig in seen:  # an equal set of this task stands for it
                    continue
                if len(seen) < 500_000:
                    seen.add(sig)
                last = np.zeros(x, dtype=bool)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    last = frequent[at] == s
                s = np.concatenate([s[~last], s[last]])
                p = x - need(x, smallest_partner(x, percent), percent) + 1
                made = []
                if x <= boundary:
                    a, b = np.triu_indices(min(p + 1, x), 1)
                    lo, hi = np.minimum(s[a], s[b]), np.maximum(s[a], s[b])
                    made.append((W.mix(lo * U64(0x9E3779B97F4A7C15) + hi), b - 1))
                if x > boundary or x >= least:
                    made.append((s[:p], np.arange(min(p, x))))
                for key, place in made:
                    for k, v in zip(out, (key, np.full(len(key), doc), np.full(len(key), x), place), strict=True):
                        k.append(v)
                    n += len(key)
                if n > 200_000:
                    yield table()
                    out, n = [[], [], [], []], 0
        if n:
            yield table()

    return docs.mapInArrow(run, "key long, block long, doc_id long, n int, pos int")


def _fits(a: str, b: str, percent: int) -> str:
    """SQL: the sizes can link and the key can be a first common shingle."""
    t = f"((({percent} * ({a}.n + {b}.n)) + {99 + percent}) div {100 + percent})"
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND {a}.pos <= {a}.n - {t} AND {b}.pos <= {b}.n - {t}"


def _in_lists(keys: DataFrame, parts: int) -> DataFrame:
    """Rows whose key more than one document has, with the centre of their block.

    The centre is the document with the least id. Rows come sorted from Spark and
    are passed on batch by batch; of the open block only its centre is kept.
    """
    names = ["key", "block", "doc_id", "n", "pos"]

    def run(batches):
        held = None  # the open block: its centre's row, and whether that is still unsent
        unsent = False
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in range(5)]
            if held is not None:  # the centre goes in front, so that its block is whole here
                cols = [np.append(h, c).astype(c.dtype) for h, c in zip(held, cols, strict=True)]
            key, block = cols[0], cols[1]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
            size = np.diff(np.append(first, len(key)))
            send = np.repeat(size > 1, size)
            if held is not None:
                send[0] &= unsent
            unsent = bool(size[-1] == 1 and (unsent or held is None or len(first) > 1))
            held = [c[first[-1]] for c in cols]
            rows, head = np.flatnonzero(send), np.repeat(first, size)[send]
            for a in range(0, len(rows), 200_000):
                r, h = rows[a : a + 200_000], head[a : a + 200_000]
                centre = {f"c_{k}": pa.array(c[h]) for k, c in zip(("id", "n", "pos"), cols[2:], strict=True)}
                yield pa.RecordBatch.from_pydict({k: pa.array(c[r]) for k, c in zip(names, cols, strict=True)} | centre)

    ordered = keys.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "doc_id")
    return ordered.mapInArrow(run, "key long, block long, doc_id long, n int, pos int, c_id long, c_n int, c_pos int")


def _verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = shared.save(ids, "candidates")
    chosen = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")

    def collect(batches):
        for batch in batches:
            data, offsets = W.text_buffers(batch.column(batch.schema.get_field_index("text")))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_pydict({"id": ids, "set": pa.array([s.tobytes() for s in sets(data, offsets, size)], pa.binary())})

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int(np.count_nonzero(y[at] == x)) if len(y) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_pydict({"a": batch.column(0).filter(pa.array(keep)), "b": batch.column(1).filter(pa.array(keep))})

    held = chosen.select("doc_id", "text").mapInArrow(collect, "id long, set binary")
    left = held.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = held.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b")
    out = shared.save(joined.mapInArrow(check, "a long, b long"), "verified")
    shared.drop(ids)
    return out


def jaccard_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles and component_id."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = shared.save(_scan(texts, size), "sets")
    classes = shared.save(rows.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")
    ided = rows.join(classes.select("sig", "class_id"), "sig", "left")

    frequent, mean = common_shingles(texts, size)
    sizes = {r.n: r["count"] for r in classes.filter("n <= 64").groupBy("n").count().collect()}  # 64 rows at most
    boundary = choose_boundary(sizes, mean, percent)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = shared.save(_in_lists(_keys(texts, size, percent, boundary, frequent), parts), "lists")
    class_of = ided.select(F.col("doc_id").alias("x"), F.col("class_id")).filter("class_id IS NOT NULL").distinct()

    def classed(pairs: DataFrame) -> DataFrame:
        a = pairs.join(class_of.select(F.col("x").alias("a"), F.col("class_id").alias("ca")), "a")
        return a.join(class_of.select(F.col("x").alias("b"), F.col("class_id").alias("cb")), "b")

    star = lists.filter("doc_id <> c_id").select(F.struct("n", "pos").alias("p"), F.struct(F.col("c_n").alias("n"), F.col("c_pos").alias("pos")).alias("q"), F.col("doc_id").alias("a"), F.col("c_id").alias("b"))
    star = star.filter(_fits("p", "q", percent)).select("a", "b").distinct()
    star = classed(star).filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    maps = classes.select("class_id", F.struct("n", "bits").alias("s"))
    known = star.join(maps.select(F.col("class_id").alias("a"), F.col("s").alias("p")), "a").join(maps.select(F.col("class_id").alias("b"), F.col("s").alias("q")), "b")
    star = shared.save(known.filter(_may_link("p", "q", percent)).select("a", "b").distinct(), "star")
    first = _verify(star, texts, size, percent)
    part = components(first)

    # members of one list in different components: compare them with each other
    named = lists.select("key", "block", "doc_id", "n", "pos", (F.col("doc_id") == F.col("c_id")).alias("centre")).join(class_of.withColumnRenamed("x", "doc_id"), "doc_id")
    named = named.join(part.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), (F.max("block") > 0).alias("split")).filter("lo <> hi AND (m > 2 OR split)").select("key", "split")
    rest = shared.save(named.join(mixed, "key").filter("split OR NOT centre")  # all of a list in one block met its centre
    .groupBy("key", "class_id", "component").agg(F.min("n").alias("n"), F.min("pos").alias("pos")), "rest")
    # sizes that can link lie in the same or in neighbouring bands, which parts long lists
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9)
    mapped = rest.join(classes.select("class_id", "bits"), "class_id").withColumn("band", band)
    p, q = mapped.alias("p"), mapped.withColumn("band", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1))))).alias("q")
    more = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.band") == F.col("q.band")) & F.expr("p.class_id < q.class_id AND p.component <> q.component AND " + _fits("p", "q", percent) + " AND " + _may_link("p", "q", percent)))
    more = shared.save(more.select(F.col("p.class_id").alias("a"), F.col("q.class_id").alias("b")).distinct(), "more")
    second = _verify(more.join(star, ["a", "b"], "left_anti"), texts, size, percent)
    if second.isEmpty():
        final = part
    else:
        final = components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(second))
    shared.drop(lists, star, rest, more)
    out = ided.join(final.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The document of each component that gives it its name, all columns kept.

    Of rows that repeat a kept doc_id that with the least text stays (of equal
    texts, the least hash of the row); null doc_ids all stay.
    """
    keep = jaccard_classes(docs, size, percent).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(keep, "doc_id", "left_semi")
    if not _repeats(docs):
        return named
    one = named.select("doc_id", F.struct("*").alias("r")).groupBy("doc_id").agg(F.min_by("r", F.struct("r.text", F.to_json("r"))).alias("r")).select("r.*")
    return one.unionByName(docs.filter("doc_id IS NULL"))


def _repeats(docs: DataFrame) -> bool:
    """Whether some doc_id is null or repeated."""
    return not docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty()
