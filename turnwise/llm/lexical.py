"""Ranked lexical search over all documents by a two-level quantised index.

Terms are runs of letters, digits and characters beyond ASCII, with A-Z lowered.
With N documents that hold a term, L terms in all, n terms in a document, and
m = 100 - 25 + (25 n N) div L, the impact of a term that occurs tf times is
(1000000000 tf) div (1000 tf + 12 m), an integer below 1000000. A document's score
for an item sums weight times impact over the item's terms, repeats included.

* One pass over the texts writes postings: a row holds a shard of at most
  ``SHARD_DOCS`` documents, term by term the documents that hold it and tf. Only
  terms of the items are kept. N, L and document frequencies are sums over these
  rows.
* A second pass, over the postings, adds the upper level: a byte a posting, the
  impact in steps of ``STEP``, rounded up. Both levels are saved as the index.
* The search takes an item's lists in a shard, adds bytes times weights, and has
  an upper bound of every document; a lower bound is that less one step a
  weight. Every document whose upper bound reaches the kth lower bound there,
  and the kth score of the task so far, is rescored by exact integers from the
  lower level. A task returns its ``k`` best documents an item; a last shuffle
  of these ranks them. No document is left out on any other ground, so
  results are exact.

Items are taken in blocks of at most ``BLOCK_ITEMS`` items and about
``BLOCK_BYTES`` of text; each block makes one index. Terms are identified by
64-bit hashes.

Defined cases: null texts have no terms; a null doc_id comes first among equal
scores; repeated documents are ranked each, with ranks of their own; repeated
items get a list each under their own item_id; items without terms, and items no
document holds a term of, get no rows; an empty table on either side gives none;
other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm import shared
from turnwise.llm import words as W

BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32_000_000
SHARD_DOCS, SHARD_POSTINGS = 16_384, 3_000_000
#: Impacts are below this number, and a byte stands for so many.
MOST = 1_000_000
STEP = -(-MOST // 255)
NULL_ID = -(2**63)
POSTINGS = "docs int, live long, words long, ids binary, sizes binary, terms binary, counts binary, places binary, tf binary"


def length_norm(n, live: int, words: int):
    """m of documents of ``n`` terms."""
    return 100 - 25 + (25 * n * live) // max(words, 1)


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _terms(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return W.Words(raw, np.array([0, len(raw)]), letters=True).hash


def _postings(terms: np.ndarray):
    """Rows of POSTINGS of the texts of a task; ``terms`` are sorted hashes."""

    def row(ids, sizes, held) -> pa.RecordBatch:
        term, place, tf = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.argsort(term, kind="stable")  # places ascend within a term
        present, counts = np.unique(term, return_counts=True)
        sizes = np.concatenate(sizes)
        blobs = [np.concatenate(ids).astype("<i8"), sizes.astype("<u4"), present.astype("<u4"), counts.astype("<u4"), place[order].astype("<u2"), tf[order].astype("<u4")]
        numbers = [pa.array([len(sizes)], pa.int32()), pa.array([int(np.count_nonzero(sizes))], pa.int64()), pa.array([int(sizes.sum())], pa.int64())]
        return pa.RecordBatch.from_arrays([*numbers, *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], [f.split()[0] for f in POSTINGS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, held = [], [], []
        docs = postings = 0
        for batch in batches:
            data, offsets = W.text_buffers(batch.column(1))
            own = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for i, end in W.chunked(offsets):
                while i < end:  # a chunk of very short texts may hold more than a shard
                    j = min(end, i + SHARD_DOCS)
                    w = W.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], letters=True)
                    at = np.minimum(np.searchsorted(terms, w.hash), max(len(terms) - 1, 0))
                    hit = np.flatnonzero(terms[at] == w.hash) if len(terms) else at[:0]
                    keys, tf = np.unique(w.row[hit] * len(terms) + at[hit], return_counts=True)
                    if docs and docs + j - i > SHARD_DOCS:
                        yield row(ids, sizes, held)
                        ids, sizes, held, docs, postings = [], [], [], 0, 0
                    held.append((keys % max(len(terms), 1), keys // max(len(terms), 1) + docs, tf))
                    ids.append(own[i:j])
                    sizes.append(np.diff(w.first))
                    docs += j - i
                    postings += len(keys)
                    if postings >= SHARD_POSTINGS:
                        yield row(ids, sizes, held)
                        ids, sizes, held, docs, postings = [], [], [], 0, 0
                    i = j
        if docs:
            yield row(ids, sizes, held)

    return run


def _frequencies(n_terms: int):
    """Partial document frequencies (term, df) of the postings of a task."""

    def run(batches):
        df = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                df[np.frombuffer(terms.as_buffer(), "<u4")] += np.frombuffer(counts.as_buffer(), "<u4")
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], ["term", "df"])

    return run


def _quantised(live: int, words: int):
    """Adds the upper level to postings."""

    def run(batches):
        for batch in batches:
            bytes_ = []
            for sizes, places, tf in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("sizes", "places", "tf")), strict=True):
                m = length_norm(np.frombuffer(sizes.as_buffer(), "<u4").astype(np.int64), live, words)
                x = impact(np.frombuffer(tf.as_buffer(), "<u4").astype(np.int64), m[np.frombuffer(places.as_buffer(), "<u2")])
                bytes_.append((-(-x // STEP)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bytes_, pa.binary())], [*batch.schema.names, "bytes"])

    return run


class Index:
    """Saved rows of both levels with the statistics they are based on."""

    def __init__(self, rows: DataFrame, terms: np.ndarray, df: np.ndarray, live: int, words: int):
        self.rows, self.terms, self.df, self.live, self.words = rows, terms, df, live, words

    def weights(self) -> np.ndarray:
        """floor(1000 ln((2 N + 2) / (2 df + 1))) of every term."""
        return np.floor(1000 * np.log((2.0 * self.live + 2) / (2.0 * self.df + 1))).astype(np.int64)


def build_index(docs: DataFrame, terms: np.ndarray) -> Index:
    """Index of all texts over ``terms`` (sorted hashes)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    postings = shared.save(texts.mapInArrow(_postings(terms), POSTINGS), "postings")
    live, words = (int(x or 0) for x in postings.agg(F.sum("live"), F.sum("words")).first())
    partial = postings.select("terms", "counts").mapInArrow(_frequencies(len(terms)), "term long, df long")
    found = partial.groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row a term of the block at most
    df = np.zeros(len(terms), dtype=np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    rows = shared.save(postings.mapInArrow(_quantised(live, words), POSTINGS + ", bytes binary"), "lexical")
    shared.drop(postings)
    return Index(rows, terms, df, live, words)


class Shard:
    """A row of the index, ready for search."""

    def __init__(self, row: dict, live: int, words: int):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.terms = read("ids", "<i8"), read("terms", "<u4")
        self.m = length_norm(read("sizes", "<u4").astype(np.int64), live, words)
        self.begin = np.append(0, np.cumsum(read("counts", "<u4").astype(np.int64)))
        self.places, self.tf = read("places", "<u2").astype(np.int64), read("tf", "<u4")
        self.bytes = read("bytes", np.uint8).astype(np.int64)
        self.dense: dict[int, np.ndarray] = {}

    def slots(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term among those of the shard, -1 if no document holds it."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def bounds(self, slots: list[int], weights: list[int]) -> np.ndarray:
        """Upper bounds of all documents, in steps."""
        total = np.zeros(len(self.ids), dtype=np.int64)
        for s, w in zip(slots, weights, strict=True):
            a, b = self.begin[s], self.begin[s + 1]
            if 2 * (b - a) > len(total):  # a term of most documents: a row of all of them adds faster
                if s not in self.dense:
                    self.dense[s] = np.zeros(len(total), dtype=np.int64)
                    self.dense[s][self.places[a:b]] = self.bytes[a:b]
                total += w * self.dense[s]
            else:
                total[self.places[a:b]] += w * self.bytes[a:b]
        return total

    def scores(self, docs: np.ndarray, slots: list[int], weights: list[int]) -> np.ndarray:
        """Exact scores of the documents at ``docs`` (ascending places)."""
        total, m = np.zeros(len(docs), dtype=np.int64), self.m[docs]
        for s, w in zip(slots, weights, strict=True):
            a, b = self.begin[s], self.begin[s + 1]
            held = self.places[a:b]
            at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            some = np.flatnonzero(held[at] == docs)
            total[some] += w * impact(self.tf[a:b][at[some]].astype(np.int64), m[some])
        return total

    def best(self, slots: list[int], weights: list[int], k: int, reached: int) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores of every document that may be among the ``k`` best and reach ``reached``."""
        steps = self.bounds(slots, weights)
        need = max(reached, 1)
        if len(steps) > k:
            kth = int(np.partition(steps, len(steps) - k)[len(steps) - k])
            need = max(need, STEP * (kth - sum(weights)))  # a byte is rounded up by less than a step
        docs = np.flatnonzero(STEP * steps >= need)
        scores = self.scores(docs, slots, weights)
        good = scores >= max(reached, 1)
        return self.ids[docs[good]], scores[good]


def _search(items: list[tuple[int | None, np.ndarray, np.ndarray]], live: int, words: int, k: int):
    """The ``k`` best documents of every item in the rows of a task; items are (id, terms, weights)."""
    every = np.concatenate([np.zeros(0, np.int64), *(terms for _, terms, _ in items)])
    cut = np.cumsum([0, *(len(terms) for _, terms, _ in items)])

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, live, words)
                slots = shard.slots(every)
                for q, (_, _, weights) in enumerate(items):
                    own = slots[cut[q] : cut[q + 1]]
                    some = np.flatnonzero(own >= 0)
                    if not len(some):
                        continue
                    ids, scores = best.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    more, found = shard.best(own[some].tolist(), weights[some].tolist(), k, int(scores[-1]) if len(scores) == k else 0)
                    ids, scores = np.append(ids, more), np.append(scores, found)
                    order = np.lexsort((ids, -scores))[:k]
                    best[q] = (ids[order], scores[order])
        for q, (ids, scores) in best.items():
            yield pa.RecordBatch.from_pydict({"query": pa.array(np.full(len(ids), q)), "item_id": pa.array([items[q][0]] * len(ids), pa.int64()), "doc_id": pa.array(ids, mask=ids == NULL_ID), "score": pa.array(scores)})

    return run


def search(index: Index, items: list[tuple[int | None, np.ndarray]], k: int) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every item; items are (id, term hashes)."""
    weight = index.weights()
    queries = []
    for item_id, hashes in items:
        terms, times = np.unique(np.searchsorted(index.terms, hashes), return_counts=True)
        some = weight[terms] > 0  # a weight of 0 adds nothing to any score
        queries.append((item_id, terms[some], (weight[terms] * times)[some]))
    found = index.rows.mapInArrow(_search(queries, index.live, index.words, k), "query long, item_id long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, benchmark: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every item of ``benchmark``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    n, size = (int(x or 0) for x in items.agg(F.count("*"), F.sum(F.octet_length("text"))).first())
    blocks = max(-(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES), 1)
    out = []
    for b in range(blocks):  # the query set in blocks, each against all documents
        block = sorted((r.item_id is not None, r.item_id or 0, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect())
        queries = [(item_id if known else None, _terms(text)) for known, item_id, text in block]
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h in queries)]))
        out.append(search(build_index(docs, terms), queries, k))
    return functools.reduce(DataFrame.unionAll, out)
