"""Benchmark decontamination by BM25 retrieval with block-max WAND.

The test items form an inverted index over words of letters and digits in lower
case, so marks glued to a passage don't hide it. An impact is the BM25 weight of a term in
an item divided by the item's score for its own text, so 1 is a whole copy and
one threshold serves all items. Items are indexed by classes of length, up to 16, 32, 64,
.. terms. Every passage of every document (windows of twice the class' length, half
overlapping, so that each span as long as an item lies within one) is a query for
all items of the class above the threshold: how far apart an item's words may
stand depends on its own length, not on other items.

A numpy pass bounds all passages of a batch first: terms of many items are set
aside as long as they make up at most half of the threshold in any item; a
passage can reach an item only if its impacts over the other terms come within
that share of the threshold. What is left is retrieved exactly, document at a
time, by block-max WAND. A retrieved item leaks if enough 5-word windows of its
question (all sentences but the last) and of its answer (the last sentence; of a
single sentence the last third) are in the passage.

The index is made by tasks, in shards of about ``SHARD_ITEMS`` items, saved in the
shared folder. One pass over the documents takes every run of ``RUN`` bytes of texts
through all shards, of which a worker keeps ``OPEN`` in memory, however many items
there are. Document frequencies, the number of items and their mean length are those of
the whole benchmark in every shard and class; the frequencies are a sorted file that
tasks map. The driver holds the names of the shards alone.

Defined cases: texts of any length are passages throughout; equal scores are all
leaks; null or wordless items match nothing; repeated items match each
under its own item_id; null and wordless documents have no passages; repeated
documents are judged each; an empty table on either side gives no leaks; other
columns are ignored, or carried along by ``decontaminate``.
"""

from __future__ import annotations

import math
import pickle
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm import shared
from turnwise.llm import words as W

SHARD_ITEMS, OPEN = 20_000, 4
#: Items of fewer terms are in one class.
SHORTEST = 16
#: Bytes of texts that go through the shards at once.
RUN = 16_000_000
BLOCK = 8
K1, B = 1.2, 0.75
NGRAM = 5


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return W.Words(raw, np.array([0, len(raw)]), letters=True).hash


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    every = text.split()
    cut = len(every) - max(1, len(every) // 3) if every else 0
    return " ".join(every[:cut]), " ".join(every[cut:])


def _grams(h: np.ndarray) -> np.ndarray:
    n = min(NGRAM, len(h))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = W.mix(out + h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
    return np.unique(out)


class Totals:
    """Statistics of a whole benchmark: items with terms, terms in all, document frequencies."""

    def __init__(self, items: int, words: int, frequencies: shared.Counts):
        self.items, self.words, self.counts = items, words, frequencies

    def frequencies(self, terms: np.ndarray) -> np.ndarray:
        keys, counts = self.counts.arrays()
        return counts[np.searchsorted(keys, terms)]


def length_class(n: int) -> int:
    """Terms up to which items are in one class with an item of ``n`` terms."""
    return max(SHORTEST, 1 << (n - 1).bit_length())


class Index:
    """Inverted index of test items of one class of length, with block maxima."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, whole: Totals, stride: int):
        self.threshold, self.stride = threshold, stride
        self.item_ids = [item_id for item_id, _ in items]
        hashes = [_hashes(text) for _, text in items]
        self.parts = [tuple((_grams(h), min(NGRAM, len(h))) for h in map(_hashes, split_item(text))) for _, text in items]
        n = len(hashes)
        mean = whole.words / max(whole.items, 1)
        self.terms = np.unique(np.concatenate(hashes)) if n else np.zeros(0, np.uint64)
        t = len(self.terms)
        pairs = [np.unique(np.searchsorted(self.terms, h), return_counts=True) for h in hashes]
        df = np.bincount(np.concatenate([p[0] for p in pairs]), minlength=t) if n else np.zeros(0)
        every = whole.frequencies(self.terms)
        idf = np.log1p((whole.items - every + 0.5) / (every + 0.5))
        term, item, impact = [], [], []
        for k, (ids, tf) in enumerate(pairs):
            w = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(hashes[k]) / mean))
            term.append(ids)
            item.append(np.full(len(ids), k))
            impact.append(w / w.sum())
        term, item, impact = (np.concatenate(x) if n else np.zeros(0) for x in (term, item, impact))
        order = np.lexsort((item, term))
        self.item, self.impact = item[order].astype(np.int64), impact[order]
        self.begin = np.searchsorted(term[order], np.arange(t + 1))
        self.most = np.maximum.reduceat(self.impact, self.begin[:-1]) if t else np.zeros(0)
        # terms set aside by the bound: the most frequent ones, half of the threshold in any item at most
        share = np.zeros(n)
        self.common = np.zeros(t, dtype=bool)
        for k in np.argsort(-df, kind="stable").tolist():
            at = slice(self.begin[k], self.begin[k + 1])
            if df[k] <= 2 or (share[self.item[at]] + self.impact[at]).max() > threshold / 2:
                break
            share[self.item[at]] += self.impact[at]
            self.common[k] = True
        self.floor = threshold - share - 1e-9  # what the other terms of a passage must bring
        self.blocks = {}

    def lists(self, term: int):
        """Items, impacts, block maxima and last items of blocks of a term."""
        if term not in self.blocks:
            a, b = self.begin[term], self.begin[term + 1]
            items, impacts = self.item[a:b].tolist(), self.impact[a:b].tolist()
            tops = [max(impacts[k : k + BLOCK]) for k in range(0, b - a, BLOCK)]
            lasts = [items[min(k + BLOCK, b - a) - 1] for k in range(0, b - a, BLOCK)]
            self.blocks[term] = (items, impacts, tops, lasts)
        return self.blocks[term]

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose score reaches the threshold, by block-max WAND."""
        end = len(self.item_ids)
        need = self.threshold - 1e-9
        # a cursor: place, items, impacts, block maxima, block ends, list maximum
        cursors = [[0, *self.lists(t), float(self.most[t])] for t in terms]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[1][c[0]])
            total, pivot = 0.0, None
            for k, c in enumerate(cursors):
                total += c[5]
                if total >= need:
                    pivot = k
                    break
            if pivot is None:
                break
            d = cursors[pivot][1][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]] == d:
                pivot += 1
            bound, skip = 0.0, end
            for c in cursors[: pivot + 1]:  # shallow moves: only block ends are looked at
                k = c[0] // BLOCK
                while k < len(c[4]) and c[4][k] < d:
                    k += 1
                if k < len(c[4]):
                    bound += c[3][k]
                    skip = min(skip, c[4][k] + 1)
            if bound >= need:
                if cursors[0][1][cursors[0][0]] == d:
                    score = sum(c[2][c[0]] for c in cursors[: pivot + 1])
                    if score >= need:
                        out.append((d, score))
                    target = d + 1
                else:
                    target = d
            else:
                if pivot + 1 < len(cursors):
                    skip = min(skip, cursors[pivot + 1][1][cursors[pivot + 1][0]])
                target = max(skip, d + 1)
            alive = []
            for k, c in enumerate(cursors):
                if k <= pivot:
                    while c[0] < len(c[1]) and c[1][c[0]] < target:
                        b = c[0] // BLOCK
                        c[0] = (b + 1) * BLOCK if c[4][b] < target else c[0] + 1
                if c[0] < len(c[1]):
                    alive.append(c)
            cursors = alive
        return out

    def leaks(self, w: W.Words, question: float, answer: float):
        """(row, item, score, question overlap, answer overlap) of the words of a run of texts."""
        best: dict[tuple[int, int], tuple] = {}
        if not len(self.terms):
            return []
        at = np.minimum(np.searchsorted(self.terms, w.hash), len(self.terms) - 1)
        hit = self.terms[at] == w.hash
        rare = np.flatnonzero(hit & ~self.common[at])
        stride = self.stride
        # word i of a text lies in its passages i // stride - 1 and i // stride; a text's passages are numbered apart
        local = np.arange(len(w)) - w.first[:-1][w.row]
        per = -(-np.diff(w.first) // stride) + 1
        base = np.cumsum(per) - per
        passage = base[w.row] + local // stride + 1
        p = np.concatenate([passage[rare], passage[rare] - 1])
        key = np.unique(p * len(self.terms) + np.concatenate([at[rare], at[rare]]))
        p, t = key // len(self.terms), key % len(self.terms)
        size = self.begin[t + 1] - self.begin[t]
        done = np.cumsum(size)
        flat = np.repeat(self.begin[t] - (done - size), size) + np.arange(done[-1] if len(done) else 0)
        pair = np.repeat(p, size) * len(self.item_ids) + self.item[flat]
        pairs, inv = np.unique(pair, return_inverse=True)
        total = np.bincount(inv, weights=self.impact[flat], minlength=len(pairs))
        for q in np.unique(pairs[total >= self.floor[pairs % len(self.item_ids)]] // len(self.item_ids)).tolist():
            row = int(np.searchsorted(base, q, side="right")) - 1
            a = w.first[row] + max(q - base[row] - 1, 0) * stride
            b = min(w.first[row] + (q - base[row] + 1) * stride, w.first[row + 1])
            h, inside = w.hash[a:b], at[a:b][hit[a:b]]
            grams: dict[int, np.ndarray] = {}
            for k, score in self.search(np.unique(inside).tolist()):
                over = []
                for want, n in self.parts[k]:
                    if n and n not in grams:
                        grams[n] = _grams_of(h, n)
                    over.append(float(np.isin(want, grams[n]).mean()) if n else 1.0)
                if over[0] >= question and over[1] >= answer and score > best.get((row, k), (0.0,))[0]:
                    best[row, k] = (score, *over)
        return [(row, self.item_ids[k], *x) for (row, k), x in sorted(best.items())]


def _grams_of(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = W.mix(out + h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
    return out


def _term_counts(batches):
    """(term, 1) of every term of an item, and (null, number of terms) of the item."""
    for batch in batches:
        terms, counts, sizes = [], [], []
        for text in batch.column(0).to_pylist():
            h = _hashes(text)
            terms.append(np.unique(h))
            sizes += [len(h)] * bool(len(h))
        terms = np.concatenate([np.zeros(0, np.uint64), *terms])
        counts = np.append(np.ones(len(terms), np.int64), np.array(sizes, np.int64))
        mask = np.append(np.zeros(len(terms), bool), np.ones(len(sizes), bool))
        yield pa.RecordBatch.from_pydict({"key": pa.array(np.append(terms.view(np.int64), np.zeros(len(sizes), np.int64)), mask=mask), "n": pa.array(counts)})


def build_indexes(items: list[tuple[int, str]], threshold: float, whole: Totals) -> list[Index]:
    """An index a class of length; items without terms match nothing."""
    classes: dict[int, list] = {}
    for item_id, text in items:
        if n := len(_hashes(text or "")):
            classes.setdefault(length_class(n), []).append((item_id, text))
    return [Index(classes[stride], threshold, whole, stride) for stride in sorted(classes)]


def _shards(benchmark: DataFrame, threshold: float) -> list[str]:
    """Files of indexes of about SHARD_ITEMS items each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    path = shared.fresh(spark, "bm25")
    shared.make_dir(path)
    counts = items.select("text").mapInArrow(_term_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("c"), F.count("*").alias("rows"))
    counts = shared.save(counts, "terms")
    total = counts.filter("key IS NULL").first()
    if total is None:
        return []
    whole = Totals(total.rows, total.c, shared.Counts.write(f"{path}/frequencies", counts.filter("key IS NOT NULL")))
    shared.drop(counts)

    def build(batches):
        part = sorted((i is not None, i or 0, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if part:
            uri = f"{path}/shard-{TaskContext.get().partitionId():05d}"
            out = shared.Writer(uri)
            out.write(pickle.dumps(build_indexes([(i if known else None, t) for known, i, t in part], threshold, whole)))
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri]})

    shards = -(-whole.items // SHARD_ITEMS)
    dealt = items.repartition(shards, F.xxhash64("item_id", "text"))
    return sorted(r.uri for r in dealt.mapInArrow(build, "uri string").collect())  # a row a shard


@lru_cache(maxsize=OPEN)
def _opened(uri: str) -> list[Index]:
    return pickle.loads(shared.read_bytes(uri))


def _found(files: list[str], texts: pa.Array, question: float, answer: float):
    """Leaks of a column of texts, by row, over all shards."""
    data, offsets = W.text_buffers(texts)
    for i, j in W.chunked(offsets, RUN):
        w = W.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], letters=True)
        for uri in files:
            for index in _opened(uri):
                for row, *rest in index.leaks(w, question, answer):
                    yield i + row, *rest


def _runs(batches, column: str):
    """Batches put together until their texts hold RUN bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= RUN:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.7, answer: float = 0.7) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of all leaks."""
    files = _shards(benchmark, threshold)

    def judge(batches):
        for run in _runs(batches, "text"):
            found = list(_found(files, run.column(1), question, answer))
            if found:
                row, item, *rest = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([run.column(0).take(pa.array(row)).combine_chunks(), pa.array(item, pa.int64()), *(pa.array(x) for x in rest)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.7, answer: float = 0.7) -> DataFrame:
    """The documents of ``docs`` without a leak, with all of their columns."""
    files = _shards(benchmark, threshold)

    def judge(batches):
        for run in _runs(batches, "text"):
            keep = np.ones(run.num_rows, dtype=bool)
            for row, *_ in _found(files, run.column("text"), question, answer):
                keep[row] = False
            yield from run.filter(pa.array(keep)).to_batches()

    return docs.mapInArrow(judge, docs.schema)
