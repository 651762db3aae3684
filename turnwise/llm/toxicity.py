"""Toxicity by compression distance with two zstandard dictionaries.

One dictionary is trained on ordinary text, one on toxic text. Both begin with
a body trained on ordinary windows; behind it each has the words that only its
own class has (for the toxic one: words seen in several contexts, so that copies
of one document don't count as evidence), those of most contexts last and at most
``EXTRA`` bytes of them. A window is one word of letters and
digits in a fixed ordinary frame, whose cost cancels; every word of the whole
text is such a window. A window is compressed with both dictionaries, and its
gain is the bytes that the toxic one saves; a worker does this once for each
distinct word and keeps the result in a bounded cache. The statistic of a text is
the sum of its two largest gains. A threshold on it is calibrated on labelled
documents that the dictionaries haven't seen, and mapped to the score 0.7; scores
rise with the statistic.

Labels are read of rows whose crc32(doc_id as text) mod 3 is not 1, from a sample
of at most ``sample`` documents and ``sample_bytes`` of text a class (those of the
least hashes, as far as they fit). Scores use the text alone, and all of it.

Defined cases: null, empty and wordless texts have no window and the least
score; texts of any length are scored whole; of rows with one labelled doc_id the
least text is read; equal texts have equal scores; repeated rows are scored alike; a doc_id labelled more than once is toxic
if any label is 1; null labels are ignored; without both classes in the sample
every score is 0; an empty table gives no rows; other columns are ignored, or
carried along by ``drop_toxic``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm import words as W

#: Defaults of the sample's bounds, documents and bytes a class.
SAMPLE, SAMPLE_BYTES = 6000, 24_000_000
WINDOW = 96
#: Bytes of the body that both dictionaries share, and of the words of one class behind it.
BODY, EXTRA = 32_000, 16_000
CUT = 0.7
#: Distinct words whose gains a worker keeps before it starts anew.
CACHE = 1_000_000
_RARE = bytes(37 * k % 128 + 128 for k in range(48))
_made: dict[bytes, tuple] = {}


class Model:
    """Dictionary contents and calibration; small enough to send to workers."""

    def __init__(self, ordinary: bytes, toxic: bytes, body: int = 0, threshold: float = 0.0, slope: float = 1.0):
        self.ordinary, self.toxic, self.threshold, self.slope = ordinary, toxic, threshold, slope
        # ordinary text that both dictionaries hold makes the block worth compressing, distinct bytes keep
        # the parser's price of literals near their cost, and no match starts in the last bytes of a block
        self.frame = ordinary[max(body - 40, 0) : max(body - 8, 0)] + b" " + _RARE[16:] + b" "
        self.tail = _RARE[:16]

    def _compressors(self):
        key = self.toxic
        if key not in _made:
            made = []
            for content in (self.ordinary, self.toxic):
                params = zstd.ZstdCompressionParameters(window_log=17, chain_log=17, hash_log=17, search_log=5, min_match=3, target_length=32, strategy=zstd.STRATEGY_BTULTRA2, write_content_size=False, write_checksum=False, write_dict_id=False)
                d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                made.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))
            _made.clear()
            _made[key] = (*made, _Cache())
        return _made[key]

    def gains(self, w: W.Words) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each word."""
        ordinary, toxic, cache = self._compressors()
        keys, where, inv = np.unique(w.hash, return_index=True, return_inverse=True)
        new = cache.missing(keys)
        raw = w.data.tobytes().lower()
        at = where[new]
        made = [self.frame + raw[a:b] + b" " + self.tail for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
        cache.add(keys[new], np.array([len(ordinary.compress(x)) - len(toxic.compress(x)) for x in made], dtype=np.int16))
        return cache.get(keys)[inv]

    def statistics(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The sum of the two largest gains of each text."""
        best = np.zeros((len(offsets) - 1, 2))
        if not self.toxic:
            return best[:, 0]
        w = W.Words(data, offsets, letters=True)
        gain = self.gains(w)
        use = np.flatnonzero(gain > 0)
        row, gain = w.row[use], gain[use].astype(float)
        order = np.lexsort((-gain, row))
        row, gain = row[order], gain[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
        best[row[first], 0] = gain[first]
        two = first[np.append(first[1:], len(row)) - first > 1] + 1 if len(first) else first
        best[row[two], 1] = gain[two]
        return best.sum(axis=1)

    def scores(self, statistic: np.ndarray) -> np.ndarray:
        if not self.toxic:
            return np.zeros(len(statistic))
        return 1 / (1 + np.exp(-(self.slope * (statistic - self.threshold) + math.log(CUT / (1 - CUT)) + 1e-9)))


class _Cache:
    """Gains by word hash, sorted by hash."""

    def __init__(self):
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int16)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        if len(self.keys) + len(keys) > CACHE:
            self.__init__()
        at = np.searchsorted(self.keys, keys)
        ok = at < len(self.keys)
        ok[ok] = self.keys[at[ok]] == keys[ok]
        return np.flatnonzero(~ok)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values)

    def get(self, keys: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.keys, keys)]


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, list[bytes]]:
    """Windows of every text, cut before words, in lower case, and their rows."""
    w = W.Words(data, offsets)
    if not len(w):
        return np.zeros(0, np.int64), []
    slot = (w.start - offsets[w.row]) // size
    new = np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (w.row[1:] != w.row[:-1])))
    end = w.end[np.append(new[1:], len(w)) - 1]
    raw = data.tobytes().lower()
    return w.row[new], [raw[a:b] for a, b in zip(w.start[new].tolist(), end.tolist(), strict=True)]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """Content of a dictionary trained on ``samples``, or they themselves if few."""
    try:
        return zstd.train_dictionary(size, samples, k=64, d=6).as_bytes()
    except zstd.ZstdError:
        return b" ".join(samples)[-size:]


def _column(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return W.text_buffers(pa.array(texts, pa.large_string()))


def _parts(texts: list[str], n: int = 100) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns of a few texts each, to bound what is in memory at once."""
    for k in range(0, len(texts), n):
        yield _column(texts[k : k + n])


def _vocabulary(texts: list[str]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(W.Words(*c, letters=True).hash) for c in _parts(texts))]))


def _own_words(texts: list[str], other: np.ndarray, contexts: int) -> list[bytes]:
    """Words that ``other`` lacks, by number of different words before them."""
    before: dict[int, set[int]] = defaultdict(set)
    said: dict[int, bytes] = {}
    for c in _parts(texts):
        w = W.Words(*c, letters=True)
        raw = w.data.tobytes().lower()
        for k in np.flatnonzero(~np.isin(w.hash, other)).tolist():
            h = int(w.hash[k])
            before[h].add(int(w.hash[k - 1]) if k else 0)
            said.setdefault(h, raw[w.start[k] : w.end[k]])
    found = sorted((len(b), h) for h, b in before.items() if len(b) >= contexts)
    return [b" " + said[h] for _, h in found]


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from the larger part of each class, threshold from the rest."""
    if not toxic or not ordinary:
        return Model(b"", b"")
    tox_fit, tox_cal = toxic[: -(-2 * len(toxic) // 3)], toxic[-(-2 * len(toxic) // 3) :] or toxic
    ord_fit, ord_cal = ordinary[: -(-2 * len(ordinary) // 3)], ordinary[-(-2 * len(ordinary) // 3) :] or ordinary
    vocab = [_vocabulary(t) for t in (tox_fit, ord_fit)]
    least = max(3, len(tox_fit) // 60)
    body = _trained(BODY, [p for c in _parts(ord_fit) for p in windows(*c)[1]])
    own = [_own_words(tox_fit, vocab[1], least), _own_words(ord_fit, vocab[0], least)]
    toxic_part, ordinary_part = (b" " + b"".join(x)[-EXTRA:] + b" " for x in own)
    size = len(toxic_part)
    end = body[:32]  # the last bytes of a dictionary are never found
    model = Model(body + (b" " * size + ordinary_part)[-size:] + end, body + toxic_part + end, len(body))
    stat = [np.concatenate([model.statistics(*c) for c in _parts(t)]) for t in (tox_cal, ord_cal)]
    model.threshold, model.slope = calibrate(*stat)
    return model


def calibrate(toxic: np.ndarray, ordinary: np.ndarray) -> tuple[float, float]:
    """The threshold of best recall less twice the false alarms, and a slope."""
    values = np.unique(np.concatenate([toxic, ordinary]))
    cuts = np.append((values[1:] + values[:-1]) / 2, values[-1] + 1)
    hit = 1 - np.searchsorted(np.sort(toxic), cuts) / len(toxic)
    miss = 1 - np.searchsorted(np.sort(ordinary), cuts) / len(ordinary)
    gap = np.diff(values, append=values[-1])
    best = max(range(len(cuts)), key=lambda k: (round(hit[k] - 2 * miss[k], 9), gap[k]))
    spread = np.concatenate([toxic, ordinary]).std()
    return float(cuts[best]), float(2 / max(spread, 0.5))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from a bounded sample of the labelled rows of ``docs`` that aren't held out."""
    marks = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    marks = marks.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    chosen = None
    for value in (1, 0):
        part = marks.filter(F.col("_toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionAll(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text IS NOT NULL").groupBy("doc_id", "_toxic").agg(F.min("text").alias("text"))
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("_toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = rows.withColumn("_sum", before).filter(F.col("_sum") <= sample_bytes).collect()  # 2 * sample_bytes of text
    order = sorted(((r._toxic, hash_of(r.doc_id), r.text) for r in rows))
    return train([t for k, _, t in order if k == 1], [t for k, _, t in order if k == 0])


def hash_of(doc_id: int) -> int:
    return int(W.mix(np.array([doc_id], dtype=np.int64).view(np.uint64))[0])


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every text of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch in batches:
            data, offsets = W.text_buffers(batch.column(2))
            score = np.concatenate([np.zeros(0), *(sent.value.scores(sent.value.statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in W.chunked(offsets))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with all of their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch in batches:
            data, offsets = W.text_buffers(batch.column(batch.schema.get_field_index("text")))
            keep = [sent.value.scores(sent.value.statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) < CUT for i, j in W.chunked(offsets)]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)
