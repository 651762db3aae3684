"""Language-model scoring by a sharded Elias-Fano n-gram trie.

The model is a trigram model by count merging: shorter n-grams are added as pseudo
counts. With p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),

    p(w | u v) = (c(u v w) + tau (c(v w) + mu p(w))) / (c(u v) + tau (c(v) + mu)),

which sums to 1 over the vocabulary and one unknown word. Tokens are words and one
end a text; before the first token stand two starts. Nothing is pruned: every
training trigram is in the model, which grows with the corpus.

The numerator needs counts of n-grams that end in w alone, the denominator those
of n-grams that end in v, the token before. So the trie is rooted at the predicted
word, its contexts go from right to left (w, then v, then u), and a shard holds all
that its words need: each token brings its own numerator and, for the token behind
it, the denominator.

* Pass 1 counts words (partial counts a task): N, V, the number of shards, and the
  words too frequent for one shard. Pass 2 counts pairs and triples of such words.
  Of each kind at most ``4 * shards`` are frequent; none of them pass the driver.
* Every token goes to its word's shard as (word, v, u, document), packed in one
  blob a shard and batch; the most frequent words have short codes there. shared.Counts words are dealt over all shards by v, frequent
  pairs by u, frequent triples by document.
* A shard first writes its trie to a file from the training tokens, then maps the
  file and looks up every token in it. What is looked up comes from the files and
  the manifest alone, as it does in ``Model``, which scores other texts.
* Partial sums of each batch of documents are added up by a last shuffle. A batch
  gets a sum for each document and shard task that share a word, so that shuffle
  grows with the number of shard tasks until a document has one word a task.

A file holds, Elias-Fano coded: the words; the contexts of the shard; sums of the
words' counts; pointers from words to their pairs and from pairs to their triples;
contexts as places among those of the shard, relative to the last of the range
before. A search is a successor search within the range of the parent. Gains
log10(numerator / (tau mu p(w))) and pairs' log10 denominators are stored in 12 bits, as
multiples of one step for the whole model: each is off by at most half of ``STEP``, and
the score of a text by at most ``STEP`` a token. ``manifest.json`` has the totals and
parameters; sorted files, which tasks map, hold the counts of frequent words, pairs and
triples. Shards and frequent n-grams follow from the number of tokens alone, so
scores don't depend on the cluster. A file's name is its shard, so another attempt of a
task replaces the file by the same content.

Words are identified by 64-bit hashes, contexts by 40 bits of them. ``base_score``
is exact up to floating point; ``score`` carries the quantisation (see above).

Defined cases: a null text is empty, its tokens are the end alone; texts of any
length are taken whole, a batch holds one text at least; repeated rows are separate
documents and train as often as they occur; a null doc_id belongs to the training
part (its checksum is taken as remainder 0) and is returned as null; equal texts
get equal scores; without training documents all counts are 0; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm import shared
from turnwise.llm import words as W
from turnwise.llm.eliasfano import EliasFano, encode

U64 = np.uint64
#: Hashes of the end and the start of a text.
END, START = U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25)
CONTEXT_BITS = 40
#: Quantisation step of log10 values; 4096 of them reach 16, which no gain does below 10^15 tokens.
STEP = 1 / 256
_DROP = U64(64 - CONTEXT_BITS)
#: Tokens a shard holds on average at most.
SHARD_TOKENS = 1_000_000
#: Shards of a small corpus, a power of two.
LEAST_SHARDS = 16
#: Tokens and documents gathered before they are packed into blobs.
FLUSH_TOKENS, FLUSH_DOCS = 2_000_000, 500_000
#: Most words with a short code in blobs (8 bytes each are sent to the workers); others are spelt out.
VOCABULARY = 400_000
#: Documents whose partial sums a shard task keeps before it returns them.
FLUSH_SUMS = 1_000_000
BLOB = "shard int, base long, docs int, tokens int, train binary, words binary, contexts binary, coded binary, ids binary, sizes binary"
SUMS = "base long, docs int, held int, known binary, sums binary, ids binary, sizes binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
NULL_ID = -(2**63)


def held_out_ids(ids: np.ndarray, modulus: int, remainder: int) -> np.ndarray:
    """Whether crc32(doc_id as text) mod ``modulus`` is ``remainder``."""
    return np.array([i != NULL_ID and zlib.crc32(b"%d" % i) % modulus == remainder for i in ids.tolist()], dtype=bool)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token, ends included, its contexts v and u (40 bits), its document."""
    w = W.Words(data, offsets)
    rows = np.arange(len(offsets) - 1)
    token = np.insert(w.hash, w.first[1:], END)
    doc = np.insert(w.row, w.first[1:], rows)
    first = w.first[:-1] + rows
    short = token >> _DROP
    v, u = np.empty_like(token), np.empty_like(token)
    v[1:], u[2:] = short[:-1], short[:-2]
    v[first] = u[first] = START >> _DROP
    second = first + 1
    second = second[second < np.append(first[1:], len(token))]
    u[second] = START >> _DROP
    return token, v, u, doc


def _pair(token: np.ndarray, v: np.ndarray) -> np.ndarray:
    return W.mix(token ^ (v * U64(0x9E3779B97F4A7C15)))


def _triple(pair: np.ndarray, u: np.ndarray) -> np.ndarray:
    return W.mix(pair ^ (u * U64(0xC2B2AE3D27D4EB4F)))


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is among the sorted ``keys``, and where."""
    if not len(keys):
        return np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x, at


def _counted(chunks, kinds: int):
    """Partial counts of (kind, key) over tokens: ``c`` in training, ``a`` in all documents."""
    held, n = [[] for _ in range(kinds)], 0

    def flush():
        for kind, parts in enumerate(held):
            if parts:
                keys, inv = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                train = np.concatenate([t for _, t in parts])
                every = np.bincount(inv, minlength=len(keys))
                c = np.bincount(inv, weights=train, minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(keys), kind), pa.int32()), "key": pa.array(keys.view(np.int64)), "c": pa.array(c), "a": pa.array(every)})
                parts.clear()

    for kind, keys, train in chunks:
        held[kind].append((keys, train))
        n += len(keys)
        if n > 4_000_000:
            yield from flush()
            n = 0
    yield from flush()


def _chunks(batches, modulus: int, remainder: int):
    for batch in batches:
        data, offsets = W.text_buffers(batch.column(1))
        ids = _ids(batch.column(0))
        for i, j in W.chunked(offsets):
            yield ids[i:j], _tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _count_words(modulus: int, remainder: int):
    def run(batches):
        def chunks():
            for ids, (token, _, _, doc) in _chunks(batches, modulus, remainder):
                yield 0, token, ~held_out_ids(ids, modulus, remainder)[doc]

        yield from _counted(chunks(), 1)

    return run


def _count_frequent(often: shared.Counts, modulus: int, remainder: int):
    """Pairs (kind 0) and triples (kind 1) of frequent words; starts count as frequent."""

    def run(batches):
        words = often.arrays()[0]
        short = np.unique(np.append(words >> _DROP, START >> _DROP))

        def chunks():
            for ids, (token, v, u, doc) in _chunks(batches, modulus, remainder):
                some = np.flatnonzero(_find(words, token)[0] & _find(short, v)[0])
                train = ~held_out_ids(ids, modulus, remainder)[doc[some]]
                pair = _pair(token[some], v[some])
                yield 0, pair, train
                more = _find(short, u[some])[0]
                yield 1, _triple(pair[more], u[some][more]), train[more]

        yield from _counted(chunks(), 2)

    return run


class Parameters:
    """What all shards share: totals, parameters and the counts of frequent n-grams."""

    def __init__(self, mu: float, tau: float, shards: int, total: int, distinct: int, starts: int, often: list[shared.Counts]):
        self.mu, self.tau, self.shards, self.total, self.distinct, self.starts = mu, tau, shards, total, distinct, starts
        self.often = often
        self.norm = total + 0.5 * (distinct + 1)

    def manifest(self) -> str:
        own = {k: getattr(self, k) for k in ("mu", "tau", "shards", "total", "distinct", "starts")}
        return json.dumps(own | {"frequent": [f.size for f in self.often]})

    @staticmethod
    def read(model_dir: str) -> Parameters:
        d = json.loads(shared.read_bytes(f"{model_dir}/manifest.json").decode())
        return Parameters(**{k: v for k, v in d.items() if k != "frequent"}, often=[shared.Counts(_often_file(model_dir, k), n) for k, n in enumerate(d["frequent"])])

    def frequent(self, kind: int, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``counts`` with those of frequent n-grams put in, and where they are."""
        keys, values = self.often[kind].arrays()
        hit, at = _find(keys, x)
        return (np.where(hit, values[at], counts), hit) if len(keys) else (counts, hit)

    def shard(self, token: np.ndarray, v: np.ndarray, u: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The shard of every token; ``doc`` tells documents apart."""
        key = token.copy()
        some = np.flatnonzero(_find(self.often[0].arrays()[0], token)[0])
        key[some] = _pair(token[some], v[some])
        some = some[_find(self.often[1].arrays()[0], key[some])[0]]
        key[some] = _triple(key[some], u[some])
        some = some[_find(self.often[2].arrays()[0], key[some])[0]]
        key[some] = W.mix(key[some] ^ doc[some].astype(np.uint64))
        return (key >> U64(65 - self.shards.bit_length())).astype(np.int64)

    def gain2(self, c1, c2):
        return np.log10(1 + c2 * self.norm / (self.mu * (c1 + 0.5)))

    def gain3(self, c1, c2, c3):
        return np.log10(1 + (c2 + c3 / self.tau) * self.norm / (self.mu * (c1 + 0.5)))

    def ahead(self, c1, c2):
        """log10 of the denominator behind a word of count c1 whose pair has count c2."""
        return np.log10(c2 + self.tau * (c1 + self.mu))

    def finish(self, tokens, base, score):
        """(base_score, score) of texts from their sums over tokens."""
        norm = math.log10(self.norm)
        first = math.log10(self.starts + self.tau * (self.starts + self.mu))
        return base - tokens * norm, score + tokens * (math.log10(self.tau * self.mu) - norm) - first


def _file(model_dir: str, shard: int) -> str:
    return f"{model_dir}/trie-{shard:07d}.ef"


def _often_file(model_dir: str, kind: int) -> str:
    return f"{model_dir}/frequent-{kind}"


def _coded(values: np.ndarray) -> bytes:
    """Values in 12 bits: a plane of low bytes, then one of high halves, two a byte."""
    code = np.clip(np.rint(values / STEP), 0, 4095).astype(np.uint16)
    high = np.append(code >> 8, np.zeros(len(code) % 2, np.uint16)).astype(np.uint8)
    raw = (code & 255).astype(np.uint8).tobytes() + (high[::2] | (high[1::2] << 4)).tobytes()
    return raw + bytes(-len(raw) % 8)


class Coded:
    """The values of ``_coded`` by their place."""

    def __init__(self, raw: np.ndarray, n: int):
        self.low, self.high = raw[:n], raw[n : n + (n + 1) // 2]
        self.size = n + (n + 1) // 2 + -(n + (n + 1) // 2) % 8

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        high = (self.high[at >> 1] >> ((at & 1) << 2).astype(np.uint8)) & np.uint8(15)
        return STEP * (self.low[at] + 256.0 * high)


def _relative(place: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Increasing code of places that increase within ranges starting at ``begin``."""
    n = len(place)
    if not n:
        return place
    size = np.diff(np.append(begin, n))
    last = place[np.append(begin[1:], n) - 1] + U64(1)
    before = np.cumsum(last, dtype=np.uint64) - last
    return np.repeat(before, size) + place + U64(1)


def build_trie(word: np.ndarray, v: np.ndarray, u: np.ndarray, par: Parameters) -> bytes:
    """The file of a shard from its training tokens sorted by (word, v, u)."""
    n = len(word)
    edge = np.ones(min(n, 1), dtype=bool)
    new_w = np.append(edge, word[1:] != word[:-1])
    new_p = new_w | np.append(edge, v[1:] != v[:-1])
    new_t = new_p | np.append(edge, u[1:] != u[:-1])
    w_at, p_at, t_at = (np.flatnonzero(x) for x in (new_w, new_p, new_t))
    c1, c2, c3 = (np.diff(np.append(x, n)) for x in (w_at, p_at, t_at))
    words, (pw, pv), (tp, tu) = word[w_at], (word[p_at], v[p_at]), (_pair(word[t_at], v[t_at]), u[t_at])
    c1 = par.frequent(0, words, c1)[0]
    c2 = par.frequent(1, _pair(pw, pv), c2)[0]
    c3 = par.frequent(2, _triple(tp, tu), c3)[0]
    p_in, t_in = np.cumsum(new_w)[p_at] - 1, np.cumsum(new_p)[t_at] - 1  # parents
    contexts = np.unique(np.concatenate([pv, tu]))
    first2, first3 = np.searchsorted(p_in, np.arange(len(words) + 1)), np.searchsorted(t_in, np.arange(len(pv) + 1))
    place = lambda x: np.searchsorted(contexts, x).astype(np.uint64)
    c1p = c1[p_in]
    values = par.gain2(c1p, c2), par.ahead(c1p, c2), par.gain3(c1p[t_in], c2[t_in], c3)
    levels = [words, contexts, np.append(0, np.cumsum(c1)), first2, _relative(place(pv), first2[:-1]), first3, _relative(place(tu), first3[:-1])]
    return b"".join([*(encode(x) for x in levels), *(_coded(x) for x in values)])


class Trie:
    """A shard's trie in a memory-mapped file."""

    def __init__(self, raw: np.ndarray):
        body, at, levels = raw.view("<u8"), 0, []
        for _ in range(7):
            levels.append(EliasFano(body[at:]))
            at += levels[-1].size
        self.words, self.contexts, self.counts, self.first2, self.pairs, self.first3, self.triples = levels
        at *= 8
        self.values = []  # gains of pairs, denominators behind pairs, gains of triples
        for level in (self.pairs, self.pairs, self.triples):
            self.values.append(Coded(raw[at:], level.n))
            at += self.values[-1].size

    def _child(self, level: EliasFano, first: EliasFano, parent: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Place in ``level`` of each (parent, context), -1 if there is none."""
        begin, end = first.access(parent).astype(np.int64), first.access(parent + 1).astype(np.int64)
        last = np.where(begin > 0, level.access(np.maximum(begin - 1, 0)), U64(0))
        want = last + place.astype(np.uint64) + U64(1)
        at = level.successor(want)
        ok = np.flatnonzero(at < end)
        out = np.full(len(parent), -1)
        good = ok[level.access(at[ok]) == want[ok]]
        out[good] = at[good]
        return out

    def _context(self, x: np.ndarray) -> np.ndarray:
        at = self.contexts.successor(x)
        ok = np.flatnonzero(at < self.contexts.n)
        out = np.full(len(x), -1)
        good = ok[self.contexts.access(at[ok]) == x[ok]]
        out[good] = at[good]
        return out

    def lookup(self, word: np.ndarray, v: np.ndarray, u: np.ndarray, par: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count of each word, gain of its trigram, log10 denominator behind it.

        Equal neighbours are looked up once.
        """
        n = len(word)
        edge = np.ones(min(n, 1), dtype=bool)
        new_w = np.append(edge, word[1:] != word[:-1])
        new_p = new_w | np.append(edge, v[1:] != v[:-1])
        of_w, of_p = np.cumsum(new_w) - 1, np.cumsum(new_p) - 1
        # words
        w = word[new_w]
        k = self.words.successor(w)
        some = np.flatnonzero(k < self.words.n)
        some = some[self.words.access(k[some]) == w[some]]
        c1 = np.zeros(len(w), dtype=np.int64)
        c1[some] = (self.counts.access(k[some] + 1) - self.counts.access(k[some])).astype(np.int64)
        parent = np.full(len(w), -1)
        parent[some] = k[some]
        c1 = par.frequent(0, w, c1)[0]
        # pairs
        in_w = of_w[new_p]
        pv, pc1 = v[new_p], c1[in_w]
        pair = np.full(len(pv), -1)
        some = np.flatnonzero(parent[in_w] >= 0)
        place = self._context(pv[some])
        some, place = some[place >= 0], place[place >= 0]
        pair[some] = self._child(self.pairs, self.first2, parent[in_w[some]], place)
        seen = pair >= 0
        gain2, ahead = np.zeros(len(pv)), par.ahead(pc1, 0)
        gain2[seen], ahead[seen] = self.values[0][pair[seen]], self.values[1][pair[seen]]
        pkey = _pair(w[in_w], pv)
        c2, often = par.frequent(1, pkey, np.zeros(len(pv), dtype=np.int64))
        gain2[often], ahead[often] = par.gain2(pc1[often], c2[often]), par.ahead(pc1[often], c2[often])
        # triples
        gain = gain2[of_p]
        some = np.flatnonzero(pair[of_p] >= 0)
        place = self._context(u[some])
        some, place = some[place >= 0], place[place >= 0]
        at = self._child(self.triples, self.first3, pair[of_p[some]], place)
        some, at = some[at >= 0], at[at >= 0]
        gain[some] = self.values[2][at]
        c3, often = par.frequent(2, _triple(pkey[of_p], u), np.zeros(n, dtype=np.int64))
        gain[often] = par.gain3(c1[of_w][often], c2[of_p][often], c3[often])
        return c1[of_w], gain, np.where(word == END, 0.0, ahead[of_p])


def _terms(trie: Trie | None, word, v, u, par: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each token is known, its base term and its share of the score."""
    count, gain, ahead = trie.lookup(word, v, u, par)
    base = np.log10(count + 0.5)
    return count > 0, base, base + gain - ahead


class Model:
    """A saved model; scores texts from its files and manifest alone."""

    def __init__(self, model_dir: str, keep: int = 64):
        self.dir, self.keep = model_dir, keep
        self.par = Parameters.read(model_dir)
        self.open: OrderedDict[int, Trie] = OrderedDict()
        self.empty = Trie(np.frombuffer(build_trie(*(np.zeros(0, np.uint64) for _ in range(3)), self.par), np.uint8))

    def _trie(self, shard: int) -> Trie:
        if shard not in self.open:
            path = _file(self.dir, shard)
            self.open[shard] = Trie(shared.mapped(path)) if shared.exists(path) else self.empty
            if len(self.open) > self.keep:
                self.open.popitem(last=False)
        self.open.move_to_end(shard)
        return self.open[shard]

    def score(self, texts: list[str]) -> list[tuple[int, int, float, float]]:
        """(n_tokens, n_known, base_score, score) of each text."""
        token, v, u, doc = _tokens(*W.text_buffers(pa.array(texts, pa.large_string())))
        shard = self.par.shard(token, v, u, doc)
        sums = np.zeros((3, len(texts)))
        for s in np.unique(shard).tolist():
            at = np.flatnonzero(shard == s)
            for r, x in enumerate(_terms(self._trie(s), token[at], v[at], u[at], self.par)):
                sums[r] += np.bincount(doc[at], weights=x, minlength=len(texts))
        n = np.bincount(doc, minlength=len(texts))
        base, score = self.par.finish(n, sums[1], sums[2])
        return list(zip(n.tolist(), sums[0].astype(int).tolist(), base.tolist(), score.tolist(), strict=True))


class Vocabulary:
    """Short codes of the most frequent words: 1, 2, .. by count, 0 for all others."""

    def __init__(self, words: np.ndarray):
        self.words, self.short = words, words >> _DROP
        self.order, self.short_order = np.argsort(words), np.argsort(self.short)

    def code(self, x: np.ndarray, short: bool) -> np.ndarray:
        keys, order = (self.short, self.short_order) if short else (self.words, self.order)
        hit, at = _find(keys[order], x)
        return np.where(hit, order[at] + 1, 0) if len(keys) else np.zeros(len(x), dtype=np.int64)

    def decode(self, code: np.ndarray, others: np.ndarray, short: bool) -> np.ndarray:
        """The values of ``code``; ``others`` are those of the zeros, in order."""
        out = np.empty(len(code), dtype=np.uint64)
        rare = code == 0
        out[rare] = others
        out[~rare] = (self.short if short else self.words)[code[~rare] - 1]
        return out


def _planes(columns: list[np.ndarray]) -> bytes:
    """Columns of 32-bit integers byte plane by byte plane, compressed: most high bytes are 0."""
    return zstd.ZstdCompressor(level=1).compress(b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in columns))


def _columns(raw: bytes, n: int) -> np.ndarray:
    """The columns back, one a row."""
    planes = np.frombuffer(zstd.ZstdDecompressor().decompress(raw), np.uint8).reshape(-1, 4, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[:, :, 0].astype(np.int64)


def _five(x: np.ndarray) -> bytes:
    """The five bytes of contexts, plane by plane."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(5, -1).T
    return out.view("<u8").ravel()


def _blobs(par: Parameters, often: np.ndarray, modulus: int, remainder: int):
    kinds = {"shard": pa.int32(), "base": pa.int64(), "docs": pa.int32(), "tokens": pa.int32()}
    names = [f.split()[0] for f in BLOB.split(", ")]

    def pack(vocabulary, base, ids, sizes, token, v, u, doc):
        flags = np.packbits(~held_out_ids(ids, modulus, remainder)).tobytes()
        shard = par.shard(token, v, u, doc + base)
        order = np.argsort(shard.astype(np.uint16) if par.shards <= 1 << 16 else shard, kind="stable")
        token = token[order]  # one by one, so that the arrays before go
        v = v[order]
        u = u[order]
        doc = doc[order]
        codes = [vocabulary.code(x, short) for x, short in ((token, False), (v, True), (u, True))]
        cut = np.append(0, np.cumsum(np.bincount(shard, minlength=par.shards)))
        rows = [{"shard": base % par.shards, "base": base, "docs": len(ids), "ids": ids.tobytes(), "sizes": sizes.astype("<u4").tobytes()}]

        def table():
            out = pa.RecordBatch.from_pydict({k: pa.array([r.get(k) for r in rows], kinds.get(k, pa.binary())) for k in names})
            rows.clear()
            return out

        for s in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[s], cut[s + 1]
            w, cv, cu = (x[a:b] for x in codes)
            rare = {"words": token[a:b][w == 0].tobytes(), "contexts": _five(np.concatenate([v[a:b][cv == 0], u[a:b][cu == 0]]))}
            rows.append({"shard": s, "base": base, "docs": len(ids), "tokens": b - a, "train": flags, "coded": _planes([w, cv, cu, np.diff(doc[a:b], prepend=0)])} | rare)
            if len(rows) >= 64:
                yield table()
        if rows:
            yield table()

    def run(batches):
        base, vocabulary = TaskContext.get().partitionId() << 33, Vocabulary(often)
        held: list[tuple] = []
        n_tokens = n_docs = 0

        def flush():
            shift = np.cumsum([0, *(len(x[0]) for x in held)])
            doc = np.concatenate([x[1][3] + s for x, s in zip(held, shift[:-1], strict=True)])
            ids = np.concatenate([x[0] for x in held])
            columns = [np.concatenate([x[1][k] for x in held]) for k in range(3)]
            held.clear()
            return pack(vocabulary, base, ids, np.bincount(doc, minlength=len(ids)), *columns, doc)

        for ids, tokens in _chunks(batches, modulus, remainder):
            held.append((ids, tokens))
            n_tokens += len(tokens[0])
            n_docs += len(ids)
            if n_tokens > FLUSH_TOKENS or n_docs > FLUSH_DOCS:
                yield from flush()
                base += n_docs
                held, n_tokens, n_docs = [], 0, 0
        if held:
            yield from flush()

    return run


def _tokens_of(blob: dict, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word, v, u, document and training flag of the tokens of a blob."""
    w, v, u, step = _columns(blob["coded"], blob["tokens"])
    others, n = _from_five(blob["contexts"]), int(np.count_nonzero(v == 0))
    doc = np.cumsum(step)
    train = np.unpackbits(np.frombuffer(blob["train"], np.uint8)).astype(bool)[doc]
    word = vocabulary.decode(w, np.frombuffer(blob["words"], "<u8"), False)
    return word, vocabulary.decode(v, others[:n], True), vocabulary.decode(u, others[n:], True), doc, train


def _shard(model_dir: str, par: Parameters, often: np.ndarray):
    def score(vocabulary, shard, blobs, sums):
        parts = [_tokens_of(b, vocabulary) for b in blobs]
        word, v, u = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.lexsort((u, v, word))
        word, v, u = word[order], v[order], u[order]
        train = np.concatenate([p[4] for p in parts])[order]
        out = shared.Writer(_file(model_dir, shard))
        out.write(build_trie(word[train], v[train], u[train], par))
        out.close()
        new = np.append(True, (word[1:] != word[:-1]) | (v[1:] != v[:-1]) | (u[1:] != u[:-1]))
        terms = _terms(Trie(shared.mapped(_file(model_dir, shard))), word[new], v[new], u[new], par)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.cumsum(new) - 1
        a = 0
        for b, p in zip(blobs, parts, strict=True):
            held = sums.setdefault(b["base"], np.zeros((3, b["docs"])))
            for r, x in enumerate(terms):
                held[r] += np.bincount(p[3], weights=x[back[a : a + len(p[3])]], minlength=b["docs"])
            a += len(p[3])

    def table(base, docs, held=None, known=None, sums=None, ids=None, sizes=None):
        cols = [pa.array([base], pa.int64()), pa.array([docs], pa.int32()), pa.array([held], pa.int32()), *(pa.array([x], pa.binary()) for x in (known, sums, ids, sizes))]
        return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in SUMS.split(", ")])

    def partial(sums):
        for base, held in sums.items():
            at = np.flatnonzero(held.any(axis=0))
            yield table(base, held.shape[1], len(at), _planes([np.diff(at, prepend=0), held[0, at]]), held[1:, at].tobytes())

    def run(batches):
        now, blobs, sums, vocabulary = None, [], {}, Vocabulary(often)
        for batch in batches:
            for b in batch.to_pylist():
                if b["ids"] is not None:
                    yield table(b["base"], b["docs"], ids=b["ids"], sizes=b["sizes"])
                    continue
                if b["shard"] != now and blobs:
                    score(vocabulary, now, blobs, sums)
                    blobs = []
                    if sum(x.shape[1] for x in sums.values()) > FLUSH_SUMS:
                        yield from partial(sums)
                        sums = {}
                now = b["shard"]
                blobs.append(b)
        if blobs:
            score(vocabulary, now, blobs, sums)
        yield from partial(sums)

    return run


def _combine(modulus: int, remainder: int):
    """Adds up the partial sums of each batch of documents."""

    def table(ids, sizes, held):
        cols = [pa.array(ids, mask=ids == NULL_ID), pa.array(held_out_ids(ids, modulus, remainder)), pa.array(sizes), pa.array(held[0].astype(np.int64)), pa.array(held[1]), pa.array(held[2])]
        return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in SCORED.split(", ")])

    def run(batches):
        now = ids = sizes = held = None
        for batch in batches:
            for b in batch.to_pylist():
                if b["base"] != now:
                    if now is not None:
                        yield table(ids, sizes, held)
                    now, held = b["base"], np.zeros((3, b["docs"]))
                if b["ids"] is not None:
                    ids, sizes = np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["sizes"], "<u4").astype(np.int64)
                elif b["held"]:
                    step, known = _columns(b["known"], b["held"])
                    at = np.cumsum(step)
                    held[0, at] += known
                    held[1:, at] += np.frombuffer(b["sums"]).reshape(2, -1)
        if now is not None:
            yield table(ids, sizes, held)

    return run


def _often(counts: DataFrame) -> np.ndarray:
    """The words that get short codes: those above a count, VOCABULARY at most."""
    step = F.floor(F.log2("a") * 8)
    kept = low = 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):  # 8 * 64 rows at most
        kept += r[1]
        if kept > VOCABULARY:
            low = r.step + 1
            break
    t = counts.filter(step >= low).select("key", "a").toArrow()
    key, a = (t[c].to_numpy() for c in ("key", "a"))
    return key.view(np.uint64)[np.lexsort((key, -a))]


def score_documents(docs: DataFrame, mu: float = 1000.0, tau: float = 0.002, modulus: int = 5, remainder: int = 1, tasks: int | None = None, model_dir: str | None = None) -> DataFrame:
    """Score every text of ``docs``; rows of remainder ``remainder`` don't train.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score (log10). The model stays below ``model_dir`` for ``Model``: its manifest
    at once, its tries when the rows have been read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    model_dir = model_dir or shared.fresh(spark, "trie")
    shared.make_dir(model_dir)

    def counted(run, name):
        return shared.save(texts.mapInArrow(run, "kind int, key long, c long, a long").groupBy("kind", "key").agg(F.sum("c").alias("c"), F.sum("a").alias("a")), name)

    counts = counted(_count_words(modulus, remainder), "words")
    end = int(END.astype(np.int64))
    r = counts.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("int")), F.sum("a"), F.sum(F.when(F.col("key") == end, F.col("c")))).first()
    total, distinct, every, starts = (int(x or 0) for x in r)
    shards = 1 << max(LEAST_SHARDS.bit_length() - 1, (every // SHARD_TOKENS - 1).bit_length())
    heavy = F.col("a") > max(every // (4 * shards), 1)  # 4 * shards at most hold for this
    frequent = [shared.Counts.write(_often_file(model_dir, 0), counts.filter(heavy)), shared.Counts("", 0), shared.Counts("", 0)]
    often = _often(counts)
    shared.drop(counts)
    if frequent[0].size:
        counts = counted(_count_frequent(frequent[0], modulus, remainder), "pairs")
        for kind in (0, 1):  # 4 * shards each
            frequent[1 + kind] = shared.Counts.write(_often_file(model_dir, 1 + kind), counts.filter(heavy & (F.col("kind") == kind)))
        shared.drop(counts)
    par = Parameters(mu, tau, shards, total, distinct, starts, frequent)
    out = shared.Writer(f"{model_dir}/manifest.json")
    out.write(par.manifest().encode())
    out.close()

    tasks = max(tasks, shards // 64)
    blobs = texts.mapInArrow(_blobs(par, often, modulus, remainder), BLOB)
    sums = blobs.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_shard(model_dir, par, often), SUMS)
    rows = sums.repartition(tasks, "base").sortWithinPartitions("base").mapInArrow(_combine(modulus, remainder), SCORED)
    base, score = par.finish(F.col("n_tokens"), F.col("base"), F.col("score"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
