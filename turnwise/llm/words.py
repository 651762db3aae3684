"""Vectorised word kernels over the UTF-8 bytes of an Arrow text column.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``, which is the
regular expression ``[^\\x20\\x09-\\x0D]+`` on the decoded text. Words are
identified by a 64-bit hash of their bytes: eight bytes at a time go through a
mixer that isn't linear, so repetitive words don't collide by construction. The
hashes of a chunk cost a few numpy passes; only spans above ``LONG`` bytes are
hashed one by one, by xxh3.
Arrays over the bytes of a chunk stay bounded by ``CHUNK`` (or by the longest
single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at once, at least one whole text.
CHUNK = 2_000_000

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Spans above this many bytes are hashed by xxh3.
LONG = 128
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII but letters and digits.
_MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunked(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words of a run of texts: byte span, row and hash of each.

    ``start``/``end`` are byte positions in ``data``; ``row`` is the text a
    word is from; ``hash`` its 64-bit identity (A-Z folded when ``lower``);
    ``first`` gives, per text, the index of its first word (length rows + 1).
    With ``letters`` every ASCII mark separates words as white space does.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, letters: bool = False):
        n, rows = len(data), len(offsets) - 1
        self.data, self.offsets = data, offsets
        space = (_MARKS if letters else _SPACE)[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        inside = ~space
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = True
            before[1:] = space[:-1]
            after[:-1] = space[1:]
            before |= cut[:-1]
            after |= cut[1:]
        self.start = np.flatnonzero(inside & before)
        self.end = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))
        self.hash = span_hash(data, self.start, self.end, lower)

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte of ``data`` on, as little-endian integers."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def lane(at: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Lane k of spans of ``size`` bytes, those behind the span's end cleared."""
    cut = U64(8) * np.maximum(8 * (k + 1) - size, 0).astype(np.uint64)
    return (at[start + 8 * k] << cut) >> cut


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes."""
    if lower:
        data = _LOWER[data]
    size = end - start
    out = mix(size.astype(np.uint64) + U64(1))
    at = lanes(data)
    some = np.flatnonzero((size > 0) & (size <= LONG))
    k = 0
    while len(some):
        x = lane(at, start[some], size[some], k)
        out[some] = mix((out[some] ^ x) * U64(_BASE) + (x >> U64(29)))
        k += 1
        some = some[size[some] > 8 * k]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``size``-word window, and per text its first window.

    A text of fewer words has its whole sequence as one window; one without
    words has none.
    """
    h, first = words.hash, words.first
    count = np.diff(first)
    mult = [U64(pow(_BASE, k + 1, 1 << 64)) for k in range(size)]
    n = len(h)
    full = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        full += h[k : k + len(full)] * mult[k]
    full = mix(full)
    windows = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    begin = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(windows, out=begin[1:])
    at = np.repeat(first[:-1] - begin[:-1], windows) + np.arange(begin[-1])
    short = np.flatnonzero((count > 0) & (count < size))
    out = np.empty(begin[-1], dtype=np.uint64)
    plain = np.ones(begin[-1], dtype=bool)
    plain[begin[short]] = False
    out[plain] = full[at[plain]]
    for r in short.tolist():
        x = np.array([count[r]], dtype=np.uint64)
        for k in range(first[r], first[r + 1]):
            x = mix(x * mult[0] + h[k : k + 1])
        out[begin[r]] = x[0]
    return out, begin
