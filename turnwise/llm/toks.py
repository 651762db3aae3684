"""Encoding of whole texts by the tokenizers library, once per distinct unit.

Both public vocabularies split a text at white space before any merge, so the
ids of a text are those of its units in order: words where white space is
dropped ("words"), a run of white space with the word behind it where it is
kept ("spaces"). Each distinct unit is encoded by the library once and kept in
a bounded cache of the Python worker; the ids of all texts are then gathered by
numpy. The cache is found by a hash of the unit, and the bytes of every unit are
compared with those of its entry: texts with a unit that differs go through the
library whole, as do texts that hold other Unicode white space or a unit of more than
``UNIT`` bytes. The cache is started anew beyond ``CACHE`` entries or ``CACHE_BYTES``
bytes of units and ids.

A text that holds the string of a special token: the recipe that comes with the
vocabulary files sets ``encode_special_tokens``, so the string is ordinary text and gets
ordinary ids, and no text can bring in control ids. With ``special`` the library's
own default holds: the string becomes the id of the token. Such texts go through
the library whole.
"""

from __future__ import annotations

import re

import numpy as np

from turnwise.llm import words as W

#: Entries kept by a worker before its cache is started anew.
CACHE = 1_500_000
#: Bytes of units and ids kept by a worker.
CACHE_BYTES = 48_000_000
#: Bytes of the longest unit that is kept.
UNIT = 1000
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_PROBE = ["Ab  cd\n\n e's it'll.\t9 x \n", " \n lead", "été ñ <|endoftext|> z  ", "", "a\r\n\r\nb 12,5%"]
#: Which two bytes the UTF-8 of a character in _OTHER_SPACE may start with; the first four are one byte long.
_ODD_PAIRS = np.zeros((256, 256), dtype=bool)
_ODD_PAIRS[0x1C:0x20] = True
for _pair in (0xC285, 0xC2A0, 0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380, 0xEFBB):
    _ODD_PAIRS[_pair >> 8, _pair & 255] = True
_ODD_FIRST = _ODD_PAIRS.any(axis=1)
_made: dict[tuple, "Encoder"] = {}


def encoder(path: str, mode: str, special: bool = False) -> "Encoder":
    """The worker's encoder of a vocabulary file; it is loaded once."""
    key = path, mode, special
    if key not in _made:
        _made[key] = Encoder(*key)
    return _made[key]


class Encoder:
    def __init__(self, path: str, mode: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special
        added = [t.content for t in self.tok.get_added_tokens_decoder().values() if special or not t.special]
        self.added = re.compile("|".join(map(re.escape, added)).encode()) if added else None
        self.tok.no_truncation()
        self.tok.no_padding()
        self.mode = mode
        self._clear()
        for text in _PROBE if mode != "whole" else ():
            raw = np.frombuffer(text.encode(), np.uint8)
            got, _ = self.encode(raw, np.array([0, len(raw)]))
            if got.tolist() != self.tok.encode(text, add_special_tokens=False).ids:
                self.mode = "whole"  # this vocabulary doesn't split at white space
                break

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.bytes = np.zeros(0, np.uint8)  # of all units, one after another
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        flat, sizes = [], []
        for i in range(0, len(units), 2000):
            got = self.tok.encode(units[i : i + 2000], is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(got.ids, dtype=np.uint32))
            of = np.array(got.word_ids, dtype=np.int64)
            sizes.append(np.bincount(of, minlength=len(units[i : i + 2000])))
        flat, sizes = np.concatenate(flat), np.concatenate(sizes)
        begin = np.cumsum(sizes) - sizes + len(self.flat)
        raw = [u.encode() for u in units]
        length = np.array([len(r) for r in raw], dtype=np.int64)
        spot = np.cumsum(length) - length + len(self.bytes)
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(raw), np.uint8)])
        at = np.searchsorted(self.keys, keys)
        more = {"keys": keys, "begin": begin, "size": sizes, "at": spot, "length": length}
        for name, values in more.items():
            setattr(self, name, np.insert(getattr(self, name), at, values))
        self.flat = np.concatenate([self.flat, flat])

    def _differ(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Units whose bytes aren't those of the entries ``found``."""
        size, spot = end - start, self.at[found]
        wrong = size != self.length[found]
        mine, kept = W.lanes(data), W.lanes(self.bytes)
        some, k = np.flatnonzero(~wrong & (size <= W.LONG)), 0
        while len(some):
            wrong[some] = W.lane(mine, start[some], size[some], k) != W.lane(kept, spot[some], size[some], k)
            k += 1
            some = some[~wrong[some] & (size[some] > 8 * k)]
        for i in np.flatnonzero(~wrong & (size > W.LONG)).tolist():
            wrong[i] = not np.array_equal(data[start[i] : end[i]], self.bytes[spot[i] : spot[i] + size[i]])
        return np.flatnonzero(wrong)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another, and per text their number."""
        rows = len(offsets) - 1
        if self.mode == "whole":
            each = [self._whole(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], dtype=np.int64)
        raw = data.tobytes()
        w = W.Words(data, offsets, lower=False)
        if self.mode == "words":
            start, end, row, h = w.start, w.end, w.row, w.hash
        else:  # a unit runs from the end of the word before it, or from the start of its text
            start = np.empty_like(w.start)
            start[1:] = w.end[:-1]
            head = w.first[:-1][np.diff(w.first) > 0]
            start[head] = offsets[:-1][np.diff(w.first) > 0]
            end, row = w.end, w.row
            last = np.where(np.diff(w.first) > 0, np.append(w.end, 0)[w.first[1:] - 1], offsets[:-1])
            tail = np.flatnonzero(last < offsets[1:])  # texts that end in white space
            if len(tail):
                at = w.first[1:][tail]
                start, end, row = np.insert(start, at, last[tail]), np.insert(end, at, offsets[1:][tail]), np.insert(row, at, tail)
            h = W.span_hash(data, start, end, False)
        odd = self._odd(data, raw, offsets) | set(row[end - start > UNIT].tolist())
        if odd:  # their units aren't learnt
            plain = np.ones(rows, dtype=bool)
            plain[list(odd)] = False
            start, end, h, row = (x[plain[row]] for x in (start, end, h, row))
        keys, where, inv = np.unique(h, return_index=True, return_inverse=True)
        found = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        ok = found < len(self.keys)
        new[ok] = self.keys[found[ok]] != keys[ok]
        if len(self.keys) + int(new.sum()) > CACHE or len(self.bytes) + self.flat.nbytes > CACHE_BYTES:
            self._clear()
            new[:] = True
        if new.any():
            at = where[new]
            self._learn(keys[new], [raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        found = np.searchsorted(self.keys, keys)[inv]
        size, begin = self.size[found], self.begin[found]
        done = np.cumsum(size)
        ids = self.flat[np.repeat(begin - (done - size), size) + np.arange(done[-1] if len(done) else 0)]
        counts = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
        odd = sorted({*odd, *row[self._differ(data, start, end, found)].tolist()})
        if odd:
            ends = np.cumsum(counts)
            parts, at = [], 0
            for r in odd:
                whole = self._whole(raw[offsets[r] : offsets[r + 1]].decode())
                parts += [ids[at : ends[r] - counts[r]], whole]
                at = ends[r]
                counts[r] = len(whole)
            ids = np.concatenate([*parts, ids[at:]])
        return ids, counts

    def _odd(self, data: np.ndarray, raw: bytes, offsets: np.ndarray) -> set[int]:
        """Texts with white space that isn't ASCII, or with the string of an added token."""
        at = np.flatnonzero(_ODD_FIRST[data])
        at = at[_ODD_PAIRS[data[at], data[np.minimum(at + 1, len(data) - 1)]]]
        maybe = np.unique(np.searchsorted(offsets, at, side="right") - 1).tolist()
        rows = {r for r in maybe if _OTHER_SPACE.search(raw[offsets[r] : offsets[r + 1]].decode())}
        return rows | ({int(np.searchsorted(offsets, m.start(), side="right")) - 1 for m in self.added.finditer(raw)} if self.added else set())
