"""Numpy kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnwise.llm import eliasfano, packing, toks
from turnwise.llm import words as W
from turnwise.llm.licenses import patience
from turnwise.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.text(alphabet="aBé \n\t.,’x1<|>", max_size=40), max_size=8)


@given(texts)
@settings(max_examples=60, deadline=None)
def test_words(docs):
    data, offsets = W.text_buffers(pa.array(docs, pa.string()))
    w = W.Words(data, offsets)
    want = [(r, m[0]) for r, t in enumerate(docs) for m in WORD.finditer(t)]
    assert [(int(r), w.text(i)) for i, r in enumerate(w.row)] == want
    low = [t.translate(str.maketrans("B", "b")) for _, t in want]
    assert len(set(w.hash.tolist())) == len(set(low))
    h, begin = W.shingles(w)
    sets = []
    for r in range(len(docs)):
        own = [x for (k, _), x in zip(want, low) if k == r]
        sets += [tuple(own[i : i + 5]) for i in range(len(own) - 4)] if len(own) >= 5 else [tuple(own)] * bool(own)
        assert begin[r + 1] == len(sets)
    assert len(h) == len(sets) and len(set(h.tolist())) == len(set(sets))


def test_null_and_sliced_text():
    data, offsets = W.text_buffers(pa.array(["x", None, "y z", ""]).slice(1))
    assert offsets.tolist() == [0, 0, 3, 3] and data.tobytes() == b"y z"


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.lists(st.integers(0, 2**64 - 1), max_size=20))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, asked):
    v = np.sort(np.array(values, dtype=np.uint64))
    e = eliasfano.EliasFano(np.frombuffer(eliasfano.encode(v), "<u8"))
    assert e.access(np.arange(len(v))).tolist() == v.tolist()
    q = np.array(asked + values, dtype=np.uint64)
    assert e.successor(q).tolist() == np.searchsorted(v, q).tolist()


@pytest.mark.parametrize("special", [False, True])
@pytest.mark.parametrize(("name", "mode"), [("byte_bpe_50k.json", "spaces"), ("word_bpe_49k.json", "words")])
def test_tokenizer_cache(name, mode, special):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary(name))
    tok.encode_special_tokens = not special
    docs = ["Hello  world\n\n x", "", " ", "a b c \n d", "<|endoftext|> it's 12,5%", "tail \n", "\n\n\nlead", "é " * 50, "a\rb\x0bc", "Hello world hello world"]
    docs += [f"a {t.content} b{t.content}c \n{t.content}" for t in tok.get_added_tokens_decoder().values()] + ["<|ENDOFTEXT|> x", "a<|endof", "text|> b"]
    enc = toks.Encoder(vocabulary(name), mode, special)
    assert enc.mode == mode
    for _ in range(2):
        data, offsets = W.text_buffers(pa.array(docs))
        ids, counts = enc.encode(data, offsets)
        at = np.cumsum(counts) - counts
        for t, a, n in zip(docs, at, counts):
            assert ids[a : a + n].tolist() == tok.encode(t, add_special_tokens=False).ids, t


@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=12))
@settings(max_examples=80, deadline=None)
def test_plan_is_a_packing(histogram):
    plan = packing.make_plan(dict(histogram), 20)
    fill = {}
    for length, rank, count, first, offset in plan.table().tolist():
        for k in range(count):
            fill.setdefault(first + k, []).append((offset, length))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 20
    assert len(fill) == plan.sequences and sum(map(len, fill.values())) == sum(histogram.values())
    plain = sorted((x for k, n in histogram.items() for x in [k] * n), reverse=True)
    bins = []
    for x in plain:  # best-fit decreasing without the reduction
        fits = [b for b in bins if b >= x]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - x)
        else:
            bins.append(20 - x)
    assert plan.sequences <= len(bins) + 1


def test_patience():
    assert patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert patience([5, 1, 2, 5], [1, 2]) == [(1, 0), (2, 1)]
    assert patience([], [1]) == [] and patience([1], []) == []
    got = patience([7, 1, 8, 2, 9, 3], [1, 2, 3])
    assert got == [(1, 0), (3, 1), (5, 2)]


def thue_morse(n=10):
    """Two words of 2 ** n letters that every linear polynomial hash modulo 2 ** 64 takes for one."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_repetitive_words_differ():
    a, b = thue_morse()
    w = W.Words(*W.text_buffers(pa.array([f"{a} {b}", a[:64], b[:64]])))
    assert len(set(w.hash.tolist())) == 4


@pytest.mark.parametrize(("name", "mode"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaces")])
def test_cache_has_a_bound(name, mode, monkeypatch):
    """Long units aren't kept, and many units start the cache anew; ids stay the library's."""
    monkeypatch.setattr(toks, "CACHE_BYTES", 20_000)
    enc, rng = toks.Encoder(vocabulary(name), mode), np.random.default_rng(4)
    letters = np.array(list("abcdefgh"))
    for k in range(12):
        docs = ["".join(rng.choice(letters, 5000)) + " tail", " ".join("".join(x) for x in rng.choice(letters, (200, 6))), f"x{k}"]
        ids, _ = enc.encode(*W.text_buffers(pa.array(docs)))
        assert ids.tolist() == sum((enc._whole(t).tolist() for t in docs), [])
        assert len(enc.bytes) + enc.flat.nbytes < 30_000 and (enc.length <= toks.UNIT).all()


@pytest.mark.parametrize(("name", "mode"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaces")])
def test_ids_of_colliding_words(name, mode, monkeypatch):
    a, b = thue_morse()
    enc = toks.Encoder(vocabulary(name), mode)
    docs = [f"x {a}", f"x {b}", "", "x" * 3000 + " y", "y " + "x" * 3000]
    want = sum((enc._whole(t).tolist() for t in docs), [])
    assert enc.encode(*W.text_buffers(pa.array(docs)))[0].tolist() == want
    full = W.span_hash
    monkeypatch.setattr(W, "span_hash", lambda *x: full(*x) & np.uint64(3))  # nearly all units collide
    enc = toks.Encoder(vocabulary(name), mode)
    assert enc.mode == mode
    for _ in range(2):
        assert enc.encode(*W.text_buffers(pa.array(docs)))[0].tolist() == want


@pytest.mark.parametrize("histogram", [{3000: 200_000, 900: 200_000}, {2500: 10**9, 1500: 10**9, 90: 10**9, 7: 3}, {k: 10**9 + k for k in range(1400, 4097)}, {k: 10**9 - k for k in range(1, 4097)}])
def test_plan_of_large_counts(histogram):
    plan = packing.make_plan(dict(histogram), 4096)
    t = plan.table()
    assert len(t) < 60_000 and t["count"].sum() == sum(histogram.values())
    assert plan.sequences >= -(-sum(k * n for k, n in histogram.items()) // 4096)
    small = packing.make_plan({k: max(n // 10**7, 1) for k, n in histogram.items()}, 4096)
    assert len(t) < 20 * len(small.runs) + 100
