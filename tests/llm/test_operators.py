"""Operators against brute force on small tables, with the odd cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import types
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import chat, decontam, licenses, lm, ngram_join, packing, quality, shared, tokenbin, toxicity, warc
from turnwise.llm import words as W
from turnwise.llm.components import components
from turnwise.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n int, count int, part string, key string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(400)]
    make = lambda n: " ".join(rng.choices(vocab, k=n))
    out = {i: make(rng.randint(1, 120)) for i in range(60)}
    long = make(6000)
    out |= {60: None, 61: "", 62: " \n\t ", 63: out[0], 64: out[0].upper(), 65: long, 66: "one two three four", 67: "one two three FOUR", 68: "x"}
    for k in range(69, 90):  # a chain of edits
        w = out[k - 1 if k > 69 else 5].split()
        w[rng.randrange(len(w))] = rng.choice(vocab)
        out[k] = " ".join(w)
    base = make(100).split()
    for k in range(90, 130):  # a group of near copies
        w = list(base)
        w[rng.randrange(len(w))] = rng.choice(vocab)
        out[k] = " ".join(w)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    shared.ship(spark)
    rows = [(i, t, "en", 1, 2, "p", "k") for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer(name):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary(name))
    tok.encode_special_tokens = True
    return tok


def test_token_files(docs, texts, empty):
    got = {r.doc_id: r for r in tokenbin.token_binary(docs, vocabulary("byte_bpe_50k.json")).collect()}
    tok, at = tokenizer("byte_bpe_50k.json"), 0
    for i in sorted(texts):
        ids = np.array(tok.encode(texts[i] or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert tokenbin.token_binary(empty, vocabulary("byte_bpe_50k.json")).collect() == []


def test_packing(docs, texts, empty):
    rows = packing.best_fit_packing(docs, vocabulary("word_bpe_49k.json"), capacity=64).collect()
    tok = tokenizer("word_bpe_49k.json")
    got = {(r.doc_id, r.piece): r for r in rows}
    n = 0
    for i, t in texts.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for p, s in enumerate(range(0, len(ids), 64)):
            r = got[i, p]
            assert (r.start, r.length, r.ids_crc32) == (s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64]))
            n += 1
    assert n == len(rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, length in sorted(pieces):
            assert o == at
            at += length
        assert at <= 64
    assert len(by) <= 1.05 * sum(r.length for r in rows) / 64 + 1
    assert packing.best_fit_packing(empty, vocabulary("word_bpe_49k.json")).collect() == []


def shingle_set(t, size=5):
    w = WORD.findall((t or "").translate(LOW))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def plain_classes(texts):
    s = {i: shingle_set(t) for i, t in texts.items()}
    up = {i: i for i in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(s[i]), find(i)) for i in s}


def test_jaccard(docs, texts, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs).collect()}
    assert got == plain_classes(texts)
    assert ngram_join.jaccard_classes(empty).collect() == []


@pytest.mark.parametrize("boundary", [0, 20, 48])
def test_jaccard_at_any_boundary(spark, monkeypatch, boundary):
    rng = random.Random(boundary)
    texts = {}
    for i in range(80):
        old = texts[rng.randrange(i)].split() if i and rng.random() < 0.7 else rng.choices("abcdefghijklmnop", k=rng.randint(3, 60))
        if rng.random() < 0.8:
            old[rng.randrange(len(old))] = rng.choice("abcdefghijklmnop")
        texts[i] = " ".join(old + rng.choices("xyz", k=rng.randint(0, 2)))
    monkeypatch.setattr(ngram_join, "choose_boundary", lambda *a: boundary)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(df).collect()} == plain_classes(texts)


def test_shared_passages_make_no_candidates(spark):
    """Texts that share seven tenths of their words, but don't link, meet in no list."""
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(140))
    texts = {i: passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for i in range(400)}
    texts |= {400 + i: texts[i] + " more" for i in range(5)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    shared.ship(spark)
    common, mean = ngram_join.common_shingles(df, 5)
    assert len(common) == 136 and mean > 1
    met = ngram_join._in_lists(ngram_join._keys(df, 5, 80, 0, common), 4)
    assert {r.doc_id % 400 for r in met.collect()} == set(range(5))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(df).collect()}
    assert got == {i: i % 400 for i in texts}


def test_counts_of_shingles(spark, monkeypatch):
    """Exact in the lowest part of the hash range, elsewhere at most one a part too low."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcde", k=rng.randint(5, 40)))) for i in range(200)]
    shared.ship(spark)
    want = collections.Counter(s for _, t in rows for s in {" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)})
    monkeypatch.setattr(ngram_join, "PART", 500)
    got = {r.key % 2**64: r.c for r in ngram_join._counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 5).collect()}
    keys = {}
    for gram in want:
        raw = gram.encode()
        (s,) = ngram_join.sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 5)
        keys[int(s[0])] = want[gram]
    parts = sum(keys.values()) // 500 + 2
    low = {k for k in keys if k < 2**64 * ngram_join.EXACT}
    assert low and all(got[k] == keys[k] for k in low)
    assert all(keys[k] - parts <= got.get(k, 0) <= keys[k] for k in keys) and set(got) <= set(keys)


def test_one_of_each(spark):
    a = " ".join("abcdefgh")
    rows = [(1, a, 1), (1, a, 2), (2, a, 3), (None, a, 4), (3, "", 5), (4, None, 6)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (False, 4), (True, 0)]


def test_rows_of_one_doc_id_and_null_ids(spark):
    a, b = " ".join("abcdefghij"), " ".join("klmnopqrst")
    rows = [(1, a), (1, b), (5, a), (6, b), (None, "zz yy"), (None, None)]
    got = [(r.doc_id, r.component_id) for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows) and {c for i, c in got if i is None} == {None}
    assert {c for i, c in got if i is not None} == {1}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(200, 240)] + [(5, 5), (None, 3)]
    up = list(range(300))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(find(n) == c for n, c in got.items())
    assert all(got.get(x, x) == find(x) for e in edges if e[0] is not None for x in e)


def plain_lm(texts, mu=1000.0, tau=0.002):
    """Per document: held out, tokens, known tokens, training tokens, base score, score."""
    tokens = {i: WORD.findall((t or "").translate(LOW)) + [None] for i, t in texts.items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    c, c2, c3 = collections.Counter(), collections.Counter(), collections.Counter()
    for i in train:
        w = [0, 0, *tokens[i]]
        c.update(tokens[i])
        c2.update(zip(w[1:], w[2:]))
        c3.update(zip(w, w[1:], w[2:]))
    z = sum(c.values()) + 0.5 * (len(c) + 1)
    c[0] = c2[0, 0] = len(train)
    out = {}
    for i, words in tokens.items():
        w = [0, 0, *words]
        p = {t: (c[t] + 0.5) / z for t in words}
        score = sum(math.log10((c3[u, v, t] + tau * (c2[v, t] + mu * p[t])) / (c2[u, v] + tau * (c[v] + mu))) for u, v, t in zip(w, w[1:], w[2:]))
        out[i] = (i not in train, len(words), sum(c[t] > 0 for t in words), sum(c.values()) - c[0], sum(math.log10(x) for x in map(p.get, words)), score)
    return out


def same_scores(got, want):
    assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == want[:4]
    assert got.base_score == pytest.approx(want[4], rel=1e-9)
    assert got.score == pytest.approx(want[5], abs=lm.STEP * got.n_tokens)  # half a step for each of two values a token


@pytest.mark.parametrize("tasks, shards", [(1, 16), (3, 16), (3, 256)])  # with many shards most n-grams are frequent ones, dealt over all of them
def test_lm(docs, texts, empty, tasks, shards, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_SHARDS", shards)
    got = {r.doc_id: r for r in lm.score_documents(docs, tasks=tasks, model_dir=str(tmp_path)).collect()}
    want = plain_lm(texts)
    assert got.keys() == want.keys()
    for i, w in want.items():
        same_scores(got[i], w)
    model = lm.Model(str(tmp_path), keep=5)  # from the files alone: the same scores, and new texts
    for i, r in zip(texts, model.score([t or "" for t in texts.values()])):
        assert r[:2] == (got[i].n_tokens, got[i].n_known) and r[2:] == pytest.approx((got[i].base_score, got[i].score), rel=1e-9)
    new = "one two three four one two unseen " + texts[0]
    i = next(i for i in range(1000, 2000) if zlib.crc32(b"%d" % i) % 5 == 1)
    fresh = plain_lm(texts | {i: new})[i]
    assert fresh[0] and model.score([new])[0][3] == pytest.approx(fresh[5], abs=lm.STEP * len(new.split()) + 0.1)
    assert lm.score_documents(empty).collect() == []


def test_lm_scores_of_a_whole_table_under_every_setting(spark):
    """Many different gains a shard: within the step of the exact model, whatever the number of partitions."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = plain_lm({r.doc_id: r.text for r in rows.collect()})
    old, found = spark.conf.get("spark.sql.shuffle.partitions"), {}
    try:
        for n in (2, 8, 40, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found[n] = {r.doc_id: r for r in lm.score_documents(rows).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for i, w in want.items():
        same_scores(found[8][i], w)
        assert all(x[i].score == pytest.approx(found[8][i].score, abs=1e-6) for x in found.values())


def test_lm_step():
    values = np.abs(np.random.default_rng(2).normal(3, 3, 1001)).clip(0, 15)
    for v in (values, values[:-1], values[:0]):
        raw = np.frombuffer(lm._coded(v), np.uint8)
        back = lm.Coded(raw, len(v))
        assert back.size == len(raw) and (abs(back[np.arange(len(v))] - v) <= lm.STEP / 2).all()


def test_lm_probabilities_sum_to_one(docs, texts, tmp_path):
    lm.score_documents(docs, tasks=1, model_dir=str(tmp_path)).count()
    model, head = lm.Model(str(tmp_path)), " ".join(texts[0].split()[:2])
    words = sorted({w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in WORD.findall((t or "").translate(LOW))})
    token, v, u, doc = lm._tokens(*lm.W.text_buffers(lm.pa.array([head, *(f"{head} {w}" for w in words), f"{head} unseenword"])))
    third = np.flatnonzero(np.arange(len(doc)) - np.searchsorted(doc, doc) == 2)  # the end, every word, an unknown one
    token, v, u, shard = token[third], v[third], u[third], model.par.shard(token, v, u, doc)[third]
    whole = 0.0
    for s in np.unique(shard).tolist():
        at = shard == s
        count, gain, _ = model._trie(s).lookup(token[at], v[at], u[at], model.par)
        whole += ((count + 0.5) / model.par.norm * 10**gain).sum() * model.par.tau * model.par.mu
    two, one = plain_counts(texts, head.split())
    assert two and whole == pytest.approx(two + model.par.tau * (one + model.par.mu), rel=1e-2)


def plain_counts(texts, head):
    """How often the two words of ``head`` stand in training texts, and the second alone."""
    two = one = 0
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            w = WORD.findall((t or "").translate(LOW))
            one += w.count(head[1])
            two += sum(p == tuple(head) for p in zip(w, w[1:]))
    return two, one


def test_lm_wide_batches(spark):
    rows = spark.range(70_000).selectExpr("id AS doc_id", "if(id % 7 = 0, 'a b c', if(id % 7 < 3, 'a b', '')) AS text").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        got = lm.score_documents(rows, tasks=2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = plain_lm({i: "a b c" if i % 7 == 0 else "a b" if i % 7 < 3 else "" for i in range(70_000)})
    assert len(got) == 70_000
    for r in got:
        same_scores(r, want[r.doc_id])


def test_lm_of_a_hot_word(spark, tmp_path):
    """One word, one pair and one triple are nearly all tokens: they are dealt over the shards."""
    texts = {i: "the cat sat " * 30 + f"w{i}" for i in range(80)} | {100: "the " * 900, 101: "", 102: "sat the cat"}
    got = lm.score_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tasks=2, model_dir=str(tmp_path)).collect()
    want = plain_lm(texts)
    for r in got:
        same_scores(r, want[r.doc_id])
    assert all(f.size == len(f.arrays()[0]) > 0 for f in lm.Model(str(tmp_path)).par.often)


def test_quality(spark, docs, texts, empty):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    extra = {200: "a b c a b c x", 201: "q\nq\n \nq w", 202: "| # x\nx", 203: "w " * 60, 204: "a b c d " * 30}
    both = docs.unionByName(spark.createDataFrame([(i, t) + ("en", 1, 2, "p", "k") for i, t in extra.items()], SCHEMA))
    got = {r.doc_id: r for r in quality.quality_rules(both, labels, buckets=64).collect()}
    for i, t in (texts | extra).items():
        w = WORD.findall(t or "")
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality_rules(empty, labels).collect() == []
    clash = both.withColumnRenamed("lang", "kept").withColumnRenamed("part", "n_words").withColumnRenamed("key", "_w")
    kept = quality.quality_filter(clash, labels, buckets=64)
    assert kept.schema == clash.schema and {(r.doc_id, r.kept, r.n_words) for r in kept.collect()} == {(i, "en", "p") for i, r in got.items() if r.kept}
    none = quality.quality_rules(docs, labels.limit(0))
    assert none.filter("ratio <> 0").isEmpty()


def test_ratio_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    row = {r.doc_id: r for r in quality.quality_rules(docs, labels, buckets=1).collect()}
    assert row[1].ratio == 0 and row[2].ratio == 0  # one bucket holds everything


def test_toxicity(spark, empty):
    rng = random.Random(0)
    plain = ["".join(rng.choices(["th", "er", "on", "an", "re", "he", "in", "ti"], k=rng.randint(1, 4))) for _ in range(300)]
    bad = ["loweikan", "vequmoz", "stupid", "chllapu"]
    texts, labels = [], []
    for i in range(600):
        w = rng.choices(plain, k=rng.randint(5, 80))
        toxic = i % 6 == 0
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    texts += [(1000, None), (1001, ""), (1002, " \n")]
    docs, marks = (spark.createDataFrame(x, s) for x, s in ((texts, "doc_id long, text string"), (labels, "doc_id long, quality int, toxic int")))
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, marks).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if got[i].held_out]
    assert sorted(held) == [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [got[i].predicted == truth[i] for i in held]
    assert sum(right) / len(right) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert [got[i].predicted for i in (1000, 1001, 1002)] == [0, 0, 0]
    assert toxicity.toxicity_scores(empty, marks).collect() == []
    assert {r.score for r in toxicity.toxicity_scores(docs, marks.limit(0)).collect()} == {0.0}
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("klmnopqr", k=5))
    items = [(i, " ".join(word() for _ in range(25)) + ". " + " ".join(word() for _ in range(8)) + ".") for i in range(30)]
    return spark.createDataFrame(items + [(98, None), (99, "")], "item_id long, text string"), dict(items)


def test_decontamination(spark, docs, texts, bench, empty):
    table, items = bench
    filler = texts[65]
    planted = {300: filler[:2000] + " " + items[3] + " " + filler[2000:9000], 301: items[4] + "### x", 302: "a " + items[5].upper(), 303: " ".join(items[6].split()[:10]), 304: items[7] + " " + items[8]}
    both = docs.unionByName(spark.createDataFrame([(i, t) + ("en", 1, 2, "p", "k") for i, t in planted.items()], SCHEMA))
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(both, table).collect()}
    assert got == {(300, 3), (301, 4), (302, 5), (304, 7), (304, 8)}
    kept = decontam.decontaminate(both, table)
    assert kept.columns == both.columns and {r.doc_id for r in kept.collect()} == (set(texts) | set(planted)) - {300, 301, 302, 304}
    assert decontam.find_leaks(empty, table).collect() == [] and decontam.find_leaks(both, table.limit(0)).collect() == []
    assert decontam.decontaminate(both, table.limit(0)).count() == both.count()


def test_items_are_judged_by_their_own_length(spark):
    """A question and an answer far apart leak nothing, whatever other items there are."""
    words = [f"q{k}" for k in range(14)], [f"a{k}" for k in range(6)]
    item = " ".join(words[0]) + "? " + " ".join(words[1]) + "."
    far = " ".join([*words[0], *(f"f{k}" for k in range(400)), *words[1]])
    docs = spark.createDataFrame([(1, far), (2, far + " " + item)], "doc_id long, text string")
    for more in ([], [(2, " ".join(f"z{k}" for k in range(1000)))], [(3, "one two"), (4, "three")]):
        table = spark.createDataFrame([(1, item), *more], "item_id long, text string")
        assert [(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, table).collect()] == [(2, 1)]


def test_wand_finds_all_above_threshold(bench):
    items = list(bench[1].items())
    rng = random.Random(2)
    vocab = [w for _, t in items for w in t.split()] + ["zz"] * 50
    mixed = [(i, " ".join(rng.choices(vocab, k=30))) for i in range(60)]
    hashes = [decontam._hashes(t) for _, t in mixed]
    keys, counts = np.unique(np.concatenate([np.unique(h) for h in hashes]), return_counts=True)
    whole = decontam.Totals(len(mixed), sum(map(len, hashes)), types.SimpleNamespace(arrays=lambda: (keys, counts)))
    index = decontam.Index(mixed, 0.2, whole, 32)
    for _ in range(100):
        terms = sorted(set(rng.choices(range(len(index.terms)), k=40)))
        score = collections.Counter()
        for t in terms:
            a, b = index.begin[t], index.begin[t + 1]
            for k, w in zip(index.item[a:b].tolist(), index.impact[a:b].tolist()):
                score[k] += w
        assert {k for k, _ in index.search(terms)} == {k for k, v in score.items() if v >= 0.2 - 1e-9}


def test_chat(spark):
    odd = ["<|im_end|>", "<\\|x", "<|", "\\", "a\nb", "", None, "<\\\\|im_start|>assistant\nhi<|im_end|>"]
    turns = [(c, t, ("user", "assistant", "we\\ird\nrole")[t % 3], odd[(c + t) % len(odd)]) for c in range(6) for t in range(7)] + [(0, 0, "user", "twice"), (0, 0, "user", "twice"), (9, 0, None, "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    segs = shared.save(chat.fold(chat.event_log(df)), "t")
    got = {r.conv_id: r for r in chat.read_back(segs).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((t, chat.render(role or "", text or "")[0], role or "", text or ""))
    for c, rows in by.items():
        rows.sort()
        said = "".join(x for _, _, r, x in rows if r == "assistant")
        want = (len(rows), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in rows).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), sum(len(s) for _, s, _, _ in rows))
        assert tuple(got[c])[1:] == want
    for text in odd[:-2] + [odd[-1]]:
        assert chat.unescape(chat.escape(text or "")) == (text or "") and "<|" not in chat.escape(text or "")
    assert chat.read_back(chat.fold(chat.event_log(df.limit(0)))).collect() == []


def test_event_fold(spark):
    log = [(1, 0, 7, 0, "start", "user", None), (1, 0, 7, 1, "delta", None, "he"), (1, 0, 7, 2, "delta", None, "y"), (1, 1, 8, 0, "start", "assistant", None), (1, 1, 8, 1, "delta", None, "no"), (1, 1, 8, 2, "regenerate", None, None), (1, 1, 8, 3, "delta", None, "yes"), (1, 1, 8, 4, "edit", None, "ok"), (1, 2, 9, 0, "start", "user", None), (1, 2, 9, 1, "retract", None, None)]
    df = spark.createDataFrame(log, "conv_id long, turn long, message long, seq int, event string, role string, text string").repartition(4)
    text = "".join(r.segment for r in chat.fold(df).orderBy("turn").collect())
    assert chat.parse(text) == [("user", "hey"), ("assistant", "ok")]
    with pytest.raises(Exception, match="unknown event"):
        chat.fold(df.withColumn("event", F.lit("odd"))).collect()


def test_warc(spark, tmp_path):
    big = "<p>é</p>" * 200
    pages = [(1, "http://a/\n x", "small"), (2, "u", "small"), (3, "u", big), (7, "u", big), (5, None, big), (8, "u", None), (9, "u", ""), (None, "u", "y"), (7, "again", big), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 100)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, frame int").repartition(2)
    path = f"file://{tmp_path}/w"
    index = warc.write_bundles(df, path)
    got = sorted(map(tuple, warc.read_bundles(index, path).collect()), key=str)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        revisit = b == big.encode() and i != 7
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None))
    assert got == sorted(want, key=str)
    for r in index.collect():
        head, payload = warc.read_record(f"{path}/{r.bundle}", r.frame_at, r.frame_size, r.offset)
        assert warc.page_of(head["WARC-Record-ID"][10:-1]) == r.page_id
    assert warc.read_bundles(warc.write_bundles(df.limit(0), f"{path}0"), f"{path}0").collect() == []


def test_licenses(spark, docs, texts, empty):
    mit = licenses.TEMPLATES["MIT-notice"]
    w = mit.split()
    planted = {400: "x y " + mit + " z", 401: " ".join(w[:40] + ["foo"] + w[41:]), 402: "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", 403: " ".join(w[:20]), 404: "the mit of license under"}
    both = docs.unionByName(spark.createDataFrame([(i, t) + ("en", 1, 2, "p", "k") for i, t in planted.items()], SCHEMA))
    got = {(r.doc_id, r.license): r.coverage for r in licenses.scan_licenses(both).collect()}
    assert set(got) == {(400, "MIT-notice"), (401, "MIT-notice"), (402, "MIT"), (402, "CC-BY-NC-4.0")}
    assert got[400, "MIT-notice"] == 1 and 0.95 < got[401, "MIT-notice"] < 1
    assert licenses.scan_licenses(empty).collect() == []


def test_toxicity_body_takes_all_ordinary_windows(monkeypatch):
    seen = []
    trained = toxicity._trained
    monkeypatch.setattr(toxicity, "_trained", lambda size, samples: seen.append(len(samples)) or trained(size, samples))
    long = " ".join(f"w{k % 977}" for k in range(600))
    ordinary = [long] * 3300
    toxicity.train(["vile words here"] * 9, ordinary)
    data, offsets = toxicity._column(ordinary[:2200])
    assert seen == [len(toxicity.windows(data, offsets)[1])] and seen[0] > 60_000


def test_license_versions_and_whole_texts():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8, licenses.PHRASES)

    def names(text):
        data, offsets = toxicity._column([text])
        return [x[1] for x in scanner.scan(data, offsets)]

    assert {n: names("before " + t + " after") for n, t in licenses.TEMPLATES.items()} == {n: [n] for n in licenses.TEMPLATES}
    line = "This work is licensed under the GNU {}Public License, version {}"
    assert names("Licensed under CC BY-SA 4.0") == ["CC-BY-SA-4.0-short"] and names("Licensed under CC BY 4.0") == ["CC-BY-4.0-short"]
    assert names(line.format("General ", 2)) == ["GPL-2.0"] and names(line.format("Lesser General ", 3)) == ["LGPL-3.0"]
    for text, name in {
        "licensed under the GNU General Public License, version 2": "GPL-2.0",
        "Released under the terms of the GNU General Public License version 2.": "GPL-2.0",
        "This code is licensed under the GNU General Public License v2.0 only": "GPL-2.0-short",
        "distributed under the GNU Affero General Public License, version 3": "AGPL-3.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
        "Text is available under Creative Commons Attribution 3.0 Unported": "CC-BY-3.0-long",
        "licensed under the Apache License 2.0": "Apache-2.0-short",
        "Licensed under the MIT license": "MIT",
    }.items():
        assert names("a b c " + text + " d e f") == [name]
    assert names(line.format("General ", 4)) == [] and names("Licensed under CC BY-XX 4.0") == []


def test_license_scan_against_every_window():
    """The scan finds a template where, and only where, some window of the text aligns with it."""
    rng = random.Random(11)
    short = {n: t for n, t in licenses.TEMPLATES.items() if len(t.split()) < 60}
    made = {f"made{k}": " ".join(rng.choices([f"v{x}" for x in range(12)], k=rng.randint(6, 40))) for k in range(12)}
    for name, template in [*rng.sample(sorted(short.items()), 12), *made.items()]:
        scanner = licenses.Scanner({name: template}, 0.8, licenses.PHRASES)
        said, texts = template.split(), []
        for _ in range(40):
            words = [w for w in said if rng.random() > 0.12]
            for _ in range(rng.randint(0, len(said) // 5)):
                words.insert(rng.randint(0, len(words)), rng.choice(["xx", "yy", rng.choice(said)]))
            around = [rng.choices(["zz", "the", *said[:2]], k=rng.randint(0, 30)) for _ in range(2)]
            texts.append(" ".join(around[0] + words + around[1]))
        data, offsets = toxicity._column(texts)
        found = {x[0] for x in scanner.scan(data, offsets)}
        w = W.Words(data, offsets, letters=True)
        starts = np.isin(w.hash, scanner.words[0])  # a window begins with a word of the template
        every = {r for r in range(len(texts)) if any(starts[k] and scanner._best(w.hash[k : w.first[r + 1]].tolist(), 0) for k in range(int(w.first[r]), int(w.first[r + 1])))}
        assert found == every, (name, [texts[r] for r in found ^ every])


def test_shards_of_the_benchmark_do_not_matter(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(80)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(8, 30))) + ".") for i in range(60)]
    docs = []
    for i, text in items:
        said = text[:-1].split()
        docs.append((i, " ".join(rng.choices(vocab, k=40) + said[: len(said) - i % 5] + rng.choices(vocab, k=40))))
    docs, table = (spark.createDataFrame(x, s) for x, s in ((docs, "doc_id long, text string"), (items, "item_id long, text string")))

    def leaks():
        return sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in decontam.find_leaks(docs, table, 0.6, 0.3, 0.3).collect())

    one = leaks()
    monkeypatch.setattr(decontam, "SHARD_ITEMS", 9)
    assert one and leaks() == one


@pytest.mark.parametrize("block", [2, 7])
def test_lists_in_blocks(docs, texts, block, monkeypatch):
    """Lists parted into many blocks give the components that whole lists give."""
    want = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs).collect()}
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs).collect()} == want


def test_lists_stream(spark):
    """Centres of lists that run over several batches."""
    rng = random.Random(5)
    rows = sorted({(rng.choice([1, 1, 1, 2, 3, 4, 5, *range(10, 60)]), 0, rng.randrange(500)) for _ in range(900)})
    df = spark.createDataFrame([(k, b, d, 9, d % 5) for k, b, d in rows], "key long, block long, doc_id long, n int, pos int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r.key, r.doc_id, r.pos, r.c_id, r.c_pos) for r in ngram_join._in_lists(df, 2).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    by = collections.defaultdict(list)
    for k, _, d in rows:
        by[k].append(d)
    assert got == sorted((k, d, d % 5, min(v), min(v) % 5) for k, v in by.items() if len(v) > 1 for d in v)


def test_warc_without_broadcast(spark, tmp_path, monkeypatch):
    """The join by shuffle, with payloads that repeat often and seldom, gives what the broadcast gives."""
    pages = spark.createDataFrame([(i, f"u{i}", None if i % 5 == 0 else ("x" * (900 if i % 3 else 1500)) + str(i % 4 if i < 60 else i)) for i in range(90)], "page_id long, url string, html string")
    want = sorted(map(tuple, warc.typed(pages).collect()), key=str)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    for often in (0, 3, 1000):
        monkeypatch.setattr(warc, "OFTEN", often)
        assert sorted(map(tuple, warc.typed(pages).collect()), key=str) == sorted(want, key=str)
    assert any(r[3] is not None for r in want)


def test_toxic_sample_is_bounded(spark):
    """Repeated rows of a labelled document count once, and long texts don't pass the bound."""
    rows = [(i, "plain words here " * 20) for i in range(40)] + [(i, "some vile gunk here " * 20) for i in range(40, 80)] + [(3, "z " * 50_000)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 40)) for i in range(80)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, sample_bytes=8_000)
    assert model.toxic
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert set(got) == set(range(80))


def test_chat_ties(spark):
    """Events of equal seq are folded in one order, whatever the order of rows."""
    log = [(1, 0, 5, 0, "start", "user", None), (1, 0, 5, 1, "delta", None, "b"), (1, 0, 5, 1, "delta", None, "a"), (1, 0, 5, 1, "edit", None, "c")]
    got = {chat.fold(spark.createDataFrame(p, "conv_id long, turn long, message long, seq int, event string, role string, text string")).first().segment for p in itertools.permutations(log)}
    assert len(got) == 1


def plain_leaks(texts, items, threshold=0.6, question=0.7, answer=0.7):
    """Every passage of every text against every item: BM25 over words of letters and digits, then overlaps."""
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    words = {i: split(t) for i, t in items.items() if split(t)}
    df = collections.Counter(w for ws in words.values() for w in set(ws))
    mean = sum(map(len, words.values())) / len(words)
    weight = {}
    for i, ws in words.items():
        tf = collections.Counter(ws)
        raw = {w: math.log1p((len(words) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, n in tf.items()}
        weight[i] = {w: x / sum(raw.values()) for w, x in raw.items()}
    grams = lambda ws, n: {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
    out = {}
    for d, t in texts.items():
        ws = split(t)
        for i in words:
            span = max(16, 2 ** math.ceil(math.log2(len(words[i]))))
            for a in range(-span, len(ws), span):
                passage = ws[max(a, 0) : a + 2 * span]
                score = sum(weight[i].get(w, 0.0) for w in set(passage))
                over = []
                for part in map(split, decontam.split_item(items[i])):
                    n = min(5, len(part))
                    over.append(len(grams(part, n) & grams(passage, n)) / len(grams(part, n)) if n else 1.0)
                if score >= threshold - 1e-9 and over[0] >= question and over[1] >= answer:
                    out[d, i] = max(out.get((d, i), 0.0), score)
    return out


@pytest.mark.parametrize("shard", [20_000, 7])
def test_leaks_of_all_passages(spark, monkeypatch, shard):
    monkeypatch.setattr(decontam, "SHARD_ITEMS", shard)
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(60)] + ["the", "of", "a"] * 8
    make = lambda n: " ".join(rng.choices(vocab, k=n))
    items = {i: f"{make(rng.randint(6, 14)).capitalize()}? {make(rng.randint(2, 7)).capitalize()}." for i in range(30)} | {30: None, 31: "", 32: "The"}
    items |= {40 + i: f"{make(40 + 20 * i).capitalize()}? {make(9).capitalize()}." for i in range(5)}  # other classes of length
    texts = {}
    for d in range(60):
        w = make(rng.randint(0, 90)).split()
        if d % 2:
            copy = items[rng.randrange(30)].split()
            for _ in range(rng.randrange(4)):  # edits around the thresholds
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            at = rng.randint(0, len(w))
            w[at:at] = copy
        texts[d] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.find_leaks(docs, bench).collect()}
    want = plain_leaks(texts, items)
    assert got.keys() == want.keys() and len(want) > 10
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    left = {r.doc_id for r in decontam.decontaminate(docs, bench).collect()}
    assert left == texts.keys() - {d for d, _ in want}


def plain_patience(a, b):
    """Words unique to both sides, longest increasing run of them by trying all, gaps alike."""
    once = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
    if not once:  # no anchor: equal ends only
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        m = 0
        while m < min(len(a), len(b)) - k and a[-1 - m] == b[-1 - m]:
            m += 1
        return k + m
    best = 0
    for n in range(len(once), 0, -1):
        if any([b.index(x) for x in c] == sorted(b.index(x) for x in c) for c in itertools.combinations(once, n)):
            best = n
            break
    return best


def test_patience_on_random_texts():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.randrange(9) for _ in range(rng.randint(0, 9))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
        assert len(pairs) >= plain_patience(a, b)  # every anchor of a longest run is kept, gaps may add more
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
        assert len(pairs) <= lcs[-1][-1]
