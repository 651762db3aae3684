"""The pipeline's stages, one after another, against plain versions."""

import collections
import itertools
import math
import random
import re

import numpy as np
import xxhash
import zstandard as zstd

import corpus_pipeline as P
from turnwise.llm import shared, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\W]+|[^\s\w]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spark_hash(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def plain_quality(docs, labels, buckets=10_000, threshold=-0.4):
    trusted = {r.doc_id for r in labels if r.quality == 1}
    count = collections.Counter()
    grams = {}
    for i, t in docs.items():
        tok = TOKEN.findall((t or "").lower())
        grams[i] = [(0, spark_hash(w) % buckets) for w in tok] + [(1, spark_hash(a, b) % buckets) for a, b in zip(tok, tok[1:])]
        for g in grams[i]:
            count["r", g] += 1
            count["r", g[0]] += 1
            if i in trusted:
                count["c", g] += 1
                count["c", g[0]] += 1

    def weight(g):
        if not count["c", g[0]]:
            return 0.0
        return math.log((count["c", g] + 1) / (count["c", g[0]] + buckets)) - math.log((count["r", g] + 1) / (count["r", g[0]] + buckets))

    kept = set()
    for i, t in docs.items():
        w = WORD.findall(t or "")
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        ratio = sum(map(weight, grams[i])) / len(grams[i]) if grams[i] else 0.0
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and ratio >= threshold:
            kept.add(i)
    return kept


def plain_toxic(docs, model):
    out = set()
    params = zstd.ZstdCompressionParameters(window_log=17, chain_log=17, hash_log=17, search_log=5, min_match=3, target_length=32, strategy=zstd.STRATEGY_BTULTRA2, write_content_size=False, write_checksum=False, write_dict_id=False)
    packers = []
    for content in (model.ordinary, model.toxic):
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        packers.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))
    if not model.toxic:
        return out
    memo = {}
    for i, t in docs.items():
        gains = []
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()):
            if w not in memo:
                x = model.frame + w + b" " + model.tail
                memo[w] = len(packers[0].compress(x)) - len(packers[1].compress(x))
            gains.append(max(memo[w], 0))
        if model.scores(np.array([float(sum(sorted(gains)[-2:]))]))[0] >= 0.7:
            out.add(i)
    return out


def plain_firsts(docs):
    sets = {}
    for i, t in docs.items():
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {find(i) for i in sets}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    shared.ship(spark)
    for name, stage in P.STAGES:
        texts = {r.doc_id: r.text for r in docs.collect()}
        out = shared.save(stage(spark, docs, sf), f"test-{name}")
        if name == "packing":
            rows = out.collect()
            assert {r.doc_id for r in rows} == set(texts)
            full = collections.Counter()
            for r in rows:
                full[r.sequence_id] += r.length
            assert max(full.values()) <= 4096 and len(full) <= -(-sum(full.values()) // 4096) + 1
            continue
        kept = {r.doc_id for r in out.collect()}
        if name == "quality_rules":
            want = plain_quality(texts, labels.collect())
        elif name == "toxicity":
            want = set(texts) - plain_toxic(texts, toxicity.fit(docs, labels))
        elif name == "ngram_jaccard":
            want = plain_firsts(texts)
        else:
            plain = [" ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (x or "").lower())) for x in items]
            said = {i: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())) for i, t in texts.items()}
            want = {i for i, t in said.items() if not any(f" {x} " in f" {t} " for x in plain if x)}
        assert kept == want, name
        assert out.columns == docs.columns and out.count() == len(kept)
        docs = out
    assert [n for n, _ in P.STAGES] == ["quality_rules", "toxicity", "ngram_jaccard", "decontamination", "packing"]
    assert P.ORACLE_SQL is None


ODD = "doc_id long, text string, lang string, source string, n_chars long, component_id long, kept int, score double, length int, piece int, item_id long, _row int, _doc string, _q int, _toxic int"


def test_stages_on_odd_rows(spark, tmp_path):
    """Null, empty and very long texts, repeated rows, ties, clashing names, empty tables."""
    rng = random.Random(5)
    make = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))
    good, long = make(90), make(60_000)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, good), (5, good), (5, good), (6, long), (7, long + " x"), (8, None), (9, make(70))]
    rows = [(i, t, None, "s", None, 7, 0, 0.5, 1, 2, 3, 4, "d", 5, 6) for i, t in texts]
    docs = spark.createDataFrame(rows, ODD)
    spark.createDataFrame([(4, 1, 0), (None, 1, None), (9, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, ""), (3, "never said anywhere by any of these")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    shared.ship(spark)
    every = [i for i, _ in texts]
    want = {"quality_rules": [4, 5, 5, 6, 7, 9], "toxicity": every, "ngram_jaccard": [1, 2, 3, 4, 6, 8, 9], "decontamination": every}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            got = collections.Counter(r.doc_id for r in out.filter("piece = 0").collect())
            assert got == collections.Counter(every)
        else:
            assert out.columns == docs.columns
            assert sorted(r.doc_id for r in out.collect()) == want[name], name
            assert {r.text for r in out.collect()} <= {t for _, t in texts}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
