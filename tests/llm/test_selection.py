"""Ranked search, sharding and resampling against plain versions and their SQL."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import lexical, resampling, shared, sharding
from turnwise.llm.queries import ORACLE_SQL, QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score string, rank int, shard string, _score long, row long"


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def words(text):
    return WORD.findall((text or "").translate(LOW))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdeé1Ñ", k=rng.randint(1, 5))) for _ in range(300)]
    make = lambda n: " ".join(rng.choices(vocab, k=n))
    out = [(i, make(rng.randint(1, 90))) for i in range(150)]
    out += [(i, out[3][1]) for i in range(150, 190)]  # copies: equal scores
    out += [(190, None), (191, ""), (192, " ,;- \n"), (193, "x" * 5000), (194, make(20_000)), (195, out[7][1].upper()), (7, out[7][1]), (None, out[3][1]), (None, "lone words of a nameless row " * 5)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    shared.ship(spark)
    return spark.createDataFrame([(i, t, "s", 1, "x", 5, 6) for i, t in texts], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def items(texts):
    return [(1, texts[3][1]), (2, texts[0][1] + " " + texts[9][1]), (3, None), (4, "!!"), (5, "unheard zzzz qqqq"), (6, texts[20][1].upper()), (6, texts[21][1]), (None, texts[5][1]), (8, texts[3][1] + " " + texts[3][1])]


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_ranks(texts, item, k):
    held = [(i, collections.Counter(terms(t))) for i, t in texts]
    n_live, n_all = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    out = []
    for i, c in held:
        m = 75 + 25 * sum(c.values()) * n_live // max(n_all, 1)
        score = sum(math.floor(1000 * math.log((2 * n_live + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(item) if w in c)
        if score > 0:
            out.append((-score, i is not None, i or 0))
    return [(r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(out)[:k])]


@pytest.mark.parametrize("k", [1, 7, 20, 500])
def test_ranks(spark, docs, texts, items, k):
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(((r.item_id is None, r.item_id or 0, r["rank"], r.doc_id, r.score) for r in lexical.rank_documents(docs, bench, k).collect()), key=str)
    want = sorted(((i is None, i or 0, *x) for i, t in items for x in plain_ranks(texts, t, k)), key=str)
    assert got == want


def test_ranks_over_shards_and_blocks(spark, docs, texts, items, monkeypatch):
    for name, value in (("SHARD_DOCS", 7), ("SHARD_POSTINGS", 150), ("BLOCK_ITEMS", 2)):
        monkeypatch.setattr(lexical, name, value)
    index = lexical.build_index(docs, np.unique(np.concatenate([lexical._terms(t or "") for _, t in items])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank_documents(docs, bench).collect()), key=str)
    assert got == sorted(((i, *x) for i, t in items for x in plain_ranks(texts, t, 20)), key=str)
    assert index.live == sum(bool(terms(t)) for _, t in texts)


def test_bytes_bound_impacts():
    rng = np.random.default_rng(5)
    tf, m = rng.integers(1, 10_000, 5000), rng.integers(75, 10**7, 5000)
    x = lexical.impact(tf, m)
    b = -(-x // lexical.STEP)
    assert (x < lexical.MOST).all() and (b <= 255).all() and (b * lexical.STEP >= x).all() and ((b - 1) * lexical.STEP < x).all()


def test_every_document_at_the_bound_is_rescored():
    """Documents whose bytes tie are told apart by exact scores."""
    row = {"ids": np.arange(6).astype("<i8"), "sizes": np.array([10, 11, 12, 13, 14, 15], "<u4"), "terms": np.array([0], "<u4"), "counts": np.array([6], "<u4"), "places": np.arange(6).astype("<u2"), "tf": np.ones(6, "<u4")}
    m = lexical.length_norm(row["sizes"].astype(np.int64), 1000, 10**6)
    row["bytes"] = (-(-lexical.impact(np.ones(6, np.int64), m) // lexical.STEP)).astype(np.uint8)
    ids, scores = lexical.Shard({k: v.tobytes() for k, v in row.items()}, 1000, 10**6).best([0], [5], 2, 0)
    assert sorted(zip(-scores, ids, strict=True))[:2] == [(-5 * int(lexical.impact(1, int(m[k]))), k) for k in (0, 1)]


def test_no_ranks_of_empty_tables(spark, docs, empty, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.rank_documents(empty, bench).count() == 0
    assert lexical.rank_documents(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 15, 16, 17, 100, 1000])
def test_permutation(spark, n):
    got = [sharding.permuted(i, n, 9) for i in range(n)]
    assert sorted(got) == list(range(n))
    assert [sharding.unpermuted(p, n, 9) for p in got] == list(range(n))
    assert [sharding.row_at(*sharding.place_of(i, n, 16, 9), n, 16, 9) for i in range(n)] == list(range(n))
    column = spark.range(n).select("id", sharding.position(F.col("id"), n, 9).alias("p")).collect()
    assert [r.p for r in sorted(column)] == got


def test_permutation_is_mixed():
    n = 4000
    got = np.array([sharding.permuted(i, n, 1) for i in range(n)])
    assert abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.05 and abs(np.corrcoef(got[:-1], got[1:])[0, 1]) < 0.05
    first = np.bincount(got[:1000] % 16, minlength=16)
    assert first.min() > 30 and first.max() < 100
    assert (got != [sharding.permuted(i, n, 2) for i in range(n)]).mean() > 0.99


def test_permutation_of_many_rows(spark):
    for n in (10**12 + 39, 3 * 10**9):
        some = [0, 1, n // 2, n - 1, 123_456_789]
        rows = spark.createDataFrame([(i,) for i in some], "id long").select("id", sharding.position(F.col("id"), n).alias("p")).collect()
        assert {r.id: r.p for r in rows} == {i: sharding.permuted(i, n) for i in some}
        assert all(0 <= r.p < n and sharding.unpermuted(r.p, n) == r.id for r in rows)


def plain_places(texts, shards, seed=0):
    rows = sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    return sorted((i if known else None, size, crc, *sharding.place_of(r, len(rows), shards, seed)) for r, (known, i, size, crc) in enumerate(rows) if known), rows


def test_places(spark, docs, texts):
    rows = sharding.shard_places(docs).collect()
    want, every = plain_places(texts, 16)
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in rows if r.doc_id is not None) == want
    counts = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(every) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert sorted(map(str, sharding.shard_places(docs.repartition(1)).collect())) == sorted(map(str, rows))


def test_no_places_of_an_empty_table(empty):
    assert sharding.shard_places(empty).count() == 0


def test_written_shards(spark, docs, texts, tmp_path):
    named = docs.withColumnsRenamed({"shard": "doc"})
    out = sharding.write_shards(named, f"file://{tmp_path}/shards", 4, seed=5)
    places = {(r.doc_id, r["size"], r.text_crc32): (r.shard, r.slot) for r in sharding.shard_places(docs, 4, 5).collect()}
    rows = out.collect()
    assert len(rows) == len(texts) and set(rows[0].doc.asDict()) == set(named.columns)
    once = collections.Counter((i, t) for i, t in texts)
    for r in rows:
        t = r.doc.text or ""
        if once[r.doc.doc_id, r.doc.text] == 1 and r.doc.doc_id is not None:
            assert places[r.doc.doc_id, len(t.encode()) + 1, zlib.crc32(t.encode())] == (r.shard, r.slot)


def plain_resampling(texts, target, percent=10, least=20, buckets=10_000, high=1):
    def arrays(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, high + 1) for i in range(len(w) - n + 1)]

    s, t = collections.Counter(b for _, x in texts for b in arrays(x)), collections.Counter(b for x in target for b in arrays(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for i, x in texts:
        a = arrays(x)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in a]
        weight = sum(gain) // len(a) if a else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(a), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least])
    order = sorted((-r[3], r[0] is not None, r[0] or 0, r[1], r[2], k) for k, r in enumerate(out) if r[4])
    ranks = {o[-1]: r + 1 for r, o in enumerate(order[: percent * len(order) // 100])}
    return sorted(((*r[:4], ranks.get(k)) for k, r in enumerate(out)), key=str)


@pytest.mark.parametrize("how", [{}, {"percent": 100}, {"percent": 0}, {"percent": 37, "high": 2, "least": 1, "buckets": 50}])
def test_resampling(docs, texts, items, spark, how):
    bench = spark.createDataFrame([(t, 1) for _, t in items], "text string, doc_id int")
    names = {"least": "least_words"}
    rows = resampling.resampling_scores(docs, bench, **{names.get(k, k): v for k, v in how.items()}).collect()
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows), key=str)
    assert got == plain_resampling(texts, [t for _, t in items], **how)


def test_rank_within_a_hot_score(spark, monkeypatch):
    """Half of all rows have one score: these are ranked by doc_id over all partitions."""
    monkeypatch.setattr(resampling, "noise", lambda seed: F.when(F.col("doc_id") % 2 == 0, 7).otherwise(F.col("doc_id") % 5).cast("long"))
    df = spark.createDataFrame([(i, "a b c " * 7) for i in range(1000)], "doc_id long, text string").repartition(6)
    got = {r.doc_id: r["rank"] for r in resampling.resampling_scores(df, df.limit(0), percent=30).collect()}
    assert {i: k for i, k in got.items() if k} == {2 * k: k + 1 for k in range(300)} and len(got) == 1000


def test_drawn_documents(docs, spark, items):
    bench = spark.createDataFrame([(t,) for _, t in items], "text string")
    ranked = {r.doc_id for r in resampling.resampling_scores(docs, bench, percent=30).collect() if r["rank"] is not None}
    out = resampling.drawn(docs, bench, percent=30)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == ranked


def test_resampling_of_empty_tables(docs, texts, empty, spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resampling_scores(empty, docs.select("text")).count() == 0
    rows = resampling.resampling_scores(docs, none).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows), key=str) == plain_resampling(texts, [])


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_sharding", "op13_importance_resampling"])
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    found = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, found.fetchall()))
