"""Importance resampling towards a target distribution, without exploding texts to score them.

A text's features are its runs of ``low`` to ``high`` consecutive words, hashed into
``buckets`` buckets. Higher-order functions make one array of buckets a
document, which is saved, so texts are read once. What is shuffled of it are
totals: one partial count a bucket and task. The gain of a bucket is
floor(1000 ln) of the target's smoothed share over the corpus' share; all gains
are one literal array, and a document's weight is an aggregate over its own
array of ``element_at`` in it, so scoring has neither join nor shuffle.

Scores are weights plus seeded Gumbel noise, so the highest scores are a draw
without replacement. Scores are integers in a range that doesn't grow with the
corpus (gains and noise are both logarithms), so a histogram of scores gives the
cut; rows at or above it are then numbered by ranges of (score, doc_id), so that
a score which many rows share goes to as many tasks as it takes.

Defined cases: a null text has no words; a document without features has weight
0; equal scores go by ascending doc_id (null first), repeated rows are separate
documents with one score and ranks of their own; a null doc_id hashes as the seed
alone; without documents there are no rows, without target texts T is 0; other
columns are ignored by ``resampling_scores`` and carried along by ``drawn``;
texts of any length are counted whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm import shared
from turnwise.llm.sharding import number_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _features(words: str, low: int, high: int) -> Column:
    if (low, high) == (1, 1):
        return F.col(words)
    runs = [F.expr(f"CASE WHEN size({words}) >= {n} THEN transform(sequence(1, size({words}) - {n - 1}), i -> array_join(slice({words}, i, {n}), ' ')) ELSE cast(array() as array<string>) END") for n in range(low, high + 1)]
    return F.concat(*runs)


def bucket_arrays(texts: DataFrame, keep: list[str], buckets: int = 10_000, low: int = 1, high: int = 1) -> DataFrame:
    """``keep``, ``n_words`` and ``buckets``: the bucket of every feature of a text."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    out = texts.select(*keep, words.alias("_words"))
    bucket = F.transform(_features("_words", low, high), lambda f: F.pmod(F.crc32(f.cast("binary")), F.lit(buckets)).cast("int"))
    return out.select(*keep, F.size("_words").cast("long").alias("n_words"), bucket.alias("buckets"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """floor(1000 ln(target share / corpus share)) of every bucket, with one added to each count."""
    both = corpus.select(F.lit(0).alias("t"), "buckets").unionAll(target.select(F.lit(1).alias("t"), "buckets"))
    counts = both.select("t", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("t").alias("t"), F.count("*").alias("n"))
    s, t = [0] * buckets, [0] * buckets
    for bucket, of_target, every in counts.collect():  # ``buckets`` rows at most
        s[bucket], t[bucket] = every - of_target, of_target
    corpus_size, target_size = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((y + 1) * corpus_size / ((x + 1) * target_size))) for x, y in zip(s, t, strict=True)]


def weight(gains: list[int]) -> Column:
    """Floored mean of the gains of a row's ``buckets``; 0 without any."""
    table = f"cast(split('{','.join(map(str, gains))}', ',') as array<bigint>)"
    mean = f"aggregate(buckets, 0L, (a, b) -> a + element_at({table}, b + 1), a -> (a - pmod(a, cast(size(buckets) as bigint))) div size(buckets))"
    return F.expr(f"CASE WHEN size(buckets) > 0 THEN {mean} ELSE 0L END")


def noise(seed: int) -> Column:
    """Gumbel noise of a document in thousandths, from its doc_id and the seed."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000) * F.log(-F.log(share))).cast("long")


def resampling_scores(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, low: int = 1, high: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document."""
    corpus = shared.save(bucket_arrays(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], buckets, low, high), "buckets")
    gains = bucket_gains(corpus, bucket_arrays(target.select("text"), [], buckets, low, high), buckets)
    scored = corpus.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight(gains).alias("weight"))
    scored = shared.save(scored.withColumn("score", F.col("weight") + noise(seed)), "scores")
    shared.drop(corpus)

    long_enough = F.col("n_words") >= least_words
    heights = sorted(scored.filter(long_enough).groupBy("score").count().collect(), reverse=True)  # a row a score: a bounded range of integers
    wanted = percent * sum(r[1] for r in heights) // 100
    cut, before = None, 0
    for score, n in heights:
        if before >= wanted:
            break
        cut, before = score, before + n
    reached = F.lit(False) if cut is None else long_enough & (F.col("score") >= cut)
    # drawn rows and those of the cut's own score, numbered by ranges: many rows may share a score
    first, _ = number_rows(scored.filter(reached).withColumn("_down", -F.col("score")), ("_down", "doc_id", "n_features", "weight"))
    first = first.withColumn("rank", F.when(F.col("row") < wanted, F.col("row") + 1))
    others = scored.filter(~reached).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return first.select(*columns).unionAll(others.select(*columns))


def drawn(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The documents drawn, with all their columns; rows of a drawn doc_id all come."""
    ranks = resampling_scores(docs, target, **parameters).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ranks, docs["doc_id"].eqNullSafe(ranks["_drawn"]), "left_semi")
