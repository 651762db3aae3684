"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

DataFrame and SQL functions only. Every count is made inside the row of its
document, so texts are neither shuffled nor exploded; what is shuffled is one
partial count a bucket and task.

Method: the tokens of a text are its runs of letters, digits and underscores
and its runs of other visible characters, in lower case. Unigrams and bigrams
are hashed into ``buckets`` buckets each. Two multinomials are estimated with
additive smoothing, one over the trusted target (documents labelled quality 1),
one over the raw corpus (all documents). The score of a text is the mean of
ln(p_target / p_raw) over its n-grams; a document is kept when its base rules
hold and the score is at least ``threshold``. The threshold is a fixed number; its
error rates on labels that the multinomials don't see are in the README.

Defined cases: a null text has no words and fails the base rule; repeated rows
are separate documents; a doc_id labelled more than once is trusted if any of
its labels is 1; without any trusted document the ratio is 0 everywhere; an
empty table gives no rows; other columns are carried along untouched by
``quality_filter``, whatever their names, and ignored by ``quality_rules``; texts of
any length are counted whole, but an array of all windows is held in the row's task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
#: Rows of labels up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    A 3-word window is found again by sorting (hash, position) packed in one
    long; neighbours of one hash are compared word by word, so different windows
    never count as equal. Equal windows would be missed only if one of another
    text had the same hash and stood between them (64 bits less the position's).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_w", F.split(F.btrim(t, F.lit(SPACES)), "[ \\x09-\\x0D]+"))
    out = out.withColumn("_w", F.when(F.col("_w")[0] == "", F.array().cast("array<string>")).otherwise(F.col("_w")))
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    out = out.withColumn("_b", F.expr("cast(64 - length(ltrim('0', lpad(bin(n_words), 64, '0'))) as int)")).withColumn("_b", F.expr("64 - _b"))
    out = out.withColumn("_s", F.expr("CASE WHEN n_words >= 3 THEN sort_array(transform(sequence(0, cast(n_words - 3 as int)), i -> shiftleft(xxhash64(_w[i], _w[i + 1], _w[i + 2]), _b) | cast(i as bigint))) ELSE cast(array() as array<bigint>) END"))
    out = out.withColumn("_m", F.expr("shiftleft(1L, _b) - 1"))
    # of two equal neighbours in the order of hashes, the later one
    same = "shiftright(x, _b) = shiftright(_s[k - 1], _b) AND _w[cast(x & _m as int)] = _w[cast(_s[k - 1] & _m as int)] AND _w[cast(x & _m as int) + 1] = _w[cast(_s[k - 1] & _m as int) + 1] AND _w[cast(x & _m as int) + 2] = _w[cast(_s[k - 1] & _m as int) + 2]"
    out = out.withColumn("_k", F.expr(f"filter(transform(_s, (x, k) -> CASE WHEN k > 0 AND {same} THEN k END), x -> x IS NOT NULL)"))
    out = out.withColumn("_p", F.expr("CASE WHEN size(_k) > 0 THEN sort_array(array_distinct(flatten(transform(_k, k -> array(cast(_s[k] & _m as int), cast(_s[k - 1] & _m as int)))))) ELSE cast(array() as array<int>) END"))
    covered = F.expr("aggregate(transform(_p, (x, k) -> CASE WHEN k = 0 THEN 3 ELSE least(3, x - _p[k - 1]) END), 0, (a, x) -> a + x)")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = out.withColumn("_l", lines)
    return (
        out.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("n_repeat_words", covered.cast("long"))
        .drop("_w", "_b", "_s", "_m", "_k", "_p", "_l")
    )


def _tokens(text: str):
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+"), F.lit(0))


def small_join(docs: DataFrame, side: DataFrame, on: str) -> DataFrame:
    """Left join that broadcasts ``side`` behind a check of its row count."""
    return docs.join(F.broadcast(side) if side.count() <= BROADCAST_ROWS else side, on, "left")


def ratio_weights(docs: DataFrame, labels: DataFrame, buckets: int, smoothing: float) -> str:
    """ln(p_target / p_raw) of the 2 * buckets buckets, as comma-separated text."""
    trusted = labels.groupBy("doc_id").agg(F.max("quality").alias("_q")).filter("_q = 1")
    rows = small_join(docs.select("doc_id", "text"), trusted, "doc_id").select(F.coalesce("_q", F.lit(0)).cast("long").alias("q"), _tokens("text").alias("t"))
    grams = rows.select("q", "t", F.posexplode("t").alias("i", "w")).select(
        "q", F.explode(F.array(F.expr(f"pmod(xxhash64(w), {buckets})"), F.expr(f"CASE WHEN i > 0 THEN {buckets} + pmod(xxhash64(t[i - 1], w), {buckets}) END"))).alias("bucket")
    )
    counts = grams.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("q").alias("c"), F.count("*").alias("r"))
    every = docs.sparkSession.range(2 * buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").na.fill(0)
    kind = every.withColumn("kind", F.expr(f"bucket div {buckets}"))
    totals = kind.groupBy("kind").agg(F.sum("c").alias("tc"), F.sum("r").alias("tr"))
    a = smoothing
    weight = F.expr(f"CASE WHEN tc = 0 THEN 0D ELSE round(ln((c + {a}D) / (tc + {a * buckets}D)) - ln((r + {a}D) / (tr + {a * buckets}D)), 5) END")
    model = kind.join(F.broadcast(totals), "kind").select("bucket", weight.cast("string").alias("w"))
    return ",".join(r.w for r in sorted(model.collect()))  # 2 * buckets rows


def ratio_score(weights: str, buckets: int, text: str = "text"):
    """Columns function: the mean ln(p_target / p_raw) of a text's n-grams; 0 without any."""

    def add(docs: DataFrame) -> DataFrame:
        docs = docs.withColumn("_t", _tokens(text))
        table = "cast(split('" + weights + "', ',') as array<double>)"
        total = F.expr(
            f"aggregate(sequence(1, size(_t)), 0D, (a, i) -> a + {table}[cast(pmod(xxhash64(_t[i - 1]), {buckets}) as int)] + CASE WHEN i > 1 THEN {table}[cast({buckets} + pmod(xxhash64(_t[i - 2], _t[i - 1]), {buckets}) as int)] ELSE 0D END)"
        )
        score = F.when(F.size("_t") > 0, F.round(total / (2 * F.size("_t") - 1), 6)).otherwise(F.lit(0.0))
        return docs.withColumn("ratio", score).drop("_t")

    return add


def _judged(rows: DataFrame, docs: DataFrame, labels: DataFrame, buckets: int = 10_000, smoothing: float = 1.0, threshold: float = -0.4) -> DataFrame:
    """``rows`` (of ``docs``) with the base counts, base_failed, ratio and kept."""
    weights = ratio_weights(docs, labels, buckets, smoothing)
    out = ratio_score(weights, buckets)(base_columns(rows))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, base counts, base_failed, ratio and kept of every document.

    ``parameters``: buckets, smoothing, threshold.
    """
    return _judged(docs.select("doc_id", "text"), docs, labels, **parameters).drop("text")


def quality_filter(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The documents that are kept, with their own columns.

    Rows travel as one struct, so no column of theirs meets one of ours. The
    filter looks at a column that isn't deterministic, which keeps the optimizer
    from substituting the whole chain of counts into it many times.
    """
    rows = docs.select(F.struct("*").alias("_doc"), F.col("text"))
    judged = _judged(rows, docs, labels, **parameters).withColumn("_row", F.monotonically_increasing_id())
    return judged.filter("_row >= 0 AND kept").select("_doc.*")
