"""Metrics of alignments, dialogues, losses and training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_best(log: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Marks rows strictly better (less) than all before, and the best so far."""
    w = Window.partitionBy(*keys).orderBy(step)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("is_best", before.isNull() | (F.col(value) < before)).withColumn("best", F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def moving_average(log: DataFrame, keys: list[str], step: str, value: str, width: int) -> DataFrame:
    """Mean of the last ``width`` values, only where all of them exist."""
    w = Window.partitionBy(*keys).orderBy(step).rowsBetween(-(width - 1), 0)
    return log.withColumn("moving", F.avg(value).over(w)).withColumn("_n", F.count(value).over(w)).filter(F.col("_n") == width).drop("_n")


def ema(log: DataFrame, keys: list[str], step: str, value: str, alpha: float = 0.1) -> DataFrame:
    """Exponential moving average, seeded by the first value.

    Closed form: a value weighs alpha (1 - alpha)^k where k rows follow it (the
    first one has no alpha), so a key is a sorted window and a sum, never an array.
    """
    w = Window.partitionBy(*keys)
    later = F.row_number().over(w.orderBy(F.col(step).desc())) - 1
    first = later == F.count("*").over(w) - 1
    weight = F.pow(F.lit(1 - alpha), later) * F.when(first, 1.0).otherwise(alpha)
    return log.withColumn("_x", weight * F.col(value).cast("double")).groupBy(*keys).agg(F.sum("_x").alias("ema"))


def training_summary(log: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """First, last, least and greatest value, improvement in percent, best step."""
    first, last = F.min_by(value, step), F.max_by(value, step)
    return log.groupBy(*keys).agg(first.alias("first"), last.alias("last"), F.min(value).alias("least"), F.max(value).alias("most"), F.min_by(step, F.struct(value, step)).alias("best_step"), F.round(F.when(first != 0, (first - last) / first * 100).otherwise(0.0), 4).alias("improvement"))


def throughput(log: DataFrame, keys: list[str], step: str, words: str, seconds: str, total_steps: int) -> DataFrame:
    """Words a second now and on average, seconds left."""
    w = Window.partitionBy(*keys).orderBy(step)
    done, spent, n = F.sum(words).over(w), F.sum(seconds).over(w), F.row_number().over(w)
    return log.withColumn("wps", F.col(words) / F.greatest(seconds, F.lit(1e-9))).withColumn("avg_wps", done / F.greatest(spent, F.lit(1e-9))).withColumn("eta", spent / n * (total_steps - n))


def warmup_cosine(step: Column, warmup: int, total: int, peak: float, low: float = 0.0) -> Column:
    up = peak * step / max(warmup, 1)
    down = low + (peak - low) * 0.5 * (1 + F.cos(F.pi() * (step - warmup) / max(total - warmup, 1)))
    return F.when(step < warmup, up).otherwise(down)


def warmup_linear(step: Column, warmup: int, total: int, peak: float) -> Column:
    return F.when(step < warmup, peak * step / max(warmup, 1)).otherwise(peak * F.greatest(F.lit(0.0), (total - step) / max(total - warmup, 1)))


def weighted_loss(rows: DataFrame, keys: list[str], loss: str, weight: str | Column) -> DataFrame:
    """sum(w * loss) / sum(w)."""
    w = F.col(weight) if isinstance(weight, str) else weight
    return rows.groupBy(*keys).agg(F.sum(w * F.col(loss)).alias("num"), F.sum(w).alias("den")).withColumn("loss", F.when(F.col("den") != 0, F.col("num") / F.col("den")).otherwise(0.0)).drop("num", "den")


def perplexity(loss: Column) -> Column:
    """2 ** loss."""
    return F.pow(F.lit(2.0), loss)


def codebook_loss(rows: DataFrame, mask: Column, loss: str) -> DataFrame:
    """Masked mean, least and greatest loss of each codebook."""
    x = F.when(mask, F.col(loss))
    return rows.groupBy("codebook").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"))


def entropy(values: Column) -> Column:
    """Entropy of the softmax of an array."""
    from turnwise.operators.arrays import let

    add = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    powers = let(F.array_max(values), lambda top: F.transform(values, lambda v: F.exp(v - top)))
    shares = lambda e, total: F.aggregate(e, F.lit(0.0), lambda a, x: a - (x / total) * F.log(x / total + 1e-10))
    return let(powers, lambda e: let(add(e), lambda total: shares(e, total)))


def token_usage(tokens: DataFrame, top: int = 10) -> DataFrame:
    """Distinct and total tokens of each codebook, the entropy of their shares and the most frequent ones."""
    n = tokens.groupBy("codebook", "token").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("codebook").orderBy(F.col("n").desc(), "token"))
    n = n.withColumn("_r", r)
    best = F.array_sort(F.collect_list(F.when(F.col("_r") <= top, F.struct("_r", "token"))))
    return n.groupBy("codebook").agg(F.count("*").alias("distinct"), F.sum("n").alias("total"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"), F.transform(best, lambda x: x["token"]).alias("top"))


def norm_summary(rows: DataFrame, value: str, high: float = 100.0, low: float = 1e-7) -> DataFrame:
    """Summary of norms, flags, counts of values that aren't finite."""
    v = F.col(value)
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    x = F.when(finite, v)
    return rows.agg(F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"), F.stddev_pop(x).alias("std"), F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(F.abs(v) == float("inf")).alias("n_inf"), F.coalesce(F.max(x) > high, F.lit(False)).alias("exploding"), F.coalesce(F.max(x) < low, F.lit(False)).alias("vanishing"))


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation, least and greatest."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))


def positive_means(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Means over positive values only, 0 without any."""
    return rows.agg(*(F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0)).alias(c) for c in columns))


def alignment_quality(words: Column, *confidences: Column) -> Column:
    """Mean of word coverage, the sides' confidences and the share of sides present."""
    present = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in confidences), F.lit(0))
    parts = F.filter(F.array(F.when(words > 0, F.least(words / 100.0, F.lit(1.0))), *confidences, present / float(len(confidences))), lambda x: x.isNotNull())
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)


def word_diagnostics(words: DataFrame) -> DataFrame:
    """Counts of doubtful words; a negative duration counts as a zero one as well."""
    d, c = F.col("w_end_ms") - F.col("w_start_ms"), F.col("confidence")
    n = F.count("*")
    out = words.agg(n.alias("n"), F.count_if(c < 0.5).alias("low"), F.count_if(c < 0.3).alias("very_low"), F.count_if(d <= 0).alias("zero"), F.count_if(d < 0).alias("negative"))
    bad = F.col("low") + F.col("very_low") + F.col("zero") + F.col("negative")
    return out.withColumn("quality", F.when(F.col("n") > 0, F.round(F.greatest(F.lit(0.0), 1 - bad / F.col("n")), 6)).otherwise(0.0))


def match_scores(matched: Column, detected: Column, truth: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of counts."""
    p = F.when(detected > 0, matched / detected).otherwise(0.0)
    r = F.when(truth > 0, matched / truth).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def sync_score(timing_error: Column, f1: Column, coverage: Column, worst: float = 10.0) -> Column:
    """0.4 timing + 0.4 F1 + 0.2 coverage; errors in frames, coverage best at 0.4."""
    timing = F.greatest(F.lit(0.0), 1 - timing_error / worst)
    return 0.4 * timing + 0.4 * f1 + 0.2 * F.greatest(F.lit(0.0), 1 - F.abs(coverage - 0.4) * 2)


def turn_taking_score(overlap: Column, silence: Column, latency: Column, main_turns: Column, user_turns: Column, interruptions: Column, natural: tuple[float, float] = (2, 8)) -> Column:
    """Mean of the piecewise-linear components that apply.

    Overlap is best at 0.1, silence from 0.2 to 0.4, latency (frames) in the
    natural range, turns shared evenly, few of the main turns interruptions.
    """
    low, high = natural
    total = main_turns + user_turns
    floor0 = lambda c: F.greatest(F.lit(0.0), c)
    parts = [
        1 - F.least(F.abs(overlap - 0.1), F.lit(0.3)) / 0.3,
        F.when(silence < 0.2, silence / 0.2).when(silence <= 0.4, 1.0).otherwise(floor0(1 - (silence - 0.4) / 0.4)),
        F.when(latency > 0, F.when(latency < low, latency / low).when(latency <= high, 1.0).otherwise(floor0(1 - (latency - high) / high))),
        F.when(total > 0, floor0(1 - F.abs(main_turns / total - 0.5) * 2)),
        F.when(main_turns > 0, 1 - F.least(interruptions / main_turns, F.lit(0.5)) * 2),
    ]
    known = F.filter(F.array(*(p.cast("double") for p in parts)), lambda x: x.isNotNull())
    return F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)


def activity(frames: DataFrame, keys: list[str], mask: Column, least: int) -> DataFrame:
    """Share of frames under a mask, and its runs of at least ``least`` frames."""
    from turnwise.operators.segments import speech_runs

    runs = speech_runs(frames.withColumn("active", mask), keys).withColumn("len", F.col("end") - F.col("start")).filter(F.col("len") >= least)
    r = runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.avg("len").alias("mean_len"))
    total = frames.groupBy(*keys).agg(F.avg(F.when(mask, 1.0).otherwise(0.0)).alias("ratio"))
    return total.join(r, keys, "left").na.fill({"runs": 0, "mean_len": 0.0})


def backchannels(runs: DataFrame, keys: list[str], longest: int = 10) -> DataFrame:
    """Short main segments and the mean length of a turn."""
    n = F.col("end") - F.col("start")
    return runs.groupBy(*keys).agg(F.count_if(n <= longest).alias("backchannels"), F.avg(n).alias("mean_turn"))


def prefixed(rows: DataFrame, keys: list[str], monitor: str) -> DataFrame:
    """Metrics as rows (keys, monitor/name, value)."""
    names = [c for c in rows.columns if c not in keys]
    out = rows.select(*keys, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(keys, names, "name", "value")
    return out.withColumn("name", F.concat(F.lit(f"{monitor}/"), "name"))


def _ngrams(words: str, n: int) -> Column:
    made = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(F.col(words), i, F.lit(n)), " "))
    return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>"))


def _matched(n: int) -> Column:
    """Number of n-grams of ``hyp`` that ``ref`` has, each as often as there at most.

    In one sorted array those of ``ref`` stand before equal ones of ``hyp``, which
    take one each while any is left.
    """
    of = lambda side, k: F.transform(_ngrams(side, n), lambda g: F.struct(g.alias("gram"), F.lit(k).alias("k")))
    start = F.struct(F.lit(None).cast("string").alias("gram"), F.lit(0).alias("left"), F.lit(0).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        left = F.when(acc["gram"].eqNullSafe(x["gram"]), acc["left"]).otherwise(0)
        taken = F.when((x["k"] == 1) & (left > 0), 1).otherwise(0)
        return F.struct(x["gram"].alias("gram"), F.when(x["k"] == 0, left + 1).otherwise(left - taken).alias("left"), (acc["hit"] + taken).alias("hit"))

    return F.aggregate(F.sort_array(F.concat(of("ref", 0), of("hyp", 1))), start, step, lambda acc: acc["hit"])


def sentence_bleu(pairs: DataFrame, order: int = 4) -> DataFrame:
    """BLEU of each (id, ref words, hyp words), 0..100: exponential smoothing, orders up to the hypothesis's length.

    The k-th order in a row without a hit counts 1 / 2^k of a hit.
    """

    out = pairs
    for n in range(1, order + 1):
        out = out.withColumn(f"_m{n}", _matched(n)).withColumn(f"_n{n}", F.greatest(F.size("hyp") - n + 1, F.lit(0)))
    missed, logs, used = F.lit(0), F.lit(0.0), F.lit(0)
    for n in range(1, order + 1):
        here = F.col(f"_n{n}") > 0
        missed = missed + F.when(here & (F.col(f"_m{n}") == 0), 1).otherwise(0)
        share = F.when(F.col(f"_m{n}") > 0, F.col(f"_m{n}") / F.col(f"_n{n}")).otherwise(1 / (F.pow(F.lit(2.0), missed) * F.col(f"_n{n}")))
        logs, used = logs + F.when(here, F.log(share)).otherwise(0.0), used + here.cast("int")
    bp = F.when(F.size("hyp") >= F.size("ref"), 1.0).otherwise(F.exp(1 - F.size("ref") / F.size("hyp")))
    score = F.when((F.size("hyp") > 0) & (F.col("_m1") > 0), 100 * bp * F.exp(logs / used)).otherwise(0.0)
    return out.select("id", score.alias("bleu"))


def corpus_bleu(pairs: DataFrame, order: int = 4) -> DataFrame:
    """Corpus BLEU 1..order of (id, ref words, hyp words), with brevity penalty.

    Matches are counted within the row (see ``_matched``), so only sums are shuffled.
    Without any word on both sides all values are null.
    """
    many = lambda side, n: F.coalesce(F.greatest(F.size(side) - n + 1, F.lit(0)), F.lit(0))
    sums = [x for n in range(1, order + 1) for x in (F.sum(_matched(n)).alias(f"m{n}"), F.sum(many("hyp", n)).alias(f"n{n}"))]
    total = pairs.agg(*sums, F.sum(many("ref", 1)).alias("r"))
    none = F.col("r") + F.col("n1") == 0
    logs = [F.log(F.col(f"m{n}") / F.nullif(F.col(f"n{n}"), F.lit(0))).alias(f"p{n}") for n in range(1, order + 1)]
    both = total.select(*logs, F.when(~none, F.col("r")).alias("ref_len"), F.when(~none, F.col("n1")).alias("hyp_len"))
    ratio = F.col("hyp_len") / F.nullif(F.col("ref_len"), F.lit(0))
    bp = F.when(F.col("hyp_len") >= F.col("ref_len"), 1.0).otherwise(F.exp(1 - F.col("ref_len") / F.nullif(F.col("hyp_len"), F.lit(0))))
    means = [F.round(bp * F.exp(sum((F.col(f"p{k}") for k in range(1, n + 1)), F.lit(0.0)) / n), 6).alias(f"bleu{n}") for n in range(1, order + 1)]
    return both.select(*means, F.round(bp, 6).alias("brevity"), F.round(ratio, 6).alias("length_ratio"))
