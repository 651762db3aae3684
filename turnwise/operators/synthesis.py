"""Timing and selection of synthetic dialogues, all draws by seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.text import seeded_share


def normal(seed: int, *keys: str, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """A normal draw by Box and Muller from two seeded shares."""
    u = F.greatest(seeded_share(seed, *keys), F.lit(2.0**-33))
    return mean + deviation * F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * seeded_share(seed + 1, *keys))


def turn_times(turns: DataFrame, seed: int, overlap_p: float = 0.35) -> DataFrame:
    """Start times of turns (conv_id, pos, speaker, dur): running sums of gaps and durations.

    A change of speaker overlaps with probability ``overlap_p`` or leaves a
    log-normal gap; one speaker going on pauses shortly.
    """
    w = Window.partitionBy("conv_id").orderBy("pos")
    keys = ("conv_id", "pos")
    same = F.lag("speaker").over(w) == F.col("speaker")
    overlap = -F.abs(normal(seed + 2, *keys, mean=0.3, deviation=0.15))
    gap = F.exp(normal(seed + 4, *keys, mean=-0.9, deviation=0.4))
    pause = F.abs(normal(seed + 6, *keys, mean=0.3, deviation=0.1))
    g = F.when(F.col("pos") == 0, 0.0).when(same, pause).when(seeded_share(seed, *keys) < overlap_p, overlap).otherwise(gap)
    t = turns.withColumn("gap", g)
    end = F.sum(F.col("gap") + F.col("dur")).over(w)
    return t.withColumn("start", F.greatest(end - F.col("dur"), F.lit(0.0))).withColumn("end", F.col("start") + F.col("dur"))


def backchannels(timed: DataFrame, tokens: dict[str, float], seed: int, p: float = 0.25, shortest: float = 2.0, margin: float = 0.5) -> DataFrame:
    """Listener's tokens inside long turns, not in their last half second."""
    keys = ("conv_id", "pos")
    long = timed.filter((F.col("dur") >= shortest) & (seeded_share(seed, *keys) < p))
    at = F.col("start") + 0.5 + 1.5 * seeded_share(seed + 1, *keys)
    u, total = seeded_share(seed + 2, *keys), sum(tokens.values())
    pick, below = F.lit(None).cast("string"), 0.0
    for name, weight in tokens.items():
        pick = F.when(pick.isNull() & (u < (below + weight) / total), name).otherwise(pick)
        below += weight
    return long.withColumn("at", at).withColumn("token", pick).filter(F.col("at") < F.col("end") - margin).select("conv_id", "pos", "at", "token")


def question_turns(ids: DataFrame, templates: DataFrame, seed: int, style: str = "formal") -> DataFrame:
    """(id, category, turns): a question and an answer for every id, by seeded choice.

    ``templates``: category, questions, and answers as a map from style to texts;
    a category without the style answers in style ``base``. The templates are a
    small dimension table: one row a category.
    """
    n = templates.count()
    ranked = templates.withColumn("_k", F.row_number().over(Window.orderBy("category")) - 1)
    pick = lambda texts, k: F.element_at(texts, (F.floor(seeded_share(seed + k, "id") * F.size(texts)) + 1).cast("int"))
    answers = F.coalesce(F.try_element_at("answers", F.lit(style)), F.try_element_at("answers", F.lit("base")))
    j = ids.withColumn("_k", F.floor(seeded_share(seed, "id") * n).cast("int")).join(F.broadcast(ranked) if n <= 100_000 else ranked, "_k").withColumn("_a", answers)
    turn = lambda speaker, text: F.struct(F.lit(speaker).alias("speaker"), text.alias("text"))
    return j.select("id", "category", F.array(turn("user", pick(F.col("questions"), 1)), turn("assistant", pick(F.col("_a"), 2))).alias("turns"))


def with_questions(dialogues: DataFrame, templates: DataFrame, seed: int, p: float = 0.15, latest: int = 3, style: str = "formal") -> DataFrame:
    """Dialogues (id, turns) of which a share ``p`` gets a question and answer among its first turns.

    The place is one of 0 .. min(latest, number of turns), all alike. Only the chosen
    dialogues are joined with the templates.
    """
    chosen = dialogues.filter(seeded_share(seed, "id") < p)
    asked = question_turns(chosen.select("id"), templates, seed + 1, style).select("id", F.col("turns").alias("_new"))
    at = F.floor(seeded_share(seed + 10, "id") * (F.least(F.lit(latest), F.size("turns")) + 1)).cast("int")
    spliced = F.concat(F.slice("turns", F.lit(1), at), F.col("_new"), F.slice("turns", at + 1, F.greatest(F.size("turns") - at, F.lit(0))))
    out = chosen.join(asked, "id").withColumn("turns", spliced).drop("_new")
    return dialogues.filter(F.coalesce(seeded_share(seed, "id") >= p, F.lit(True))).unionByName(out)


def inject(dialogues: DataFrame, inserts: DataFrame, seed: int, p: float = 0.15, latest: int = 3) -> DataFrame:
    """Puts an insert's turns into some dialogues (id, turns) at an early place."""
    n = inserts.count()
    if not n:
        return dialogues
    keyed = inserts.withColumn("_k", F.row_number().over(Window.orderBy("insert_id")) - 1)
    d = dialogues.withColumn("_k", F.floor(seeded_share(seed, "id") * n).cast("int")).withColumn("_on", seeded_share(seed + 1, "id") < p)
    at = F.least(F.floor(seeded_share(seed + 2, "id") * (latest + 1)).cast("int"), F.size("turns"))
    j = d.join(F.broadcast(keyed.select("_k", "insert")) if n <= 100_000 else keyed.select("_k", "insert"), "_k", "left")
    spliced = F.concat(F.slice("turns", F.lit(1), at), F.col("insert"), F.slice("turns", at + 1, F.greatest(F.size("turns") - at, F.lit(0))))
    return j.withColumn("turns", F.when(F.col("_on"), spliced).otherwise(F.col("turns"))).drop("_k", "_on", "insert")


def best_take(takes: DataFrame, limit: Column) -> DataFrame:
    """The take of least error rate of each item, if within its limit."""
    r = F.row_number().over(Window.partitionBy("item").orderBy("wer", "take"))
    return takes.withColumn("_r", r).filter((F.col("_r") == 1) & (F.col("wer") <= limit)).drop("_r")
