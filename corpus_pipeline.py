"""Corpus pipeline: quality rules, toxicity, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. ``run`` writes each result in the shared folder and rereads it as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.

Defined cases of every stage: an empty table gives none; columns beyond doc_id and
text may have any names and are carried along (packing leaves them out); texts of
any length are read whole. Each stage says what it does with null and empty texts,
with repeated rows and with ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import shared
from turnwise.llm.decontam import decontaminate
from turnwise.llm.ngram_join import one_of_each
from turnwise.llm.packing import best_fit_packing
from turnwise.llm.quality import quality_filter
from turnwise.llm.queries import table, vocabulary
from turnwise.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and wordless texts go (they have under 50 words). Repeated rows are
    judged alike and all stay or go. A ratio equal to the threshold stays.
    """
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic.

    Null, empty and wordless texts stay. Repeated rows are judged alike. A score
    equal to 0.7 goes. Without labels of both classes all documents stay.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that of the smallest doc_id.

    Null, empty and wordless texts are linked with nothing and stay. Of rows with
    one doc_id a fixed one stays, whatever the order of rows.
    """
    shared.ship(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null, empty and wordless texts stay, and items without words match nothing.
    Repeated rows are judged alike. A score or an overlap equal to its threshold
    is a leak. Without a benchmark all documents stay.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens.

    Null and empty texts are a piece of the end id alone. Repeated rows are packed
    each. Which of equally long pieces comes first has no meaning.
    """
    shared.ship(spark)
    return best_fit_packing(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("toxicity", toxicity),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the tokenizer, the dictionaries and the hashed ratios;
#: tests compare every stage with a plain version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = shared.save(stage(spark, docs, sf_dir), f"stage-{name}")
        shared.drop(*before)  # no later plan reads it
        before = [docs]
    return docs
