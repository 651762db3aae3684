"""Places where learned components plug in, as Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType


#: Ids that a tokenizer column holds before it hands them on: a batch has thousands of texts of any length.
HELD_IDS = 1_000_000


def _encoded(texts: Iterator[pd.Series], one: Callable[[str | None], list[int]], held: int = HELD_IDS) -> Iterator[pd.Series]:
    """Ids of each text as an array, in pieces of about ``held`` ids."""
    for batch in texts:
        out: list[np.ndarray] = []
        n = 0
        for t in batch:
            out.append(np.array(one(t), dtype=np.int64))
            n += len(out[-1])
            if n >= held:
                yield pd.Series(out, dtype=object)
                out, n = [], 0
        if out:
            yield pd.Series(out, dtype=object)


def tokenizer_column(encode: Callable[[str], list[int]]) -> Callable[[Column], Column]:
    """A column function of token ids from a text encoder."""

    @F.pandas_udf(ArrayType(LongType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _encoded(texts, lambda t: [] if t is None else list(encode(t)))

    return run


def line_tokenizer_column(encode: Callable[[str], list[int]], newline: int, bos: int | None = None) -> Callable[[Column], Column]:
    """A column function of token ids, line by line with ``newline`` between lines, behind ``bos``.

    For subword sampling hand in an ``encode`` that samples. A null text is empty.
    """

    def one(t: str | None) -> list[int]:
        out = [] if bos is None else [bos]
        for k, line in enumerate((t or "").split("\n")):
            out += ([newline] if k else []) + list(encode(line))
        return out

    @F.pandas_udf(ArrayType(LongType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _encoded(texts, one)

    return run


def signal_column(f: Callable[[list[float]], list[float]]) -> Callable[[Column], Column]:
    """A column function over sample arrays (resampling, trimming, codecs)."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda a: None if a is None else [float(x) for x in f(list(a))])

    return run


def score_column(f: Callable[[list[float], list[float]], float]) -> Callable[[Column, Column], Column]:
    """A column function of two signals (external quality scores)."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(f(list(x), list(y))) for x, y in zip(a, b, strict=True)])

    return run


def align(conversations: DataFrame, aligner: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Words from an acoustic aligner, a conversation at a time."""
    return conversations.groupBy("conv_id").applyInPandas(aligner, schema)
