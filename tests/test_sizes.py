"""Queries on values and plans that only larger tables show."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnwise.functions import korean as K
from turnwise.functions import seams
from turnwise.functions import text as T
from turnwise.operators import tokens
from turnwise.plans import queries as Q


@pytest.fixture(scope="module")
def near_whole(spark, tmp_path_factory):
    """Vectors of single-precision values of which many come to a whole number of thousandths only by rounding."""
    d = tmp_path_factory.mktemp("near")
    rows = [[float(np.float32(k * 64 + i) / np.float32(1000)) * (-1) ** i for i in range(64)] for k in range(8)]
    spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return str(d), np.array(rows, dtype=np.float32)


def test_padded_codebooks_scale_in_single_precision(spark, near_whole):
    d, rows = near_whole
    got = {r.vec_id: r.books.split(";") for r in Q.QUERIES["padded_codebooks"](spark, d).collect()}
    for k, row in enumerate(rows):
        assert [int(x) for b in got[k][:4] for x in b.split(",")] == np.trunc(row * np.float32(1000)).astype(int).tolist()


def test_prompted_codes_scale_in_single_precision(spark, near_whole):
    d, rows = near_whole
    got = {r.vec_id: r.codes for r in Q.QUERIES["prompted_codes"](spark, d).collect()}
    for k, row in enumerate(rows):
        assert [int(x) for x in got[k].split(",")] == np.trunc(abs(row) * np.float32(1000)).astype(int).tolist()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_token_times_join_nothing(spark, sf):
    assert "Join" not in plan(Q.QUERIES["token_times"](spark, sf))


def test_greedy_matches_start_no_group_of_its_own(spark, sf):
    p = plan(Q.QUERIES["greedy_matches"](spark, sf))
    assert "FlatMapGroups" not in p and "MapInArrow" in p


def test_corpus_bleu_explodes_no_grams(spark, sf):
    assert "Generate" not in plan(Q.QUERIES["corpus_bleu"](spark, sf))


@pytest.mark.parametrize("name", ["queued_frames", "token_frames", "crowded_frames"])
def test_frames_are_no_rows(spark, sf, name):
    p = plan(Q.QUERIES[name](spark, sf))
    assert "explode(CASE WHEN" not in p and "explode(sequence" not in p


def test_frames_under_padding_tokens(spark):
    words = [(1, 0.0, 0.4, [7, -1, 8]), (1, 0.5, 1.0, [9, 5, -1, 6]), (2, 2.1, 2.5, [4, 5]), (2, 2.1, 2.6, []), (2, 2.2, 4.0, [6])]
    w = spark.createDataFrame(words, "id int, start double, end double, ids array<int>")
    d = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, duration double")
    of = lambda **kw: {r.id: r.codes for r in tokens.frame_layout(w, d, ["id"], 1.0, -1, -3, in_word=-2, **kw).collect()}
    # token i of 7 in 5 frames wants frame int(5 i / 7): 0 0 1 2 2 3 4; those that are padding leave theirs free
    assert of(adaptive=True)[1] == [7, 8, 9, 5, 6]
    assert of(replace=False)[2] == [-1, -3, 4, 5, 6] and of()[2] == [-1, -3, 6, -2, -2]


def test_line_tokenizer_hands_on_few_ids_at_once():
    texts = [pd.Series(["abc", None, "d" * 10, "e"]), pd.Series(["f" * 4])]
    got = list(seams._encoded(iter(texts), lambda t: [ord(c) for c in t or ""], 5))
    assert [[len(x) for x in s] for s in got] == [[3, 0, 10], [1], [4]] and all(x.dtype == np.int64 for s in got for x in s)


def test_rules_read_a_text_from_their_first_character_on(spark):
    texts = ["🙂🙂 그러나", "x" * 50 + "\n합니다\n합니다", "a ~하시겠습니까 b 합니까?", "plain $ \\", " ", "", None, "x 합니다\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.when(F.trim("t") == "", F.col("t")).otherwise(T.apply_rules("t", K.SPOKEN_RULES))
    hits = sum((F.when(F.regexp_like("t", F.lit(p)), 1).otherwise(0) for p, _ in K.SPOKEN_RULES), F.lit(0))
    out = df.select(T.spoken("t").alias("a"), whole.alias("b"), F.round(T.rule_confidence("t", K.SPOKEN_RULES), 6).alias("c"), F.round(F.least(F.lit(0.7) + 0.05 * hits, F.lit(0.9)), 6).alias("d"))
    assert "regexp_extract" in plan(out)
    for r in out.collect():
        assert r.a == r.b and r.c == r.d
    assert df.limit(1).select(T.rule_confidence("t", [("(x)?🙂", "y")]).alias("c")).first().c == 0.75
