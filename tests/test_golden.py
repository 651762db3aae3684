"""Hand-derived values of single operators."""

import pytest
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.operators import arrays, filters, manifest, metrics, segments, speakers, tokens


def utts(spark, rows):
    data = [(1, s, a, b, b - a, f"t{i}", i) for i, (s, a, b) in enumerate(rows)]
    return spark.createDataFrame(data, "conv_id long, speaker string, start_ms long, end_ms long, dur_ms long, text string, pos long")


def test_hybrid_score(spark):
    t = spark.createDataFrame([(1, "A", 6000, 1, 0), (1, "B", 4000, 3, 1)], "conv_id long, speaker string, total_ms long, turns long, first_pos long")
    got = {r.speaker: (round(r.score, 6), r.role) for r in speakers.rank_speakers(speakers.hybrid_scores(t)).collect()}
    assert got == {"A": (0.46, "user"), "B": (0.54, "main")}


def test_rank_tie_keeps_first(spark):
    got = speakers.assign_roles(utts(spark, [("A", 0, 1000), ("B", 1000, 2000)])).filter("rank = 1").first()
    assert got.speaker == "A"


def test_overlaps_counted_by_pair(spark):
    r = speakers.overlap_summary(speakers.overlap_pairs(utts(spark, [("A", 0, 5000), ("B", 3000, 6000), ("A", 5500, 7000)]))).first()
    assert (r.overlap_ms, r.n_overlaps) == (2500, 2)


def test_merge_gap_is_inclusive(spark):
    rows = segments.merge_adjacent(utts(spark, [("A", 0, 1000), ("A", 1500, 2000), ("A", 2600, 3000), ("B", 3000, 4000)])).orderBy("island").collect()
    assert [(r.speaker, r.start_ms, r.end_ms) for r in rows] == [("A", 0, 2000), ("A", 2600, 3000), ("B", 3000, 4000)]


def test_merge_takes_last_end(spark):
    r = segments.merge_adjacent(utts(spark, [("A", 0, 5000), ("A", 1000, 2000)])).first()
    assert (r.start_ms, r.end_ms) == (0, 2000)


def test_next_response_is_strictly_later(spark):
    a, b = utts(spark, [("u", 0, 5000)]), utts(spark, [("m", 5000, 8000), ("m", 9000, 10000)])
    assert segments.next_response(a, b).first().latency_ms == 4000


def test_next_fit(spark):
    rows = spark.createDataFrame([("g", float(x)) for x in (100, 200, 300, 400)], "g string, d double")
    got = [r.batch for r in manifest.next_fit(rows, "g", "d", ["d"], 600, 32).orderBy("d").collect()]
    assert got == [0, 0, 0, 1]


@pytest.mark.parametrize(("ref", "hyp", "want"), [("a b c", "a x c d", (1, 0, 1, 2 / 3)), ("", "a", (0, 0, 1, 1.0)), ("", "", (0, 0, 0, 0.0))])
def test_word_errors(spark, ref, hyp, want):
    p = spark.createDataFrame([(1, ref, hyp)], "id long, r string, h string").select("id", T.word_array("r").alias("ref"), T.word_array("h").alias("hyp"))
    r = tokens.wer_counts(p).first()
    assert (r.substitutions, r.deletions, r.insertions) == want[:3] and r.wer == pytest.approx(want[3])
    assert p.select(T.word_error_rate(F.col("ref"), F.col("hyp"))).first()[0] == pytest.approx(want[3])


def laid_out(spark, said, duration, rate, **options):
    words = spark.createDataFrame([(1, float(s), float(e), ids) for ids, s, e in said], "id long, start double, end double, ids array<int>")
    return tokens.frame_layout(words, spark.createDataFrame([(1, float(duration))], "id long, duration double"), ["id"], rate, **options).first().codes


def test_frame_layout(spark):
    assert laid_out(spark, [([7, 8], 1, 4)], 6, 1, pad=9, end_of_text=0, in_word=5) == [0, 7, 8, 5, 5, 9]
    assert laid_out(spark, [], 2, 1, pad=9, end_of_text=0, zero=3) == [3, 3]
    assert laid_out(spark, [([7], 1, 1)], 4, 1, pad=9, end_of_text=0, in_word=5, zero=3, delay=-2) == [3, 3, 9, 9]
    assert laid_out(spark, [([], 1, 2), ([7], 3, 3)], 4, 1, pad=9, end_of_text=0, in_word=5) == [9, 5, 0, 7]
    assert laid_out(spark, [([1, 2], 0, 1), ([3], 1, 1)], 4, 1, pad=9, end_of_text=0, replace=False) == [1, 2, 3, 9]
    assert laid_out(spark, [([1, 2], 9, 9)], 3, 1, pad=9, end_of_text=0, zero=3) == [9, 9, 9]  # it starts behind the end
    assert laid_out(spark, [([1], 1, 3), ([2], 1.5, 1.5)], 4, 1, pad=9, end_of_text=0, in_word=5) == [0, 2, 9, 9]  # the last of two in a frame
    assert laid_out(spark, [([1], 0, 0)], 0, 1, pad=9, end_of_text=0) == []


def test_crowded_frames(spark):
    three = [([1, 2], 0, 0.5), ([4, 5], 1, 1.5)]
    assert laid_out(spark, three, 2, 1, pad=9, end_of_text=0, adaptive=True) == [1, 2]  # the others find no free frame
    assert laid_out(spark, three, 10, 1, pad=9, end_of_text=0, adaptive=True) == laid_out(spark, three, 10, 1, pad=9, end_of_text=0)
    assert laid_out(spark, [([9, 9, 9, 7], 0, 1)], 3, 1, pad=9, end_of_text=0, adaptive=True) == [0, 0, 7]  # padding takes no frame


def test_ordered_rules(spark):
    df = spark.createDataFrame([("확인하겠습니다",), ("가능합니다",)], "t string")
    rules = [("습니다$", "어요"), ("하겠습니다$", "할게요"), ("합니다$", "해요")]
    assert [r[0] for r in df.select(T.apply_rules("t", rules)).collect()] == ["확인하겠어요", "가능해요"]


def test_spoken_korean(spark):
    df = spark.createDataFrame([("그것은 가능합니다",), ("확인하겠습니다",), (" ",)], "t string")
    assert [r[0] for r in df.select(T.spoken("t")).collect()] == ["그건 가능해요", "확인하겠어요", " "]
    one = T.code_switch("t", {"서버": "server"}, 1.0, 0, "t")
    assert spark.createDataFrame([("서버 서버",)], "t string").select(one).first()[0] == "server 서버"


def test_unknown_speakers(spark):
    rows = spark.createDataFrame([(x,) for x in (None, " Unknown ", "?", "N/A", "ann")], "speaker string")
    assert [r[0] for r in rows.select(filters.is_unknown()).collect()] == [True, True, True, True, False]


def test_case_table(spark):
    df = spark.createDataFrame([(a, t, u) for a in (0, 1) for t in (0, 1) for u in (0, 1)], "a int, t int, u int")
    got = {(r.a, r.t, r.u): r.c for r in df.withColumn("c", filters.case_number(F.col("a") == 1, F.col("t") == 1, F.col("u") == 1)).collect()}
    assert got[0, 1, 1] == 4 and got[1, 0, 1] == 5 and got[0, 0, 1] == 3 and got[0, 1, 0] == 0
    assert got[1, 1, 1] == 1 and got[1, 1, 0] == 2 and got[1, 0, 0] == 5 and got[0, 0, 0] == 0


def test_spans(spark):
    r = spark.range(1).select(arrays.span_bounds(F.lit(100), 3, 12.5, "end").alias("s")).first().s
    assert (r.start, r.end) == (63, 100)


def test_perplexity(spark):
    assert spark.range(1).select(metrics.perplexity(F.lit(3.0))).first()[0] == 8


def test_alignment_errors(spark):
    docs = ['{"alignments": [["a", [0, 1], "S"]]}', '{"alignments": []}', "{}", "x", '{"alignments": [["a", [0], "S"]]}', '{"alignments": [[1, [0, 1], "S"]]}']
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(docs)], "i int, j string").orderBy("i").select(manifest.alignment_error("j")).collect()]
    assert got == [None, None, "no_key", "no_json", "times", "word"]


def test_shuffle_partitions_do_not_matter(spark, sf):
    from turnwise.plans.queries import QUERIES

    rows = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(str, QUERIES["filter_cascade"](spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]
