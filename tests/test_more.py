"""Manifest, window, audio, tokenizer, path and signal operators on hand-made rows."""

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from turnwise.operators import arrays, manifest, segments, statistics, tokens, windows
from turnwise.sources import cuts, sinks, tables


def test_own_lines(spark):
    lines = spark.range(10).withColumnRenamed("id", "line")
    got = [[r.line for r in manifest.own_lines(lines, "line", 3, k).orderBy("line").collect()] for k in range(3)]
    assert got == [[0, 3, 6, 9], [1, 4, 7], [2, 5, 8]]


def test_windows_of_one_reader(spark):
    convs = spark.createDataFrame([(1, 7_500)], "conv_id long, duration_ms long")
    assert [r.window for r in windows.tumbling(convs, 1000, skip=1, step=3).orderBy("window").collect()] == [1, 4, 7]
    assert spark.range(1).select(arrays.pad_window(F.array(F.lit(1.0)), 3).alias("a")).first().a == [1.0, 0.0, 0.0]


def test_unify(spark):
    a = spark.createDataFrame([(0, "b", 3.0), (1, "a", 1.0)], "line long, id string, duration double")
    b = spark.createDataFrame([(0, "c", 2.0)], "line long, id string, duration double")
    ids = lambda df: [r.id for r in df.orderBy("n").collect()]
    assert ids(manifest.unify([b, a], ["y", "x"])) == ["c", "b", "a"]
    assert ids(manifest.unify([b, a], ["y", "x"], sort_by=["duration"])) == ["a", "c", "b"]
    mixed = manifest.unify([b, a], ["y", "x"], seed=4)
    assert sorted(ids(mixed)) == ["a", "b", "c"] and ids(mixed) == ids(manifest.unify([b, a], ["y", "x"], seed=4))


GOOD = '{"alignments": [["a", [0, 1], "S"]]}'


def test_entry_checks(spark):
    rows = [("a", "a.wav", GOOD), ("b", "b.wav", GOOD), ("c", "c.wav", None), ("d", "d.wav", "x"), ("e", "e.wav", '{"alignments": []}'), ("f", "", GOOD), ("a", "a.wav", GOOD)]
    entries = spark.createDataFrame(rows, "id string, path string, alignment string")
    files = spark.createDataFrame([(f"{c}.wav",) for c in "acde"], "path string")
    checked = manifest.training_entry_error(entries, files)
    assert {r.id: r.error for r in checked.collect()} == {"a": None, "b": "missing_audio", "c": "missing_alignment", "d": "no_json", "e": "empty_alignment", "f": "no_path"}
    report = {r.problem: (r.n, r.ids) for r in manifest.validation_report(checked).collect()}
    assert report["duplicate"] == (1, ["a"]) and report["missing_audio"] == (1, ["b"]) and len(report) == 6
    speakers = spark.createDataFrame([("a", "main"), ("a", "user"), ("b", "main")], "id string, speaker string")
    got = {r.id: r.missing for r in manifest.speaker_files_error(entries, speakers, ["main", "user"]).collect()}
    assert got["a"] == [] and got["b"] == ["user"] and got["c"] == ["main", "user"]
    smoke = {r.check: r for r in manifest.smoke_checks(entries.withColumnRenamed("path", "audio_path"), files, ["id"], 4, 5).collect()}
    assert (smoke["paths"].looked_at, smoke["paths"].failed, smoke["paths"].failed_ids) == (4, 1, ["b"])
    assert smoke["alignments"].looked_at == 5 and smoke["alignments"].failed_ids == ["c", "d"]


def test_tokenizer_compatibility(spark):
    pieces = spark.createDataFrame([(0, "<s>"), (1, "a"), (2, "<pad>")], "id int, piece string")
    r = tokens.tokenizer_errors(pieces, 3, {"<s>": 0, "<pad>": 2}).first()
    assert (r["size"], r.compatible, r.errors) == (3, True, [])
    r = tokens.tokenizer_errors(pieces, 4, {"<s>": 1, "<x>": 2}).first()
    assert not r.compatible and r.errors == ["size 3, not 4", "<s> is 0, not 1", "missing <x>"]


def test_paths_and_profiles(spark):
    row = spark.createDataFrame([(7, "x")], "shard int, name string")
    assert row.select(tables.shard_path("/r/", "audio", F.col("shard"), F.col("name"), "wav").alias("p")).first().p == "/r/audio/007/x.wav"
    v = spark.createDataFrame([("v1", "s", 5.0, 24000, None), ("v2", "s", 1.0, 24000, ["clipping"])], "voice_id string, speaker string, duration double, sample_rate int, issues array<string>")
    got = {r.voice_id: json.loads(r.document) for r in tables.voice_profile(v, "/voices").collect()}
    assert got["v1"]["is_valid"] and got["v1"]["paths"]["audio"] == "/voices/v1/reference.wav"
    assert got["v2"]["issues"] == ["clipping", "too_short"] and not got["v2"]["is_valid"]


def test_stereo(spark):
    r = spark.range(1).select(arrays.stereo(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.5), F.lit(0.5)), 2).alias("s")).first().s
    assert r.samples == [[1.0, 0.5], [0.0, 0.5], [0.0, 0.5]] and (r.duration, r.left_seconds, r.right_seconds) == (1.5, 0.5, 1.5)
    assert r.right_rms == pytest.approx(0.5)


def test_range_joins_over_slots(spark):
    """Matches across borders of slots are found, once."""
    a = spark.createDataFrame([(1, 0, 100, 900), (1, 1, 59_990, 61_000), (1, 2, 200_000, 201_000), (2, 0, 100, 900)], "conv_id long, pos long, start_ms long, end_ms long")
    b = spark.createDataFrame([(1, 0, 60_010, 60_500), (1, 1, 150_000, 260_000), (1, 2, 99, 5_000)], "conv_id long, pos long, start_ms long, end_ms long")
    got = [(r.conv_id, r.pos) for r in segments.boundary_matches(a, b, 20).orderBy("conv_id", "pos").collect()]
    assert got == [(1, 0), (1, 1), (1, 2)]
    d = b.selectExpr("conv_id", "pos", "start_ms", "end_ms", "'s' || pos AS speaker", "false AS unknown").unionByName(a.filter("conv_id = 1").selectExpr("conv_id", "pos + 10 AS pos", "start_ms - 99 AS start_ms", "end_ms + 60 AS end_ms", "'t' || pos AS speaker", "false AS unknown"))
    m = segments.tolerance_join(a, d).orderBy("conv_id", "pos").collect()
    assert [(r.level, r.matched_speaker) for r in m] == [(3, "t0"), (3, "t1"), (3, "t2"), (None, None)]
    s = statistics.migration_statistics(segments.tolerance_join(a, d)).first()
    assert (s.files, s.segments, s.far, s.unmatched, s.match_rate, s.update_rate) == (2, 4, 3, 1, 75.0, 75.0)
    none = statistics.migration_statistics(segments.tolerance_join(a.limit(0), d)).first()
    assert (none.match_rate, none.update_rate) == (100.0, 0.0)


def parts_of(spark, duration, cuts, words, longest=10.0):
    a = spark.createDataFrame([(1, duration, cuts, words.split())], "id long, duration double, cuts array<double>, words array<string>")
    return [(r.start, r.end, " ".join(r.words)) for r in segments.split_long(a, ["id"], longest).orderBy("k").collect()]


def test_long_audio(spark):
    ten = "a b c d e f g h i j"
    assert parts_of(spark, 10.0, [5.0], ten) == [(0.0, 10.0, ten)]
    # 9 is the first cut eight seconds on, 16 is too near, 17 isn't
    assert parts_of(spark, 20.0, [2.0, 9.0, 16.0, 17.0], ten) == [(0.0, 9.0, "a b c d"), (9.0, 17.0, "d e f g"), (17.0, 20.0, "g")]
    # the last part of 21 seconds is dealt into three
    assert [p[:2] for p in parts_of(spark, 30.0, [9.0], ten)] == [(0.0, 9.0), (9.0, 16.0), (16.0, 23.0), (23.0, 30.0)]
    for cuts_ in ([], None):
        assert parts_of(spark, 30.0, cuts_, ten) == [(0.0, 10.0, "a b c"), (10.0, 20.0, "d e f"), (20.0, 30.0, "g h i j")]
    assert parts_of(spark, 30.0, [], "a") == [(0.0, 10.0, "a")]
    assert parts_of(spark, 30.0, [], "") == [(0.0, 30.0, "")]


def test_extended_documents(spark):
    words = spark.createDataFrame(
        [(1, 0, "hi", 0.0, 0.5, 0.91234, "main", "s1", 0, 0), (1, 1, 'a"b', 0.5, 1.0, 0.8, "user", None, 1, 1), (1, 2, "yo", 0.25, 0.75, 0.7, "main", "s1", 0, 2)],
        "conv_id long, k int, word string, start double, end double, confidence double, role string, original string, channel int, segment int",
    )
    got = json.loads(sinks.extended_documents(words, spark.createDataFrame([(1, 0.98765)], "conv_id long, quality double")).first().document)
    assert (got["conversation_id"], got["format_version"]) == (1, "2.0")
    m = got["metadata"]
    assert (m["total_words"], m["main_speaker_words"], m["user_speaker_words"], m["quality_score"], m["unique_original_speakers"]) == (3, 2, 1, 0.988, ["s1"])
    assert m["speaker_statistics"]["s1"] == {"word_count": 2, "total_duration": 1.0, "role": "main", "channel": 0} and list(m["speaker_statistics"]) == ["s1", "user"]
    assert [w["word"] for w in got["alignments"]] == ["hi", "yo", 'a"b'] and got["alignments"][0]["confidence"] == 0.912
    assert got["basic"] == [["hi", [0.0, 0.5], "main"], ["yo", [0.25, 0.75], "main"], ['a"b', [0.5, 1.0], "user"]]


def test_wanted_members(spark, tmp_path):
    for shard in (1, 2):
        with tarfile.open(tmp_path / f"recording.{shard:06d}.tar", "w") as tar:
            for name in ("a.wav", "b.wav", "c.txt"):
                info = tarfile.TarInfo(name)
                info.size = 1
                tar.addfile(info, io.BytesIO(b"x"))
    wanted = spark.createDataFrame([(1, "b"), (1, "c"), (3, "a")], "shard int, cut_id string")
    assert [(r.shard, r.cut_id) for r in cuts.tar_members(spark, str(tmp_path), wanted=wanted).collect()] == [(1, "b")]


def test_corrupt_shard(spark, tmp_path):
    line = json.dumps({"id": "x", "duration": 1.0}) + "\n"
    (tmp_path / "cuts.000001.jsonl.gz").write_bytes(gzip.compress(line.encode()))
    (tmp_path / "cuts.000002.jsonl.gz").write_bytes(b"no gzip at all")
    assert [r.shard for r in cuts.read_cuts(spark, str(tmp_path), whole=True).collect()] == [1]
    with pytest.raises(Exception, match="(?i)gzip|FAILED_READ_FILE"):
        cuts.read_cuts(spark, str(tmp_path)).collect()


def test_token_classes(spark):
    want = {"<0x0A>": "byte", "a": "byte", "Ġ": "byte", "Ń": "byte", "ń": "plain", "<s>": "special", "Ġthe": "space", "the": "plain"}
    rows = spark.createDataFrame([(k,) for k in want], "token string")
    assert {r[0]: r[1] for r in rows.select("token", tokens.token_class()).collect()} == want


def test_vocabulary(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 2, "aba": 3}, "merges": ["a b", ["ab", "a"]]}}))
    pieces, merges = tables.vocabulary(spark, str(tmp_path / "t.json"))
    assert {r.token: r.score for r in tokens.merge_scores(pieces.withColumnRenamed("piece", "token"), merges).collect()} == {"a": 0.0, "b": 0.0, "ab": -2.0, "aba": -1.0}
    assert [r.piece for r in tokens.vocabulary_ends(pieces, 1, 1).orderBy("id").collect()] == ["a", "aba"]
    text = spark.range(1).select(tokens.decode(F.array(*map(F.lit, (2, -1, 0, 9, 3))), F.create_map(*(F.lit(x) for x in (0, "a", 2, "ab", 3, "pad"))), [3]))
    assert text.first()[0] in ("aba", "ab" + "a")


def test_metadata_folders(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.json").write_text("{}")
    (tmp_path / "x" / "report.json").write_text("{}")
    found = tables.metadata_documents(spark, str(tmp_path / "gone"), str(tmp_path / "x")).collect()
    assert [r.path.rsplit("/", 1)[-1] for r in found] == ["one.json"]
    assert tables.metadata_documents(spark, str(tmp_path / "gone")).count() == 0
