"""Sources, sinks and streams over files written by the tests."""

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from turnwise.sources import corpora, cuts, manifests, sinks
from turnwise.streaming import streams


def test_cuts(spark, tmp_path):
    lines = [
        {"id": "c1", "duration": 9.0, "recording": {"id": "r", "sampling_rate": 8000}, "supervisions": [{"speaker": "B", "text": "y", "start": 2.0, "duration": 1.0}, {"speaker": "A", "text": "x", "start": 0.0, "duration": 1.5}]},
        {"id": "c2", "supervisions": []},
        {"supervisions": [{"text": "z"}]},
    ]
    for k in (0, 3):
        with gzip.open(tmp_path / f"cuts.{k:06d}.jsonl.gz", "wt") as f:
            f.write("\n".join(map(json.dumps, lines if k == 0 else [])) + "\n\n{broken\n")
    (tmp_path / "cuts.bad.jsonl.gz").write_bytes(gzip.compress(b"{}"))
    u = cuts.conversations(cuts.read_cuts(spark, str(tmp_path)))
    rows = {(r.conv_id, r.pos): (r.speaker, r.start, r.end, r.sample_rate, r.utt_id) for r in u.collect()}
    assert rows["c1", 0] == ("A", 0.0, 1.5, 8000, "c1_1") and rows["unknown", 0][0] == "unknown"
    assert {k[0] for k in rows} == {"c1", "unknown"}
    s = cuts.dataset_statistics(u).first()
    assert (s.conversations, s.utterances) == (2, 3)


def test_shards_are_read_whole_or_not_at_all(spark, tmp_path):
    line = json.dumps({"id": "c", "supervisions": [{"text": "z"}]}) + "\n"
    good = gzip.compress(("\n" + line * 3).encode())
    broken = {"cuts.000001.jsonl.gz": gzip.compress((line * 5000).encode())[:-40], "cuts.000002.jsonl.gz": gzip.compress((line + "{broken\n").encode()), "cuts.000003.jsonl": b"[1]\n"}
    for name, raw in {"cuts.000000.jsonl.gz": good, "cuts.000004.jsonl.gz": good, **broken}.items():
        (tmp_path / name).write_bytes(raw)
    rows = cuts.check_shards(cuts.cut_shards(spark, str(tmp_path))).collect()
    assert {r.shard for r in rows if r.error} == {1, 2, 3} and {r.lines for r in rows if not r.error} == {3} and len(rows) == 5
    out = cuts.read_cuts(spark, str(tmp_path), whole=True).groupBy("shard").count().collect()
    assert {(r.shard, r["count"]) for r in out} == {(0, 3), (4, 3)}
    for machine, want in ((0, {0, 4}), (1, set())):  # every second shard in order: 0, 2, 4 and 1, 3
        assert {r.shard for r in cuts.read_cuts(spark, str(tmp_path), machine, 2, whole=True).collect()} == want
    assert cuts.read_cuts(spark, str(tmp_path), 7, 8).count() == 0


def test_large_and_damaged_archives(spark, tmp_path):
    """Members are read by their range, whatever the size of the archive; damage is reported."""
    def archive(number, members):
        with tarfile.open(tmp_path / f"recording.{number:06d}.tar", "w") as tar:
            for name, data in members:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))

    data = {f"{'long/' * 40}m{k}.wav": bytes([k]) * (300_000 + k) for k in range(40)}
    archive(1, data.items())
    archive(2, [("x.wav", b"1"), ("y.flac", b"22"), ("no_suffix", b"3")])
    whole = (tmp_path / "recording.000002.tar").read_bytes()
    (tmp_path / "recording.000003.tar").write_bytes(whole[:1024] + whole[1024:1500])
    (tmp_path / "recording.000004.tar").write_bytes(b"")
    (tmp_path / "recording.000005.tar").write_bytes(whole[:512])  # the member's content is cut off, so it isn't listed
    index = cuts.archive_index(spark, str(tmp_path)).collect()
    assert {r.shard for r in index if r.error} == {3, 5} and sum(r.shard == 1 for r in index) == 40
    out = {(r.shard, r.cut_id): bytes(r.content) for r in cuts.tar_members(spark, str(tmp_path), part_bytes=1_000_000).collect()}
    assert {k[1]: v for k, v in out.items() if k[0] == 1} == {f"m{k}": bytes([k]) * (300_000 + k) for k in range(40)}
    assert out[2, "x"] == b"1" and out[2, "y"] == b"22" and out[3, "x"] == b"1" and len(out) == 43
    wanted = spark.createDataFrame([(1, "m7"), (1, "m7"), (2, "m8"), (2, "y"), (None, "x")], "shard int, cut_id string")
    found = cuts.tar_members(spark, str(tmp_path), wanted=wanted)
    assert {(r.shard, r.cut_id) for r in found.collect()} == {(1, "m7"), (2, "y")} and found.count() == 2
    heard = cuts.audio_of(spark.createDataFrame([("m7", 1), ("zz", 2)], "id string, n int"), found)
    assert {(r.id, r.content is not None) for r in heard.collect()} == {("m7", True), ("zz", False)}


def test_runs_across_splits(spark, tmp_path):
    import random

    rng, want, lines, n = random.Random(2), [], [], 0
    for k in range(120):
        name, size = rng.choice(["a", "b", "c", ""]), rng.choice([1, 2, 3, 40])
        turns = ["" if rng.random() < 0.2 else f"turn {n + i}" for i in range(size)]
        n += size
        lines += [(name, t) for t in turns]
    runs = []
    for name, t in lines:
        if not runs or runs[-1][0] != name:
            runs.append((name, []))
        runs[-1][1].extend([t] if t else [])
    want = sorted(tuple(t) for _, t in runs if len(t) >= 2)
    (tmp_path / "e.csv").write_text("conv_id,utterance\n" + "".join(f"{a},{b}\n" for a, b in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert spark.read.csv(str(tmp_path / "e.csv")).rdd.getNumPartitions() >= 6
        by = {}
        for r in corpora.csv_runs(spark, str(tmp_path / "e.csv")).collect():
            by.setdefault(r.dialogue_id, []).append((r.pos, r.text))
        assert sorted(tuple(t for _, t in sorted(x)) for x in by.values()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "recording.000001.tar", "w") as tar:
        for name, data in (("a.wav", b"123"), ("b.txt", b"x"), ("c.FLAC", b"4")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    rows = {(r.cut_id, bytes(r.content)) for r in cuts.tar_members(spark, str(tmp_path)).collect()}
    assert rows == {("a", b"123"), ("c", b"4")}


def test_corpora(spark, tmp_path):
    (tmp_path / "d.txt").write_text("Hi. __eou__ Yo. __eou__\nalone __eou__\n")
    assert [r.text for r in corpora.end_marked(spark, str(tmp_path / "d.txt")).collect()] == ["Hi.", "Yo."]
    (tmp_path / "e.csv").write_text("conv_id,utterance\na,one\na,two\nb,x\na,three\na,four\n")
    assert corpora.csv_runs(spark, str(tmp_path / "e.csv")).groupBy("dialogue_id").count().count() == 2
    (tmp_path / "p.json").write_text(json.dumps([{"utterances": ["a", "b"]}, {"utterances": ["c"]}]))
    assert corpora.json_array(spark, str(tmp_path / "p.json")).count() == 2
    (tmp_path / "l.jsonl").write_text('{"turns": [{"speaker": "A", "text": "t"}]}\n{"x": 1}\n')
    assert corpora.load(spark, str(tmp_path / "l.jsonl"), "jsonl").count() == 1


def test_sources_spec():
    assert manifests.parse_sources("a:3,b") == {"a": 0.75, "b": 0.25}
    for bad in ("a,a", "a:0"):
        with pytest.raises(ValueError):
            manifests.parse_sources(bad)


def test_alignment_round_trip(spark):
    words = spark.createDataFrame([(1, 0, 'he"y', 0.0, 0.5, "S"), (1, 1, "b", 0.5, 1.0, "T")], "conv_id long, k int, word string, start double, end double, speaker string")
    doc = sinks.alignment_documents(words)
    assert json.loads(doc.first().document) == {"alignments": [['he"y', [0.0, 0.5], "S"], ["b", [0.5, 1.0], "T"]]}
    back = manifests.alignment_words(doc.withColumnRenamed("document", "json"))
    assert [(r.word, r.start, r.speaker) for r in back.orderBy("k").collect()] == [('he"y', 0.0, "S"), ("b", 0.5, "T")]


def test_manifest_dialects(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, "x.wav", 2.0), ("b", "p.wav", None, 3.0)], "conversation_id string, path string, audio string, duration double")
    sinks.write_manifest(rows, str(tmp_path / "m"))
    got = {r.conversation_id: r.audio_file for r in manifests.read_manifest(spark, str(tmp_path / "m")).collect()}
    assert got == {"a": "x.wav", "b": "p.wav"}


def test_wav(spark):
    import wave

    row = sinks.write_wav(spark.createDataFrame([("i", [0.0, 1.0], [0.5, -1.0])], "id string, left array<double>, right array<double>"), "out").first()
    with wave.open(io.BytesIO(bytes(row.content))) as w:
        assert (w.getnchannels(), w.getnframes(), w.getframerate()) == (2, 2, 24_000)


@pytest.fixture
def state_store(spark):
    for k, v in streams.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in streams.STATE_STORE:
        spark.conf.unset(k)


def test_stream_equals_batch(spark, sf, tmp_path, state_store):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, value double")
    late = stream.groupBy("user_id").agg(F.count("*").alias("n"))
    q = late.writeStream.outputMode("complete").format("memory").queryName("by_user").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("by_user").collect()) == sorted(events.groupBy("user_id").agg(F.count("*").alias("n")).collect())
    q = streams.streaming_ema(stream, "user_id").writeStream.outputMode("update").format("memory").queryName("ema").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("ema").select("user_id").distinct().count() == events.select("user_id").distinct().count()


def test_windows_close(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value").write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, value double")
    streams.run_available(streams.tumbling_counts(stream, "1 day", "1 hour", ["user_id"]), str(tmp_path / "out"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_moving_average_over_restarts(spark, tmp_path, state_store):
    """State goes on in a new query; a key that stays away is forgotten."""
    rows = [(k, f"2024-01-0{1 + k // 4} 00:00:0{k % 4}", "a" if k % 2 else "b", float(k)) for k in range(8)]
    want, have = {}, {}
    for day in (0, 1):
        spark.createDataFrame(rows[4 * day : 4 * day + 4], "event_id long, ts string, user string, value double").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.read_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user string, value double")
        out = streams.streaming_ema(stream, "user", 0.5)
        for k, _, user, v in rows[4 * day : 4 * day + 4]:
            want[user] = v if user not in want else 0.5 * v + 0.5 * want[user]
        q = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, _: have.update({r.user: (r.n, r.ema) for r in df.collect()})).start()
        q.awaitTermination()
        assert have == {u: (2 * (day + 1), pytest.approx(v)) for u, v in want.items()}


def test_sessions_and_first_arrivals(spark, tmp_path):
    at = [("a", "00:00"), ("a", "00:04"), ("a", "00:30"), ("b", "00:01"), ("a", "03:00"), ("b", "03:00"), ("z", "09:00")]
    rows = [(k, f"2024-01-01 {t}:00", u) for k, (u, t) in enumerate(at)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user string").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user", "1D AS value")
    for k in range(len(rows)):  # one file a row, in order
        df.filter(f"event_id = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: streams.read_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user string, value double", 1)
    streams.run_available(streams.sessions(read(), "10 minutes", "1 minute", ["user"]), str(tmp_path / "s"), str(tmp_path / "sc"))
    got = {(r.user, str(r.start)[11:16], str(r.end)[11:16], r.n) for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert {("a", "00:00", "00:14", 2), ("a", "00:30", "00:40", 1), ("b", "00:01", "00:11", 1)} <= got
    streams.run_available(streams.first_arrivals(read(), "user", "1 hour"), str(tmp_path / "f"), str(tmp_path / "fc"))
    first = [(r.user, r.event_id) for r in spark.read.parquet(str(tmp_path / "f")).collect()]
    assert {("a", 0), ("b", 3), ("z", 6)} <= set(first) and ("a", 1) not in first  # once within the watermark
    streams.run_available(streams.hopping_counts(read(), "20 minutes", "10 minutes", "1 minute", ["user"]), str(tmp_path / "h"), str(tmp_path / "hc"))
    hops = {(r.user, str(r.start)[11:16], r.n) for r in spark.read.parquet(str(tmp_path / "h")).collect()}
    assert {("a", "00:00", 2), ("a", "00:20", 1), ("a", "00:30", 1), ("b", "00:00", 1)} <= hops
