"""Sequential queries, which have no SQL, against plain Python over whole tables."""

import math
import random
import re
from collections import Counter

import pytest

from turnwise.functions import text as T
from turnwise.operators import manifest, metrics, tokens
from turnwise.plans import queries as Q
from turnwise.plans.views import utterances, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_errors(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    text = {(r.conv_id, r.turn): re.sub(" +", " ", re.sub("[^a-z0-9 ]", "", r.text.lower())).split() for r in turns.collect()}
    want = {c * 1000 + t: (text[c, t], text[c, t + 1]) for c, t in text if (c, t + 1) in text}
    far = {k: distance(*p) for k, p in want.items()}
    rate = {k: round(far[k] / len(r) if r else float(bool(h)), 6) for k, (r, h) in want.items()}
    assert {r.id: r.wer for r in Q.QUERIES["word_errors"](spark, sf).collect()} == rate
    kinds = {r.id: r for r in Q.QUERIES["word_error_kinds"](spark, sf).collect()}
    assert {k: round(r.wer, 6) for k, r in kinds.items()} == rate
    for k, (r, h) in want.items():  # counts explain the distance and both lengths
        x = kinds[k]
        assert x.substitutions + x.deletions + x.insertions == far[k] and len(r) - x.deletions + x.insertions == len(h)


def test_edit_table_of_long_texts():
    a = [str(i * i % 97) for i in range(3000)]
    b = a[:100] + ["new"] * 7 + a[105:2000] + a[2003:]
    s, d, i, rate = tokens._edits(a, b)
    assert (s, d, i) == (5, 3, 2) and rate == pytest.approx(10 / 3000)
    for x, y in (("kitten", "sitting"), ("", "ab"), ("ab", ""), ("abc", "abc"), ("flaw", "lawn")):
        assert list(T.edit_rows(list(x), list(y)))[-1][-1] == distance(x, y)


def fold(said, duration, rate, pad, end_of_text, in_word, zero, replace=True):
    """Frame by frame, as the rule is written."""
    frames = math.ceil(duration * rate)
    if not said:
        return [zero] * frames
    out, queue, last, left = [], [], -1, sorted(said, key=lambda w: w[1])
    for t in range(frames):
        for w in [w for w in left if w[1] * rate < t + 1]:
            queue, last = ([] if replace else queue) + list(w[0]), int(w[2] * rate)
            left.remove(w)
        if queue:
            if out and out[-1] in (pad, in_word):
                out[-1] = end_of_text
            out.append(queue.pop(0))
        else:
            out.append(in_word if t <= last else pad)
    return out


def test_token_frames(spark, sf):
    said = {}
    for r in words(utterances(spark, sf)).collect():
        ids = [ord(r.word[0]) + i for i in range(int(min(len(r.word) / 3, 3)) + 1)]
        said.setdefault(r.conv_id, []).append((ids, r.w_start_ms / 1000, r.w_end_ms / 1000))
    got = {r.conv_id: (r.duration, [int(x) for x in r.codes.split(",")]) for r in Q.QUERIES["token_frames"](spark, sf).collect()}
    assert got.keys() == said.keys()
    for c, w in said.items():
        end = max(e for _, _, e in w)
        assert got[c] == (end, fold(sorted(w, key=lambda x: (x[1], x[2], x[0])), end, 12.5, 3, 0, 4, 5))


def test_queued_frames(spark):
    """Random words, with a queue and without, frame by frame."""
    rng = random.Random(8)
    said = {c: [([rng.randint(1, 9) for _ in range(rng.randint(0, 4))], x := round(rng.uniform(0, 12), 2), x + rng.random()) for _ in range(rng.randint(0, 15))] for c in range(30)}
    rows = spark.createDataFrame([(c, s, e, ids) for c, w in said.items() for ids, s, e in w], "id long, start double, end double, ids array<int>")
    for replace in (False, True):
        out = tokens.frame_layout(rows, spark.createDataFrame([(c, 10.0) for c in said], "id long, duration double"), ["id"], 2.5, 30, 40, 20, replace, 50)
        for r in out.collect():
            assert list(r.codes) == fold(sorted(said[r.id], key=lambda x: (x[1], x[2], x[0])), 10.0, 2.5, 30, 40, 20, 50, replace), (r.id, replace)


def test_greedy_matches(spark, sf):
    rows = utterances(spark, sf).select("conv_id", "pos", "speaker", "start_ms", "end_ms").orderBy("start_ms", "pos").collect()
    want = set()
    for c in {r.conv_id for r in rows}:
        free = {r.pos: (r.start_ms + r.end_ms) / 2 for r in rows if r.conv_id == c and r.speaker == "user"}
        for r in (r for r in rows if r.conv_id == c and r.speaker == "assistant"):
            near = min(((abs((r.start_ms + r.end_ms) / 2 - m), k) for k, m in free.items()), default=(math.inf, None))
            if near[0] <= 20_000:
                del free[near[1]]
                want.add((c, r.pos, near[1], near[0]))
    got = {(r.conv_id, r.pos, r.matched_pos, r.distance_ms) for r in Q.QUERIES["greedy_matches"](spark, sf).collect()}
    assert want and got == want


def test_next_fit_batches(spark, sf):
    by = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id", "n_chars").collect():
        by.setdefault(r.source, []).append((r.n_chars, r.doc_id))
    want = {}
    for items in by.values():
        batch, load, size = 0, 0, 0
        for n, doc in sorted(items):
            if size and (load + n > 20_000 or size >= 32):
                batch, load, size = batch + 1, 0, 0
            want[doc], load, size = batch, load + n, size + 1
    assert {r.doc_id: r.batch for r in Q.QUERIES["next_fit_batches"](spark, sf).collect()} == want


@pytest.mark.parametrize("most, capacity", [(1, 50), (3, 20), (5, 1000), (7, 30)])
def test_next_fit_of_any_groups(spark, most, capacity):
    """One group with most of the rows, single rows, a null group, sizes above the capacity, null sizes."""
    rng = random.Random(most)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), k, rng.choice([None, 0.0, 1.0, 4.0, 9.0, 60.0])) for k in range(400)] + [("zz", 400, 1.0)]
    want, by = {}, {}
    for g, k, n in rows:
        by.setdefault(g, []).append((k, n or 0.0))
    for items in by.values():
        batch, load, size = 0, 0.0, 0
        for k, n in items:
            if size and (load + n > capacity or size >= most):
                batch, load, size = batch + 1, 0.0, 0
            want[k], load, size = batch, load + n, size + 1
    df = spark.createDataFrame(rows, "g string, k long, n double").repartition(3)
    assert {r.k: r.batch for r in manifest.next_fit(df, "g", "n", ["k"], capacity, most).collect()} == want
    assert manifest.next_fit(df.limit(0), "g", "n", ["k"], capacity, most).count() == 0


def test_queries_tell_rows_apart(spark, sf):
    n = utterances(spark, sf).filter("speaker = 'assistant'").count()
    assert 0 < Q.QUERIES["boundary_matches"](spark, sf).count() < n
    assert Q.QUERIES["migration_statistics"](spark, sf).first().updated > 0


def test_sentence_bleu(spark):
    pairs = [("the cat sat on the mat", "the cat sat on the mat"), ("the cat sat on the mat today", "the cat on the mat"), ("a b", "c d"), ("a b c", "a x"), ("", "a"), ("a", "")]
    df = spark.createDataFrame([(i, r.split(), h.split()) for i, (r, h) in enumerate(pairs)], "id long, ref array<string>, hyp array<string>")
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for row in metrics.sentence_bleu(df).collect():
        r, h = (x.split() for x in pairs[row.id])
        logs, half = [], 1.0
        for n in range(1, min(4, len(h)) + 1):
            hit, every = (grams(r, n) & grams(h, n)).total(), len(h) - n + 1
            half = half / 2 if not hit else half
            logs.append(math.log(hit / every if hit else half / every))
        want = 0.0 if not set(r) & set(h) else 100 * min(1, math.exp(1 - len(r) / len(h))) * math.exp(sum(logs) / len(logs))
        assert row.bleu == pytest.approx(want, abs=1e-9)
