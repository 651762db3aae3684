"""Signal distances against plain forms and hand values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.operators import audio, metrics


def plain_warp(a, b, band):
    """Every cell of the table, one by one."""
    n, m = len(a), len(b)
    band = max(band, abs(n - m))
    d = {(-1, -1): 0.0}
    for i in range(n):
        for j in range(m):
            if abs(i - j) <= band:
                c = math.dist(a[i], b[j])
                d[i, j] = min(d.get((i - 1, j), math.inf) + c, d.get((i, j - 1), math.inf) + c, d.get((i - 1, j - 1), math.inf) + 2 * c)
    return d[n - 1, m - 1] / (n + m)


@pytest.mark.parametrize("n,m,band", [(1, 1, 0), (1, 7, 0), (7, 1, 3), (12, 12, 0), (12, 12, 3), (12, 12, 50), (20, 14, 2), (9, 30, 4)])
def test_warping_against_the_whole_table(n, m, band):
    r = np.random.default_rng(n * 100 + m)
    a, b = r.normal(size=(n, 3)), r.normal(size=(m, 3))
    assert audio.warped(a, b, band) == pytest.approx(plain_warp(a, b, band), abs=1e-12)


def test_warping_by_hand():
    a = np.array([[0.0], [1.0], [2.0]])
    assert audio.warped(a, a, 0) == 0
    assert audio.warped(a, a + 3, 0) == 3  # frame by frame the mean distance
    assert audio.warped(a, np.repeat(a, 2, axis=0), 0) == 0  # half the speed
    assert audio.warped(a, a[:0], 0) is None


def test_cepstra_of_tones():
    rate = 16_000
    t = np.arange(rate) / rate
    tone, other = np.sin(2 * np.pi * 440 * t), np.sin(2 * np.pi * 1760 * t)
    bank = audio.mel_bank(rate, 2048, 40)
    window = np.hanning(2048)
    power = audio._banded(tone, window, 512, 2048, bank)
    at = np.arange(1025) * rate / 2048
    centre = (bank * at).sum(axis=1) / bank.sum(axis=1)
    assert abs(centre[power.mean(axis=0).argmax()] - 440) < 70
    x, y = audio.mel_cepstra(tone, rate), audio.mel_cepstra(other, rate)
    assert x.shape == (1 + rate // 512, 13)
    # louder by 20 dB: only the first coefficient moves, by 20 dB times the root of the bands
    louder = audio.mel_cepstra(10 * tone, rate)
    assert np.allclose(louder[:, 1:], x[:, 1:], atol=1e-6) and np.allclose(louder[:, 0] - x[:, 0], 20 * math.sqrt(128))
    assert audio.warped(x[:, 1:], y[:, 1:], 0) > 10


def test_spectra_do_not_depend_on_blocks(monkeypatch):
    x = np.random.default_rng(1).normal(size=20_000)
    whole = audio.mel_cepstra(x, 16_000)
    monkeypatch.setattr(audio, "BLOCK", 3)
    assert np.allclose(audio.mel_cepstra(x, 16_000), whole)


def test_intelligibility():
    r = np.random.default_rng(5)
    x = r.normal(size=12_000) * (1 + np.sin(np.arange(12_000) / 700))
    assert audio.intelligible(x, x) == pytest.approx(1, abs=1e-9)
    assert audio.intelligible(x, 0.01 * x) == pytest.approx(1, abs=1e-6)  # loudness doesn't count
    noise = r.normal(size=12_000)
    scores = [audio.intelligible(x, x + k * noise) for k in (0.1, 0.5, 2, 8)]
    assert scores == sorted(scores, reverse=True) and scores[0] > 0.95 and scores[-1] < 0.6
    gap = np.concatenate([x[:6000], np.zeros(8000), x[6000:]])  # a pause is left out
    assert audio.intelligible(gap, np.concatenate([x[:6000], noise[:8000], x[6000:]])) > 0.97
    assert audio.intelligible(x[:2000], x[:2000]) is None and audio.intelligible(x[:10], x) is None
    assert audio.intelligible(np.zeros(9000), x) is None


def test_third_octaves_tile_the_range():
    bank = audio.third_octaves()
    assert bank.shape == (15, 257) and bank.sum(axis=0).max() == 1
    used = np.flatnonzero(bank.sum(axis=0))
    assert (np.diff(used) == 1).all() and used[0] == round(150 / 2 ** (1 / 6) * 512 / 10_000)


def test_columns_on_odd_rows(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=12_000)
    rows = [(1, x.tolist(), x.tolist()), (2, None, [1.0]), (3, [], [1.0]), (4, [1.0], []), (5, [0.5], [0.25]), (6, x.tolist(), x[:9000].tolist())]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
    got = {w.id: w for w in df.select("id", audio.cepstral_distortion("a", "b", 24_000).alias("m"), audio.cepstral_distortion("a", "b", 24_000, 4).alias("w"), audio.intelligibility("a", "b", 24_000).alias("s")).collect()}
    assert got[1].m == 0 and got[1].w == 0 and got[1].s == pytest.approx(1)
    assert all(v is None for k in (2, 3, 4) for v in got[k][1:])
    assert got[5].m >= 0 and got[5].s is None
    assert got[6].w >= 0 and got[6].s is None  # below 30 frames at 10 kHz
    f = spark.createDataFrame([(1, [[0.0, 1.0]], [[9.0, 1.0]]), (2, [], [[1.0, 2.0]]), (3, None, [[1.0, 2.0]])], "id int, a array<array<double>>, b array<array<double>>")
    assert [w.d for w in f.orderBy("id").select(audio.cepstral_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [0, None, None]


def test_corpus_bleu_counts_where_grams_are_made(spark):
    rows = [(1, "a b c d e".split(), "a b c d e".split()), (2, "x x y".split(), "x x x".split()), (3, [], [])]
    df = spark.createDataFrame(rows, "id int, ref array<string>, hyp array<string>")
    out = metrics.corpus_bleu(df)
    got = out.first()
    assert got.bleu1 == pytest.approx(7 / 8, abs=1e-6) and got.bleu2 == pytest.approx(math.sqrt(7 / 8 * 5 / 6), abs=1e-6) and got.brevity == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("gram" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line)
    assert metrics.corpus_bleu(df.filter("id = 3")).first().bleu1 is None
