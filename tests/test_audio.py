import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import audio as A
from paceline.operators import series as S

RATE = 8000


def recording(tones, seconds=5.0, noise=0.002, seed=1):
    x = np.random.default_rng(seed).normal(0, noise, int(seconds * RATE))
    for start, hz in tones:
        i = np.arange(int(0.15 * RATE))
        x[int(start * RATE):int(start * RATE) + len(i)] += 0.4 * np.sin(2 * np.pi * hz * i / RATE)
    return x


def chunks(spark, x, step=8000):
    rows = [(1, 0, k / RATE, [float(v) for v in x[k:k + step + 80]]) for k in range(0, len(x), step)]
    return spark.createDataFrame(rows, "recording_id long, channel int, chunk_start_s double, samples array<double>")


def tones_of(spark, x):
    f = A.frame_features(chunks(spark, x)).withColumnRenamed("recording_id", "attempt_id")
    f = S.loudness_thresholds(f, ["attempt_id"])
    return A.usable_tones(A.merge_tones(A.tone_segments(f)))


def test_chunks_cover_every_frame_once(spark):
    x = recording([])
    t = [round(r.t * 100) for r in A.frame_features(chunks(spark, x)).select("t").collect()]
    assert len(t) == len(set(t)) == (len(x) - 160) // 80 + 1


def test_frame_frequency(spark):
    f = A.frame_features(chunks(spark, recording([(1.0, 554), (2.0, 1108)]))).where("tonality > 0.9 and prominence_db > 20").collect()
    near = lambda hz: [r for r in f if abs(r.frequency - hz) < 15]
    assert near(554) and near(1108)


def test_three_tone_pattern(spark):
    seg = tones_of(spark, recording([(0.5, 554), (1.5, 554), (2.5, 554), (3.5, 1108)]))
    p = A.tone_patterns(seg).first()
    assert p.official and p.strong and p.c_start_s == pytest.approx(3.5, abs=0.03)


def test_noise_has_no_pattern(spark):
    for seed in range(3):
        assert A.tone_patterns(tones_of(spark, recording([], seed=seed))).count() == 0


def test_same_pitch_is_no_start(spark):
    assert A.tone_patterns(tones_of(spark, recording([(0.5, 554), (1.5, 554), (2.5, 554)]))).count() == 0
