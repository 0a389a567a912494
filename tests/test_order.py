"""Equal heights and ties have one answer."""

from paceline.operators import audio as A
from paceline.operators import trajectory as T


def test_equal_heights_have_their_peak_at_the_first(spark):
    heights = [9.0, 13.354999999999999, 13.355, 13.355000000000002 - 0.18, 12.0]
    kin = spark.createDataFrame([(1, i / 10, 1.0, h, True) for i, h in enumerate(heights)], "attempt_id int, raw_time double, fit_x double, fit_y double, pose_selected boolean")
    kin = kin.selectExpr("*", "fit_x AS wall_x", "fit_y AS wall_y")
    limits = spark.createDataFrame([(1, 10.0)], "attempt_id int, hard_limit_s double")
    d = T.terminal_descent(T.progress_samples(kin, limits)).first()
    assert (d.peak_s, d.plateau_s, d.descent_samples) == (0.1, 0.1, 4)


def test_a_tie_of_the_middle_tone_goes_to_the_earlier(spark):
    tone = lambda t, f: (1, t, 0.1, f, 0.9, 40.0, 8, 5.0)
    seen = []
    for middle in ((1.9375, 2.0625), (2.0625, 1.9375)):
        rows = [tone(1.0, 880.0), *[tone(t, 880.0) for t in middle], tone(3.0, 1760.0)]
        tones = spark.createDataFrame(rows, "attempt_id int, start_s double, duration_s double, frequency double, tonality double, prominence_db double, qualified int, stability_cents double").coalesce(1)
        seen.append(A.secondary_review(tones).first().b_start_s)
    assert seen == [1.9375, 1.9375]
