"""Truth tables of the scalar functions."""

import random

import pytest
from pyspark.sql import functions as F

from streamloom.functions import scalar as S
from streamloom.params import Params


def values(spark, rows, ddl, *exprs):
    out = spark.createDataFrame(rows, ddl).select(*exprs).collect()
    return [r[0] if len(exprs) == 1 else tuple(r) for r in out]


def test_rounding_is_that_of_the_exact_value(spark):
    rng = random.Random(2)
    xs = [x for _ in range(5000) for x in (rng.randrange(40_000) / 1000, rng.uniform(-50, 50), rng.randrange(10**6) / 1000 - rng.randrange(10**6) / 1000)]
    xs += [9.925, 5.105, 12.5, 0.25, -0.5, 0.0, 2.5, -2.675]
    for digits in (0, 1, 2, 3, 6):
        assert values(spark, [(x,) for x in xs], "x double", S.rounded(F.col("x"), digits)) == [float(round(x, digits)) for x in xs]


def test_times(spark):
    rows = [(0.0,), (59.999,), (3600.0,), (360000.5,), (-1.0,)]
    assert values(spark, rows[:4], "x double", S.fmt_ts(F.col("x"))) == ["00:00:00", "00:00:59", "01:00:00", "100:00:00"]
    assert values(spark, rows, "x double", S.fmt_srt(F.col("x"))) == ["00:00:00,000", "00:00:59,999", "01:00:00,000", "100:00:00,500", "00:00:00,000"]
    assert values(spark, [(12.5,), (59.4,), (60.0,), (185.0,), (3720.0,)], "x double", S.fmt_duration(F.col("x"))) == ["12s", "59s", "1m", "3m05s", "1h02m"]
    assert values(spark, [(5.0,), (3605.0,)], "x double", S.youtube_time(F.col("x"))) == ["00:05", "01:00:05"]


def test_offsets(spark):
    rows = [("2024-01-01T00:00:10Z",), ("2024-01-01T00:00:09.5+00:00",), ("",), ("junk",), (None,)]
    start = F.lit(1704067200000000)
    assert values(spark, rows, "x string", S.offset_sec(S.published_us(F.col("x")), start)) == [10.0, 9.5, 0.0, 0.0, 0.0]


def test_edit_ratio_counts_code_points(spark):
    rows = [("", "", 0.0), (None, None, 0.0), ("a", "", 1.0), ("何処", "伺処", 0.5), ("kitten", "sitting", 3 / 7)]
    assert values(spark, [r[:2] for r in rows], "a string, b string", S.edit_ratio(F.col("a"), F.col("b"))) == pytest.approx([r[2] for r in rows])


def test_overlap(spark):
    rows = [(0.0, 4.0, 2.0, 8.0), (0.0, 1.0, 1.0, 2.0), (0.0, 0.0, 0.0, 5.0), (0.0, 10.0, 2.0, 4.0)]
    assert values(spark, rows, "a double, b double, c double, d double", S.overlap_ratio(*(F.col(c) for c in "abcd"))) == [0.5, 0.0, 0.0, 1.0]


def test_text_marks(spark):
    rows = [("ＷＷ",), ("草だ",), ("HHH",), ("w",), (None,)]
    assert values(spark, rows, "x string", S.laughter(F.col("x"))) == [True, True, True, False, False]
    assert values(spark, [("a.c",), ("abc",)], "x string", S.contains_any(F.col("x"), (".",))) == [True, False]
    assert values(spark, [("　 x y　\n",), ("　",)], "x string", S.strip(F.col("x"))) == ["x y", ""]
    assert values(spark, [("abcdef",), ("abc",)], "x string", S.preview(F.col("x"), 3)) == ["abc...", "abc"]


def test_speaker_and_confidence(spark):
    rows = [("zh", 1.0, 0.5), ("zh", 3.0, 0.5), ("zh", 1.0, 0.1), ("ja", 1.0, 0.1), ("en", 9.0, 0.0), (None, 9.0, 0.0)]
    p = Params()
    got = values(spark, rows, "l string, d double, n double", S.speaker(F.col("l"), F.col("d"), F.col("n"), p.language_confidence, p.short_sec))
    assert got == ["unknown", "streamer", "streamer", "game_voice", "unknown", "unknown"]
    assert values(spark, [(0.1234,)], "n double", S.confidence(F.col("n"))) == [0.877]


def test_match_status_tests_readback_first(spark):
    rows = [("0123456789", "0123456789", "game_voice"), ("0123456789", "0123456789", "streamer"), ("0123456789", "012345678x", None), ("0123456789", "01234567xy", "streamer"), ("", "", "game_voice")]
    got = values(spark, rows, "a string, b string, s string", S.match_status(F.col("a"), F.col("b"), F.col("s"), 0.2, 0.15))
    assert got == ["readback_possible", "consistent", "consistent", "conflict", "readback_possible"]


def test_scene_cascade(spark):
    rows = [
        ("d", "c", None, None, True, True, False, "choice"),
        ("", None, "x", "streamer", False, True, False, "transition"),
        ("d", "c", None, None, False, True, False, "dialogue"),
        ("d", "", "x", "streamer", False, False, False, "narration"),
        (None, None, "x", "streamer", False, False, False, "reaction"),
        (None, None, "x", "game_voice", False, False, False, "narration"),
        (None, None, "x", "unknown", False, False, False, "reaction"),
        (None, None, None, None, False, False, True, "reaction"),
        (None, None, "", None, None, None, None, "silence"),
    ]
    cols = "dialogue string, name string, text string, guess string, choice boolean, chapter boolean, spike boolean, want string"
    assert all(a == b for a, b in values(spark, rows, cols, S.scene_type(*(F.col(c.split()[0]) for c in cols.split(", ")[:-1])), F.col("want")))


def test_resolution(spark):
    rows = [("abcdefg", "ab", "asr_missed"), ("a", "abcdefg", "ocr_partial"), ("伺を", "何を", "prefer_asr"), ("abc", "abd", "manual"), (None, "x", "asr_only"), ("x", None, "ocr_only"), (None, None, ""), ("", "x", "manual")]
    got = values(spark, [r[:2] for r in rows], "a string, b string", S.resolution(F.col("a"), F.col("b")))
    assert [r.code for r in got] == [r[2] for r in rows] and (got[2].wrong, got[2].right) == ("伺", "何")


def test_story_flags_by_the_first_configured_keyword(spark):
    rows = [("選択肢 CG",), ("CG 選択肢",), ("CG",), ("x",), ("",)]
    assert values(spark, rows, "x string", *S.story_flags(F.col("x"), ("選択肢", "CG"))) == [(True, False), (True, False), (False, True), (False, False), (False, False)]
    assert values(spark, rows[:1], "x string", *S.story_flags(F.col("x"), ())) == [(False, False)]


def test_names(spark):
    assert values(spark, [('a/b:c*d?"<>|e' + "x" * 30,)], "x string", S.run_key(F.col("x")))[0].endswith("_abcdexxxxxxx")
    rows = [("t", "c"), ("", "c"), (None, ""), (None, None)]
    assert values(spark, rows, "t string, c string", S.default_title(F.col("t"), F.col("c"), F.lit("s"))) == ["t", "【c】s", "s", "s"]
    assert values(spark, [(7, 3661.0)], "n int, x double", S.clip_name(F.col("n"), F.col("x"))) == ["clip_007_010101.mp4"]
    assert values(spark, [("d", "c", "a", "game_voice"), ("d", "", "a", "game_voice"), ("", "c", "a", "game_voice"), (None, None, "a", "streamer")], "d string, c string, a string, s string", S.original_text(*(F.col(c) for c in "dcas"))) == ["【c】d", "d", "a", None]
