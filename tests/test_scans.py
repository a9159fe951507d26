"""Scans in blocks, exact medians and peaks against plain loops, over groups that lie in many blocks."""

import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from streamloom.operators import align, clips, reports, scans, speech
from streamloom.params import Params


def test_running_values_of_both_sides(spark):
    rng = random.Random(1)
    rows = [(g, k, rng.choice([None, *range(9)])) for g in (1, 2) for k in rng.sample(range(300), 120)]
    df = spark.createDataFrame(rows, "g long, k long, v long").withColumn("b", F.floor(F.col("k") / 17))
    got = scans.running(df, ["g"], "b", ["k"], {"s": (F.sum, F.col("v")), "m": (F.max, F.col("v"))}, {"least": (F.min, F.col("v"))}).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [v for g, k, v in rows if g == r.g and k < r.k and v is not None]
        after = [v for g, k, v in rows if g == r.g and k > r.k and v is not None]
        assert (r.s, r.m, r.least) == (sum(before) if before else None, max(before, default=None), min(after, default=None))
    numbered = scans.with_numbers(df.drop("b"), ["g"], F.floor(F.col("k") / 50), ["k"], "n").collect()
    for g in (1, 2):
        assert [r.n for r in sorted((r for r in numbered if r.g == g), key=lambda r: r.k)] == list(range(1, 121))


def test_medians_are_exact(spark):
    rng = random.Random(2)
    groups = [[rng.gauss(-40, 9) for _ in range(n)] for n in (1, 2, 3, 500, 501)] + [[-200.0] * 300, [-200.0] * 300 + [1.0], [0.1, 0.2, 0.1 + 1 / 64, 0.3], [-0.0, 1e9, -1e9]]
    rows = [(g, v) for g, own in enumerate(groups) for v in own] + [(0, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r.m for r in scans.medians(df, ["g"], "v", "m").collect()}
    for g, own in enumerate(groups):
        own = sorted(own)
        assert got[g] == 0.5 * own[(len(own) - 1) // 2] + 0.5 * own[len(own) // 2] == pytest.approx(statistics.median(own))


def _plain_peaks(levels, fallback):
    """Start, end and loudness of the peaks of one video, by its windows in order."""
    base = statistics.median(levels.values())
    runs = []
    for k in sorted(k for k, db in levels.items() if db >= base + speech.LOUDER_DB):
        if runs and k - runs[-1][1] <= speech.MERGE_GAP + 1:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    out = [(a, b + 1, max(db for k, db in levels.items() if a <= k <= b and db >= base + speech.LOUDER_DB)) for a, b in runs]
    if fallback and len(runs) < speech.FEW_PEAKS:
        top = sorted(levels, key=lambda k: (levels[k], k), reverse=True)[: speech.LOUDEST]
        out += [(k, k + 1, levels[k]) for k in top if not any(a <= k <= b + 1 for a, b in runs)]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 7, 4096])
def test_peaks_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(speech, "BLOCK_WINDOWS", block)
    rng = random.Random(block)
    videos = {v: {k: float(rng.choice([-60, -50, -49, -48] + [-30] * (v % 3))) for k in rng.sample(range(130), 110)} for v in range(9)}
    df = spark.createDataFrame([(v, k, db) for v, own in videos.items() for k, db in own.items()], "video_id long, win_idx long, db double")
    for fallback, found in ((False, speech.volume_peaks(df)), (True, speech.peaks_with_fallback(df))):
        got = {}
        for r in found.collect():
            got.setdefault(r.video_id, []).append((r.start, r.end, r.peak_db))
        assert {v: sorted(x) for v, x in got.items()} == {v: p for v, own in videos.items() if (p := _plain_peaks(own, fallback))}


def test_a_long_video_takes_no_more_than_its_share(spark):
    def took(n):
        df = spark.range(n).selectExpr("1L video_id", "id win_idx", "-50.0D - pmod(hash(id), 3) + if(pmod(id, 40) < 2, 30, 0) db")
        started = time.perf_counter()
        assert speech.volume_peaks(df).count() == n // 40
        return time.perf_counter() - started

    took(4000)
    short, long = took(40_000), took(400_000)
    assert long < 10 * short and long < 120


def test_ranges_that_meet(spark, monkeypatch):
    monkeypatch.setattr(scans, "SPAN", 7)
    rng = random.Random(4)
    some = lambda n: [(v, k, a := rng.randrange(60), a + rng.choice([0, 1, 3, 20])) for v in (1, 2) for k in range(n)]
    queries, ranges = some(25), some(3)
    df = lambda rows: spark.createDataFrame(rows, "v long, k long, first long, last long")
    got = {tuple(r) for r in scans.meeting(df(queries), df(ranges).drop("k"), ["v"], ["k"]).collect()}
    assert got == {(v, k) for v, k, a, b in queries if any(w == v and c <= b and d >= a for w, _, c, d in ranges)}


def test_covers_hold_each_number_once(spark):
    rng = random.Random(5)
    rows = [(a, a + n) for n in [*range(20), 36_000, 123_457] for a in (0, 1, rng.randrange(1000), rng.randrange(10**6))]
    for r in spark.createDataFrame(rows, "a long, b long").select("a", "b", scans.cover(F.col("a"), F.col("b")).alias("c")).collect():
        numbers = [x for n in r.c for x in range(n.node << n.level, (n.node + 1) << n.level)]
        assert sorted(numbers) == list(range(r.a, r.b + 1)) and len(r.c) <= 40


def test_long_segments_take_the_chat_of_all_their_windows(spark):
    rng = random.Random(6)
    windows = []
    for v in (1, 2):
        for w in sorted(rng.sample(range(400), 250)):
            messages = [(f"a{w}", f"m{w}.{k}", "normal", None) for k in range(rng.randrange(1, 4))]
            windows.append((v, w, w * 10.0, w * 10.0 + 10, len(messages), rng.randrange(3), messages, float(rng.randrange(9)), float(w), rng.random() < 0.1))
    ddl = "video_id long, win_idx long, time_start double, time_end double, message_count long, superchat_count long, messages array<struct<author:string,text:string,type:string,amount:string>>, density_per_min double, baseline_per_min double, is_spike boolean"
    spans = [(0.0, 5.0), (0.0, 4999.0), (31.0, 36_000.0), (777.0, 1500.0), (5000.0, 90_000.0), (100.0, 185.0), (64.0, 5119.0)]
    segments = spark.createDataFrame([(v, k, a, b, None, None, None) for v in (1, 2) for k, (a, b) in enumerate(spans)], "video_id long, seg_ord int, time_start double, time_end double, chat string, events string, score string")
    from streamloom import schema

    events = F.struct(*(F.lit(False).alias(x) for x in schema.EVENT_FLAGS)).alias("events")
    score = F.struct(F.lit(0.0).alias("total"), F.struct(*(F.lit(0.0).alias(x) for x in schema.SCORE_PARTS)).alias("breakdown")).alias("score")
    segments = segments.select("video_id", "seg_ord", "time_start", "time_end", F.lit(None).cast(schema.CHAT).alias("chat"), events, score)
    df = spark.createDataFrame(windows, ddl)
    for r in align.overlay_chat(segments, df, Params()).collect():
        own = [w for w in windows if w[0] == r.video_id and int(r.time_start / 10) <= w[1] <= int(r.time_end / 10)]
        if not own:
            assert r.chat is None
            continue
        assert (r.chat.message_count, r.chat.superchat_count, r.chat.is_spike, r.chat.baseline_per_min) == (sum(w[4] for w in own), sum(w[5] for w in own), any(w[9] for w in own), own[-1][8])
        assert [m.text for m in r.chat.messages] == [m[1] for w in own for m in w[6]][:10]


def test_overlaps_of_rows_of_any_length(spark):
    rng = random.Random(7)
    some = lambda n: [(rng.choice([1, 2]), k, a := rng.uniform(-50, 3000), a + rng.choice([0.0, 0.5, 10.0, 20.0, 33.0, 900.0, 3000.0])) for k in range(n)]
    left, right = some(90), some(80)
    df = lambda rows: spark.createDataFrame(rows, "video_id long, seg_ord int, time_start double, time_end double")
    got = sorted((r.seg_ord, r.ocr_ord, round(r.ratio, 9)) for r in align.overlap_candidates(df(left), df(right), 0.2).collect())
    want = []
    for v, i, a, b in left:
        for w, j, c, d in right:
            if v == w and b > a and d > c and (ratio := (min(b, d) - max(a, c)) / min(b - a, d - c)) >= 0.2:
                want.append((i, j, round(ratio, 9)))
    assert got == sorted(want)


def test_intervals_merge_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(clips, "BLOCK_SEC", 50)
    rng, params = random.Random(6), Params()
    rows = [(v, k, float(a), a + rng.choice([1.0, 3.0, 9.0, 400.0 if k % 40 == 0 else 2.0])) for v in ("a", "b") for k, a in enumerate(sorted(rng.choices(range(6000), k=220)))]
    got = clips.merged_intervals(spark.createDataFrame(rows, "video_id string, seg_ord int, time_start double, time_end double"), params).collect()
    plain = {}
    for v in ("a", "b"):
        own = []
        for start, end in sorted((max(0.0, a - params.clip_padding_sec), b + params.clip_padding_sec) for w, _, a, b in rows if w == v):
            if own and start <= own[-1][1] + params.clip_gap_sec:
                own[-1][1] = max(own[-1][1], end)
            else:
                own.append([start, end])
        plain |= {(v, n): tuple(x) for n, x in enumerate(own, 1)}
        assert len(own) > 5 and any(t - s > 400 for s, t in own)
    assert {(r.video_id, r.clip): (r.start, r.end) for r in got} == plain


def test_chapters_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(scans, "SPAN", 7)
    rng = random.Random(7)
    rows = [(v, k, float(k), (rng.choice([None, "", *"aaab"]),)) for v in ("x", "y") for k in range(200)]
    got = reports.chapter_transitions(spark.createDataFrame(rows, "video_id string, seg_ord int, time_start double, ocr struct<chapter:string>"))
    plain, last = [], {}
    for v, k, at, (chapter,) in rows:
        if chapter and last.get(v) != chapter:
            plain.append((v, k, at, chapter))
            last[v] = chapter
    assert sorted(map(tuple, got.collect())) == plain and got.columns == ["video_id", "seg_ord", "time_start", "chapter"]
