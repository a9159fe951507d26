"""Operators against plain loops over one video at a time."""

import random

import pytest

from streamloom.operators import align, chat, clips, reports, screen, speech
from streamloom.params import Channels, Params
from streamloom.plans.fixtures import timeline

FRAMES = "video_id long, frame_ord long, frame_index long, dialogue_text string, name_text string, chapter_text string"
INTERVAL = "video_id long, seg_ord int, time_start double, time_end double"


@pytest.fixture(params=[10_000, 3])
def batched(spark, request):
    """The session with Arrow batches of so many rows: runs and islands go over their borders."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield spark
    spark.conf.set(name, before)


@pytest.mark.parametrize(("pairs", "rounds"), [(100_000, 16), (0, 16), (2, 1)])
def test_greedy_match_is_the_serial_one(batched, monkeypatch, pairs, rounds):
    monkeypatch.setattr(align, "ISLAND_PAIRS", pairs)
    monkeypatch.setattr(align, "ROUNDS", rounds)
    monkeypatch.setattr(align, "BLOCK_SEC", 7.0)
    rng = random.Random(4)
    sides = [[(v, k, a := round(rng.uniform(0, 60), 1), a + round(rng.uniform(0, 9), 1)) for v in range(60) for k in range(rng.randint(0, 9))] for _ in range(2)]
    left = [(v, k, a, b) for v, k, a, b in sides[0]]
    # the left side is numbered in time order
    left = [(v, n, a, b) for v in range(60) for n, (a, b) in enumerate(sorted((a, b) for w, _, a, b in left if w == v))]
    for threshold in (0.05, 0.3, 1.0):
        want = []
        for v in range(60):
            used = set()
            for _, n, a, b in sorted(r for r in left if r[0] == v):
                best, ratio = None, 0.0
                for _, k, c, d in sorted(r for r in sides[1] if r[0] == v):
                    short = min(b - a, d - c)
                    over = max(0.0, min(b, d) - max(a, c)) / short if short > 0 else 0.0
                    if k not in used and over > ratio:
                        best, ratio = k, over
                if best is not None and ratio >= threshold:
                    used.add(best)
                    want.append((v, n, best))
        got = align.greedy_match(batched.createDataFrame(left, INTERVAL), batched.createDataFrame(sides[1], INTERVAL), Params(overlap_ratio=threshold))
        assert sorted(map(tuple, got.collect())) == want


def test_debounce_is_the_serial_one(batched, monkeypatch):
    monkeypatch.setattr(screen, "BLOCK_FRAMES", 50)
    rng = random.Random(5)
    frames, want = [], []
    for v in range(20):
        value, anchor, count = rng.randrange(1 << 62), None, 0
        for k in range(rng.randint(0, 60)):
            for _ in range(rng.choice((0, 1, 2, 9))):
                value ^= 1 << rng.randrange(62)
            frames.append((v, k, k * 15, value, "t", "n", "c"))
            if anchor is None or bin(value ^ anchor[1]).count("1") > 4:
                anchor, count = (k * 15, value), 1
            else:
                count += 1
            if count == 2:
                want.append((v, *anchor))
    df = batched.createDataFrame(frames, "video_id long, frame_ord long, frame_index long, phash long, dialogue_text string, name_text string, chapter_text string")
    got = screen.stable_frames(df, Params()).select("video_id", "frame_index", "phash")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert screen.stable_frames(df, Params(stable_frames=1)).count() >= len(want)


def test_a_single_video_is_dealt_by_its_stretches(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    value, rows = 0, []
    for k in range(3000):
        value = rng.getrandbits(62) if rng.random() < 0.2 else value ^ (1 << rng.randrange(62)) * (rng.random() < 0.5)
        rows.append((1, k, k, value))
    df = spark.createDataFrame(rows, "video_id long, frame_ord long, frame_index long, phash long")
    counts = screen._in_stretches(df, F.lit(4)).groupBy("stretch").count()
    assert counts.agg(F.max("count")).first()[0] < 100 and counts.count() > 300


def test_a_second_row_of_parameters_is_an_error(spark):
    table = spark.createDataFrame([(1, 3), (2, 4), (2, 4)], "video_id long, hash_distance int")
    frames = spark.createDataFrame([(v, 0, 0, 5) for v in (1, 2)], "video_id long, frame_ord long, frame_index long, phash long")
    assert screen.stable_frames(frames.where("video_id = 1"), Channels(table.where("video_id = 1"), Params(stable_frames=1))).count() == 1
    with pytest.raises(Exception, match="several rows of parameters for video 2"):
        screen.stable_frames(frames, Channels(table, Params(stable_frames=1))).collect()


def test_debounce_of_odd_frames(batched):
    hashes = [None, None, -1, (1 << 63) - 1, 0, None, 0, 1]
    schema = "video_id long, frame_ord long, frame_index long, phash long, name_text string"
    # -1 and 2**63 - 1 are one bit apart; a frame without a hash ends a run
    df = batched.createDataFrame([(1, k, k, h, None) for k, h in enumerate(hashes)], schema)
    assert sorted(r.frame_index for r in screen.stable_frames(df, Params()).collect()) == [2, 6]
    assert sorted(r.frame_index for r in screen.stable_frames(df, Params(stable_frames=1)).collect()) == [0, 1, 2, 4, 5, 6]
    empty = screen.stable_frames(df.limit(0), Params())
    assert empty.columns == df.columns and empty.count() == 0


def test_reveals(spark):
    texts = ["", "ab", "abc", "abc", "abcd", None, "x", "xy", "ab"]
    df = spark.createDataFrame([(1, k, k, t, f"n{k}", f"c{k}") for k, t in enumerate(texts)], FRAMES)
    got = screen.collapsed_reveals(df).orderBy("ord").collect()
    assert [(r.ord, r.dialogue, r.name, r.chapter, r.frame_index) for r in got] == [(0, "abcd", "n1", "c1", 1), (1, "xy", "n6", "c6", 6), (2, "ab", "n8", "c8", 8)]


def test_reveals_of_tied_frames(spark):
    """Frames of one index stand in the order of frame_ord, however they come in."""
    texts = ["ab", "abc", "x", "xy", "xyz", "q"]
    rows = [(1, k, k // 3, t, f"n{k}", f"c{k}") for k, t in enumerate(texts)]
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        got = screen.collapsed_reveals(spark.createDataFrame(rows, FRAMES).repartition(3)).orderBy("ord").collect()
        assert [(r.ord, r.dialogue, r.name, r.frame_index) for r in got] == [(0, "abc", "n0", 0), (1, "xyz", "n2", 0), (2, "q", "n5", 1)]


def _messages(kinds):
    return [(1, k, f"a{k}", {"k": "hit", "o": "x", "p": "x"}[c], "superchat" if c == "p" else "normal", None, k * 1000) for k, c in enumerate(kinds)]


CHAT = "video_id long, msg_ord long, author string, text string, type string, amount string, published_us long"
DURATION = "video_id long, duration double"


def test_kept_messages_quota(spark):
    params = Params(reaction_keywords=("hit",))
    none = spark.createDataFrame([], DURATION)
    for kinds, want in (("pppkkkkkkkoooo", (3, 5, 0)), ("ppkoooo", (2, 1, 2)), ("oooooooo", (0, 0, 5)), ("ppppppp", (7, 0, 0))):
        rows = chat.kept_messages(spark.createDataFrame(_messages(kinds), CHAT), none, params).orderBy("kept_rank").collect()
        kept = [kinds[r.msg_ord] for r in rows]
        assert tuple(map(kept.count, "pko")) == want and kept == sorted(kept, key="pko".index)


def test_windows_truncate_and_start_at_the_first_message(spark):
    us = 1_000_000
    rows = [(1, 0, "a", "x", "normal", None, 100 * us), (1, 1, "a", "x", "normal", None, 97 * us), (1, 2, "a", "x", "normal", None, 89 * us), (1, 3, "a", "x", "normal", None, None), (1, 4, "a", "x", "superchat", None, 125 * us), (1, 5, "a", "x", "normal", None, 131 * us), (2, 0, "a", "x", "normal", None, None)]
    got = chat.chat_windows(spark.createDataFrame(rows, CHAT), spark.createDataFrame([(1, 29.0)], DURATION), Params()).orderBy("video_id", "win_idx").collect()
    # 3 s before the anchor is window 0, 11 s before is out of range, as is 31 s after; without speech there is one window
    assert [(r.video_id, r.win_idx, r.message_count, r.superchat_count) for r in got] == [(1, 0, 3, 0), (1, 2, 1, 1), (2, 0, 1, 0)]
    assert got[2].baseline_per_min == 0.0 and got[2].is_spike


def test_fallback_peaks(spark):
    quiet, loud = -40.0, 0.0
    few = [(1, k, loud if k in (5, 6, 9) else quiet - k / 1000) for k in range(40)]
    many = [(2, k, loud if k % 8 == 0 else quiet) for k in range(100)]
    df = spark.createDataFrame(few + many, "video_id long, win_idx long, db double")
    peaks = speech.volume_peaks(df).collect()
    assert sorted((r.start, r.end) for r in peaks if r.video_id == 1) == [(5.0, 10.0)]
    got = speech.peaks_with_fallback(df).collect()
    assert sum(r.video_id == 2 for r in got) == 13  # ten peaks or more: none is added
    # the windows 5-9 and the exclusive end 10 are taken, of the loudest 20 the rest comes on top
    starts = sorted(r.start for r in got if r.video_id == 1)
    assert 10.0 not in starts and starts.count(5.0) == 1


def test_clips_merge_by_the_running_end(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    params = Params()
    got = {(r.video_id, r.clip): (r.start, r.end) for r in clips.merged_intervals(rows, params).collect()}
    for v in {r.video_id for r in rows.collect()}:
        spans = sorted((max(0.0, r.time_start - 3), r.time_end + 3) for r in rows.where(f"video_id = {v}").collect())
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1] + 2:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        assert [list(got[v, k + 1]) for k in range(len(merged))] == merged
        break


def test_a_chapter_that_comes_back(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = timeline(spark, sf_dir).where("ocr IS NOT NULL").limit(30).withColumn("video_id", F.lit(1).cast("long"))
    from pyspark.sql import Window

    rows = rows.withColumn("seg_ord", F.row_number().over(Window.orderBy("time_start", "seg_ord")))
    rows = rows.where("seg_ord <= 3").withColumn("ocr", F.col("ocr").withField("chapter", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("A")), F.col("seg_ord"))))
    assert [r.chapter for r in reports.chapter_transitions(rows).orderBy("seg_ord").collect()] == ["A", "B", "A"]


def test_a_stream_without_chat(spark, sf_dir):
    from streamloom.plans import queries as Q
    from streamloom.plans.fixtures import raw_speech, view
    from streamloom.plans.pipeline import build_reports, build_timeline

    none = view(spark, sf_dir, "fx_chat").limit(0)
    rows = build_timeline(raw_speech(spark, sf_dir), Q._levels(spark, sf_dir), none, None, Q.FULL).cache()
    assert rows.count() == raw_speech(spark, sf_dir).count() and rows.where("chat IS NOT NULL").isEmpty()
    assert set(build_reports(rows, Q.FULL)) >= {"index", "sheet", "clips"}


def test_the_status_of_a_pair_takes_one_edit_distance_of_one_written_table(spark, sf_dir, monkeypatch):
    """Texts are short in bytes and long in work: each pair is compared once, in tasks of a few pairs."""
    from streamloom.operators import align
    from streamloom.plans import queries

    monkeypatch.setattr(align, "TASK_TEXTS", 5)
    tables = {}
    table = align.Workspace.table
    monkeypatch.setattr(align.Workspace, "table", lambda self, df, name: tables.setdefault(name, df) is None or table(self, df, name))
    rows = queries.match_status(spark, sf_dir)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan.lower()
    own = tables["ratios"]._jdf.queryExecution().optimizedPlan().toString().lower()
    assert own.count("levenshtein") == 1
    assert tables["ratios"].rdd.getNumPartitions() == -(-rows.count() // 5)
