"""Files written and read back."""

import json
import random

import pytest
from pyspark.sql import functions as F

from streamloom import schema
from streamloom.operators import chat, reports, subtitles
from streamloom.plans.fixtures import timeline
from streamloom.sources import readers


def test_chat_pages(spark, tmp_path):
    item = lambda kind, **x: {"snippet": {"displayMessage": "m", "publishedAt": "2024-01-01T00:00:01Z", "type": kind, **x}, "authorDetails": {"displayName": "a"}}
    pages = [[item("textMessageEvent"), item("superChatEvent", superChatDetails={"amountDisplayString": "¥500"})], [item("superStickerEvent", superStickerDetails={"amountDisplayString": "¥9"}), {"snippet": {}}]]
    folder = tmp_path / "video_id=7"
    folder.mkdir()
    for k, items in enumerate(pages):
        (folder / f"page{k}.json").write_text(json.dumps({"items": items, "nextPageToken": "t"}, indent=1))
    rows = chat.parsed(readers.read_chat_pages(spark, str(tmp_path))).orderBy("page_ord", "item_ord").collect()
    assert [(r.video_id, r.type, r.amount, r.author) for r in rows] == [(7, "normal", None, "a"), (7, "superchat", "¥500", "a"), (7, "super_sticker", "¥9", "a"), (7, "normal", None, "")]
    assert [r.published_us for r in rows] == [1704067201000000] * 3 + [None]


def test_raw_array_of_one_video(spark, tmp_path):
    (tmp_path / "12.json").write_text(json.dumps([{"start": 1, "end": 2.5, "text": "x"}, {"start": 3.0, "end": 4.0, "text": None, "language": "ja"}]))
    rows = readers.read_raw(spark, str(tmp_path), schema.ASR_RAW).orderBy("ord").collect()
    assert [tuple(r) for r in rows] == [(12, 0, 1.0, 2.5, "x", None, None), (12, 1, 3.0, 4.0, None, None, "ja")]


def test_timeline_defaults_and_layers(spark, sf_dir, tmp_path):
    rows = timeline(spark, sf_dir)
    readers.write_timeline(rows, str(tmp_path / "t"))
    back = readers.read_timeline(spark, str(tmp_path / "t"), strict=True).select(*schema.TIMELINE_COLUMNS)
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    (tmp_path / "bare.json").write_text('{"video_id": 1, "time_start": 61.0, "time_end": 62.0}')
    row = readers.read_timeline(spark, str(tmp_path / "bare.json")).first()
    assert (row.time_display, row.scene_type, row.ocr, row.score.total, row.events.cg_unlock, row["merge"].match_status) == ("00:01:01", "unknown", None, 0.0, False, "unverified")


def test_newest_timeline_of_a_folder(spark, tmp_path):
    import os

    for k, name in enumerate(("old", "new")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "timeline.json").write_text("{}")
        os.utime(tmp_path / name / "timeline.json", (1000 + k, 1000 + k))
    (tmp_path / "new" / "deep").mkdir()
    (tmp_path / "new" / "deep" / "timeline.json").write_text("{}")
    found = readers.newest_timeline(readers.list_timelines(spark, str(tmp_path))).first()
    assert found.path.endswith("/new/timeline.json")
    (tmp_path / "timeline.json").write_text("{}")
    assert readers.newest_timeline(readers.list_timelines(spark, str(tmp_path))).first().path == f"{tmp_path}/timeline.json"


def test_channel_parameters(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"video_id": 1, "channel": "a", "spike_threshold": 1.5}\n{"video_id": 2, "top_n": 3}\n')
    rows = readers.read_channel_params(spark, str(tmp_path / "c.jsonl")).orderBy("video_id").collect()
    assert [(r.spike_threshold, r.top_n, r.window_sec) for r in rows] == [(1.5, 30, 10.0), (2.5, 3, 10.0)]
    assert readers.params_of(rows[0]).channel == "a" and readers.params_of(rows[1]).top_n == 3


def test_nested_channel_parameters(spark, tmp_path):
    config = {"video_id": 3, "channel": {"name": "n", "game_language": "ja"}, "chat": {"spike_threshold": 1.5, "aggregate_window_sec": 5.0}, "highlight": {"weights": {"laughter": 1, "other": 2}, "top_n": 4}, "keywords": {"reaction": ["a", "b"]}, "characters": [{"name": "x", "aliases": ["y"]}]}
    (tmp_path / "c.json").write_text(json.dumps(config, indent=2))
    own = readers.params_of(readers.read_channel_params(spark, str(tmp_path / "c.json")).first())
    assert (own.channel, own.spike_threshold, own.window_sec, own.top_n, own.reaction_keywords, own.story_keywords, own.readback) == ("n", 1.5, 5.0, 4, ("a", "b"), (), 0.15)
    assert own.weights == {**readers.Params().weights, "laughter": 1.0, "other": 2.0}


def test_a_timeline_of_one_indented_array(spark, sf_dir, tmp_path):
    """The form with the layers that are there, a file a run, found by its root and searched."""
    segments = [{"time_start": 61.0, "time_end": 62.5, "time_display": "00:01:01", "asr": {"text": "hi there", "speaker_guess": "streamer", "language": "zh", "confidence": 0.9}, "scene_type": "reaction", "events": {"chat_spike": True}, "score": {"total": 20, "breakdown": {"laughter": 20}}, "merge": {"source_type": "asr_only"}}, {"time_start": 1.0, "time_end": 2.0}]
    (tmp_path / "ab12_run").mkdir()
    (tmp_path / "ab12_run" / "timeline.json").write_text(json.dumps(segments, ensure_ascii=False, indent=2))
    found = readers.newest_timeline(readers.list_timelines(spark, str(tmp_path))).first().path
    rows = readers.read_timeline_arrays(spark, found).orderBy("seg_ord").collect()
    assert [(r.seg_ord, r.time_start, r.asr and r.asr.text, r.score.total, r.events.chat_spike, r.time_display) for r in rows] == [(0, 61.0, "hi there", 20.0, True, "00:01:01"), (1, 1.0, None, 0.0, False, "00:00:01")]
    assert rows[0].video_id == rows[1].video_id is not None
    whole = timeline(spark, sf_dir)
    readers.write_timeline_arrays(whole, str(tmp_path / "out"))
    texts = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "out").rglob("part-*.txt")}
    assert len(texts) == whole.select("video_id").distinct().count() and all("ocr" not in s or s["ocr"] for t in texts.values() for s in t)


def test_a_video_is_one_file_in_order(spark, sf_dir, tmp_path):
    readers.write_timeline(timeline(spark, sf_dir).repartition(5), str(tmp_path / "t"))
    files = list((tmp_path / "t").rglob("part-*.json"))
    assert len(files) == len({p.parent for p in files})
    for p in files:
        places = [json.loads(line)["seg_ord"] for line in p.read_text().splitlines()]
        assert places == sorted(places)


def test_text_sinks(spark, sf_dir, tmp_path):
    rows = timeline(spark, sf_dir)
    readers.write_subtitles(subtitles.all_tracks(rows), str(tmp_path / "srt"))
    readers.write_youtube(reports.youtube_chapters(rows), str(tmp_path / "yt"))
    texts = [p.read_text() for p in (tmp_path / "srt" / "track=dual").rglob("part-*")]
    assert texts and all(t.startswith("1\n00:") and " --> " in t for t in texts)
    assert list((tmp_path / "yt").rglob("part-*"))


def test_texts_of_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "TEXT_LINES", 10)
    rows = [(t, v, n, f"{t}{v}\nline {n}") for t in ("x", "y") for v in (1, 2, 30) for n in range(1, 34)]
    random.Random(1).shuffle(rows)
    readers.write_lines(spark.createDataFrame(rows, "track string, video_id long, n int, block string").repartition(6), str(tmp_path / "t"), ["track", "video_id"], "n", "block")
    for t in ("x", "y"):
        for v in (1, 2, 30):
            files = sorted((tmp_path / "t" / f"track={t}" / f"video_id={v}").glob("part-*"))
            assert "".join(f.read_text() for f in files) == "".join(f"{t}{v}\nline {n}\n" for n in range(1, 34))


def test_named_files_read_as_listed_ones_do(spark, sf_dir, tmp_path):
    """What the sinks return names each file that lies there, and reading these gives what a listing does."""
    rows = timeline(spark, sf_dir)
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    names = lambda files: sorted(r.file for r in files.collect())
    lying = lambda top: sorted(str(p.relative_to(top)) for p in top.rglob("*") if p.is_file())
    files = readers.write_timeline(rows, path := f"{tmp_path}/t")
    assert names(files) == lying(tmp_path / "t")
    assert same(readers.read_timeline(spark, path, True, files), readers.read_timeline(spark, path, True).select(*schema.TIMELINE_COLUMNS))
    files = readers.write_timeline_arrays(rows, path := f"{tmp_path}/a")
    assert names(files) == lying(tmp_path / "a") and same(readers.read_timeline_arrays(spark, path, files), readers.read_timeline_arrays(spark, path))
    texts = spark.createDataFrame([("a/b c+%", 1, n, f"ä{n}\n\n") for n in range(1, 4)] + [(None, None, 1, None)], "track string, video_id long, n int, block string")
    files = readers.write_subtitles(texts, path := f"{tmp_path}/s")
    found = readers.read_texts(spark, path, files).select("track", F.col("video_id").cast("int"), "value")
    assert names(files) == lying(tmp_path / "s") and same(found, readers.read_texts(spark, path).select("track", "video_id", "value"))
    assert sorted(map(tuple, found.collect()), key=str) == [("a/b c+%", 1, "ä1\n\n\nä2\n\n\nä3\n\n"), (None, None, "")]
    with pytest.raises(FileExistsError):
        readers.write_subtitles(texts, path)
