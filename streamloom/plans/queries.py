"""A query for each operator over the views of fixtures.py."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom import schema
from streamloom.functions import scalar as S
from streamloom.operators import align, chat, clips, reports, screen, search, speech, subtitles
from streamloom.params import Channels, Params
from streamloom.plans.fixtures import raw_speech, timeline, view
from streamloom.plans.pipeline import build_reports, build_timeline
from streamloom.sources import readers
from streamloom.sources.search_index import TimelineIndex, write_index
from streamloom.storage import Workspace

#: A threshold at which every branch of the chat path occurs in the views.
CHAT = Params(spike_threshold=1.5, reaction_keywords=("error", "click"))
FULL = Params(spike_threshold=1.5, reaction_keywords=("error", "click"), story_keywords=("CG", "分岐"))
SAMPLES = 10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _chat(spark, d):
    return view(spark, d, "fx_chat")


def _durations(spark, d):
    return raw_speech(spark, d).groupBy("video_id").agg(F.max("end").alias("duration"))


def _levels(spark, d):
    return speech.audio_levels(view(spark, d, "fx_audio"), SAMPLES)


def _windows(spark, d):
    return chat.windows_with_messages(_chat(spark, d), _durations(spark, d), CHAT)


def _speech(spark, d):
    return speech.speech_segments(raw_speech(spark, d), speech.peaks_with_fallback(_levels(spark, d)), CHAT)


def _screen(spark, d):
    return screen.screen_segments(view(spark, d, "fx_ocr"), FULL)


def _said(spark, d):
    """Speech rows in their own order, as the left side of matching."""
    return align.numbered(_speech(spark, d))


def _messages(c: str):
    return F.array_join(F.transform(c, lambda m: F.concat_ws("/", m["author"], m["text"], m["type"], F.coalesce(m["amount"], F.lit("-")))), "|")


def _shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share, for what round-trip queries write; it goes when the driver ends."""
    return Workspace(spark, "roundtrip").path


@query
def chat_pages_parse(spark, d):
    rows = _chat(spark, d)
    kind = F.when(F.col("type") == "superchat", "superChatEvent").when(F.col("type") == "super_sticker", "superStickerEvent").otherwise("textMessageEvent")
    amount = F.struct(F.col("amount").alias("amountDisplayString"))
    stamp = F.date_format(F.timestamp_micros("published_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    item = F.struct(F.struct(F.col("text").alias("displayMessage"), stamp.alias("publishedAt"), kind.alias("type"), amount.alias("superChatDetails"), amount.alias("superStickerDetails")).alias("snippet"), F.struct(F.col("author").alias("displayName")).alias("authorDetails"))
    pages = rows.groupBy("video_id", F.floor(F.col("msg_ord") / 2000).alias("page_ord")).agg(F.transform(F.array_sort(F.collect_list(F.struct("msg_ord", item.alias("item")))), lambda x: x["item"]).alias("items"))
    out = chat.parsed(readers.parse_chat_pages(pages))
    return out.select("video_id", "page_ord", "item_ord", "author", "text", "type", "amount", "published_us")


@query
def chat_offsets(spark, d):
    return chat.chat_offsets(_chat(spark, d)).select("video_id", "msg_ord", "offset_sec")


@query
def stream_anchor(spark, d):
    return chat.stream_anchor(_chat(spark, d))


@query
def chat_windows(spark, d):
    return chat.chat_windows(_chat(spark, d), _durations(spark, d), CHAT).select("video_id", "win_idx", "time_start", "time_end", "message_count", "superchat_count")


@query
def chat_baseline(spark, d):
    return chat.chat_windows(_chat(spark, d), _durations(spark, d), CHAT).select("video_id", "baseline_per_min").distinct()


@query
def chat_spikes(spark, d):
    return chat.chat_windows(_chat(spark, d), _durations(spark, d), CHAT).where("is_spike").select("video_id", "win_idx", "message_count", "density_per_min", "baseline_per_min")


@query
def chat_run_summary(spark, d):
    return chat.run_summary(chat.chat_windows(_chat(spark, d), _durations(spark, d), CHAT))


@query
def chat_kept_messages(spark, d):
    return chat.kept_messages(_chat(spark, d), _durations(spark, d), CHAT).select("video_id", "win_idx", "kept_rank", "msg_ord", "type")


@query
def audio_rms(spark, d):
    return _levels(spark, d).select("video_id", "win_idx", S.rounded(F.col("db"), 6).alias("db"))


@query
def audio_baseline(spark, d):
    return speech.audio_baseline(_levels(spark, d)).select("video_id", S.rounded(F.col("baseline_db"), 6).alias("baseline_db"))


def _peaks(rows):
    return rows.select("video_id", "start", "end", S.rounded(F.col("peak_db"), 6).alias("peak_db"), S.rounded(F.col("db_above_baseline"), 6).alias("db_above_baseline"))


@query
def volume_peaks(spark, d):
    return _peaks(speech.volume_peaks(_levels(spark, d)))


@query
def peak_fallback(spark, d):
    return _peaks(speech.peaks_with_fallback(_levels(spark, d)))


@query
def silence_bursts(spark, d):
    return speech.silence_bursts(raw_speech(spark, d))


@query
def asr_segments(spark, d):
    rows = speech.speech_parts(raw_speech(spark, d), speech.peaks_with_fallback(_levels(spark, d)), CHAT)
    return rows.select("video_id", "ord", "start", "end", "text", "speaker_guess", "confidence", "s_volume_spike", "s_laughter", "s_keyword_hit", "s_silence_then_burst", "score_total", "streamer_reaction")


@query
def ocr_durations(spark, d):
    return screen.with_durations(view(spark, d, "fx_ocr"), FULL).select("video_id", "ord", "time_start", "time_end")


@query
def first_seen_flags(spark, d):
    return screen.first_seen(view(spark, d, "fx_ocr")).select("video_id", "ord", "chapter_change", "new_character")


@query
def story_flags(spark, d):
    choice, cg = S.story_flags(F.col("dialogue"), ("CG", "分岐"))
    return view(spark, d, "fx_ocr").select("video_id", "ord", choice.alias("choice_point"), cg.alias("cg_unlock"))


@query
def ocr_segments(spark, d):
    return _screen(spark, d).select("video_id", "seg_ord", "time_start", "time_end", "time_display", "ocr.chapter", "ocr.character", "ocr.dialogue", "ocr.confidence", "ocr.source_frame", "events.chapter_change", "events.new_character", "events.choice_point", "events.cg_unlock", "merge.source_type", "merge.match_status")


@query
def frame_sampling(spark, d):
    return screen.sampled_frames(view(spark, d, "fx_frames"), 30.0, Params()).select("video_id", "frame_index")


@query
def reveal_collapse(spark, d):
    return screen.collapsed_reveals(view(spark, d, "fx_frames"))


@query
def frame_debounce(spark, d):
    return screen.stable_frames(view(spark, d, "fx_frames"), Params()).select("video_id", "frame_index", "phash")


@query
def frames_to_rows(spark, d):
    return screen.rows_of_frames(view(spark, d, "fx_frames"), 30.0, Params())


def _flat(rows):
    return rows.select(
        "video_id", "seg_ord", "time_start", "time_end", "chat.message_count", "chat.superchat_count", "chat.density_per_min", "chat.baseline_per_min", "chat.is_spike",
        _messages("chat.messages").alias("messages"), "events.chat_spike", F.col("score.total").alias("score_total"), F.col("score.breakdown.chat_spike").alias("chat_score"), "merge.source_type",
    )


@query
def overlay_chat(spark, d):
    return _flat(align.overlay_chat(_speech(spark, d), _windows(spark, d), CHAT))


@query
def event_only_segments(spark, d):
    return _flat(align.event_only_segments(_speech(spark, d), _windows(spark, d), CHAT))


@query
def align_mvp(spark, d):
    return _flat(align.align_mvp(_speech(spark, d), _windows(spark, d), CHAT))


@query
def overlap_candidates(spark, d):
    pairs = align.overlap_candidates(_speech(spark, d), _screen(spark, d), FULL.overlap_ratio)
    return pairs.withColumn("ratio", S.rounded(F.col("ratio"), 6))


@query
def match_status(spark, d):
    ws = Workspace(spark, "status")
    said, shown = ws.table(_speech(spark, d), "said"), ws.table(_screen(spark, d), "shown")
    pairs = ws.table(align.overlap_candidates(said, shown, FULL.overlap_ratio), "pairs")
    rows = align.edit_ratios(pairs, said, shown, ws)
    status = S.status_of(F.col("edit_ratio"), F.col("guess"), FULL.consistent, FULL.readback)
    return rows.select("video_id", "seg_ord", "ocr_ord", S.rounded(F.col("edit_ratio"), 6).alias("ratio"), status.alias("status"), F.when(status == "conflict", S.conflict_note(F.col("shown"), F.col("said"))).alias("note"))


@query
def greedy_match(spark, d):
    return align.greedy_match(_said(spark, d), _screen(spark, d), FULL)


@query
def match_totals(spark, d):
    shown = _screen(spark, d)
    return align.match_summary(shown, align.greedy_match(_said(spark, d), shown, FULL))


@query
def unmatched_ocr(spark, d):
    shown = _screen(spark, d)
    return align.unmatched(shown, align.greedy_match(_said(spark, d), shown, FULL)).select("video_id", "seg_ord")


@query
def align_full(spark, d):
    rows = align.align_full(_speech(spark, d), _windows(spark, d), _screen(spark, d), FULL)
    return rows.select("video_id", "seg_ord", "time_start", "ocr.chapter", "ocr.dialogue", "asr.text", "chat.message_count", "events.chapter_change", "events.cg_unlock", "score.total", "merge.source_type", "merge.match_status", "merge.conflict_note")


@query
def scene_types(spark, d):
    return align.classified(timeline(spark, d)).select("video_id", "seg_ord", "scene_type")


@query
def scene_distribution(spark, d):
    return reports.scene_distribution(align.classified(timeline(spark, d)))


@query
def search_character(spark, d):
    return search.lines(search.by_character(timeline(spark, d), "char1"))


@query
def search_keyword(spark, d):
    return search.lines(search.by_keyword(timeline(spark, d), "the"))


def _index(spark, d):
    write_index(timeline(spark, d), path := f"{_shared(spark)}/index")
    return TimelineIndex(spark, path, schema.TIMELINE)


@query
def indexed_keyword(spark, d):
    """R2 by the trigram postings of a timeline that is written with them."""
    return search.lines(_index(spark, d).by_keyword("the"))


@query
def indexed_character(spark, d):
    return search.lines(_index(spark, d).by_character("char1"))


@query
def indexed_chapter(spark, d):
    return search.lines(_index(spark, d).by_chapter("Chapter 1"))


@query
def top_reactions(spark, d):
    rows = search.top_reactions(timeline(spark, d), 10)
    return rows.select("video_id", "rank", "seg_ord", "scored", S.display_line(True).alias("line"))


@query
def chapter_list(spark, d):
    return search.chapters(timeline(spark, d))


@query
def chapter_filter(spark, d):
    return search.lines(search.by_chapter(timeline(spark, d), "Chapter 1"))


@query
def search_conflicts(spark, d):
    return search.conflicts(timeline(spark, d))


@query
def search_superchats(spark, d):
    return search.superchats(timeline(spark, d))


@query
def character_stats(spark, d):
    return reports.character_stats(timeline(spark, d))


@query
def character_totals(spark, d):
    return reports.character_totals(timeline(spark, d))


@query
def time_overview(spark, d):
    return reports.time_overview(timeline(spark, d))


@query
def conflict_summary(spark, d):
    return reports.conflict_summary(timeline(spark, d))


@query
def conflict_rows(spark, d):
    return reports.conflict_rows(timeline(spark, d))


@query
def index_chapters(spark, d):
    return reports.chapter_transitions(timeline(spark, d))


@query
def index_debuts(spark, d):
    return reports.debuts(timeline(spark, d))


@query
def index_spikes(spark, d):
    return reports.spike_events(timeline(spark, d))


@query
def index_reactions(spark, d):
    return reports.reaction_events(timeline(spark, d))


@query
def index_events(spark, d):
    return reports.index_events(timeline(spark, d))


@query
def youtube_chapters(spark, d):
    return reports.youtube_chapters(timeline(spark, d))


@query
def youtube_text(spark, d):
    files = readers.write_youtube(reports.youtube_chapters(timeline(spark, d)), path := f"{_shared(spark)}/youtube")
    return readers.read_texts(spark, path, files).select(F.col("video_id").cast("long").alias("video_id"), "value")


@query
def transcript_sheet(spark, d):
    return reports.transcript_sheet(timeline(spark, d))


@query
def srt_original(spark, d):
    return subtitles.original_track(timeline(spark, d))


@query
def srt_streamer(spark, d):
    return subtitles.streamer_track(timeline(spark, d))


@query
def srt_dual(spark, d):
    return subtitles.dual_track(timeline(spark, d))


@query
def srt_counts(spark, d):
    return subtitles.track_counts(timeline(spark, d))


@query
def srt_text(spark, d):
    files = readers.write_subtitles(subtitles.all_tracks(timeline(spark, d)), path := f"{_shared(spark)}/srt")
    return readers.read_texts(spark, path, files).select("track", F.col("video_id").cast("long").alias("video_id"), "value")


@query
def highlights(spark, d):
    return clips.highlights(timeline(spark, d), Params())


@query
def merged_intervals(spark, d):
    return clips.merged_intervals(timeline(spark, d), Params())


@query
def clip_manifest(spark, d):
    rows = clips.clip_manifest(timeline(spark, d), Params())
    return rows.select("video_id", "n", S.rounded(F.col("start"), 6).alias("start"), S.rounded(F.col("end"), 6).alias("end"), "duration", "score", "segments", "filename")


@query
def clip_totals(spark, d):
    return clips.clip_totals(clips.clip_manifest(timeline(spark, d), Params()))


def _stems(spark, d):
    stem = F.concat(F.lit("stream: "), F.col("video_id").cast("string"), F.lit("/part?"), F.repeat(F.lit("x"), F.col("video_id").cast("int") % 30))
    return view(spark, d, "fx_asr").select("video_id").distinct().withColumn("stem", stem)


@query
def run_keys(spark, d):
    return _stems(spark, d).select("video_id", S.run_key(F.col("stem")).alias("run_key"))


@query
def titles(spark, d):
    v = F.col("video_id")
    title, channel = F.when(v % 3 == 0, "Own title").otherwise(""), F.when(v % 3 == 1, "Channel").otherwise("")
    return _stems(spark, d).select("video_id", S.default_title(title, channel, F.col("stem")).alias("title"))


@query
def spikes_by_channel(spark, d):
    videos = _durations(spark, d).select("video_id")
    rows = spark.createDataFrame([(0, 1.5), (1, 2.5)], "parity long, spike_threshold double")
    channels = videos.withColumn("parity", F.col("video_id") % 2).join(F.broadcast(rows), "parity").drop("parity")  # two rows
    return chat.spikes_by_channel(_chat(spark, d), _durations(spark, d), channels, CHAT)


@query
def scores_by_channel(spark, d):
    """Speech scored by the weights and keywords of each video's channel, and the highlights that its least score leaves."""
    even = F.col("video_id") % 2 == 0
    words = F.when(even, F.array(F.lit("er"))).otherwise(F.array(F.lit("in"), F.lit("zz")))
    weights = F.when(even, F.create_map(F.lit("volume_spike"), F.lit(5.0))).otherwise(F.create_map(F.lit("keyword_hit"), F.lit(7.0)))
    table = _durations(spark, d).select("video_id", words.alias("reaction_keywords"), weights.alias("weights"), F.when(even, 20.0).alias("min_score"))
    channels = Channels(table, Params(min_segment_sec=1.0))
    rows = speech.speech_segments(raw_speech(spark, d), speech.peaks_with_fallback(_levels(spark, d)), channels)
    return clips.highlights(rows, channels)


def _channel_files(spark, d):
    """Parameters in nested files, one object a video: every second one leaves some to the defaults."""
    v = F.col("video_id")
    even = v % 2 == 0
    ocr = F.struct(F.when(even, 0.25).otherwise(1.0).alias("sample_interval_sec"), F.when(even, 6).alias("hash_diff_threshold"), F.when(~even, 3).alias("stable_threshold"))
    chat_ = F.struct((1.5 + v % 3).alias("spike_threshold"))
    weights = F.struct(F.struct(F.when(even, 7.0).alias("laughter"), F.lit(2.0).alias("other")).alias("weights"), (v % 5).cast("int").alias("top_n"))
    words = F.struct(F.when(even, F.array(F.lit("a"), F.lit("b"))).alias("reaction"))
    rows = view(spark, d, "fx_frames").select("video_id").distinct()
    files = rows.select("video_id", F.struct(F.concat(F.lit("c"), v.cast("string")).alias("name")).alias("channel"), ocr.alias("ocr"), chat_.alias("chat"), weights.alias("highlight"), words.alias("keywords"))
    files.write.json(path := f"{_shared(spark)}/channels.jsonl")
    return readers.read_channel_params(spark, path)


@query
def channel_params_read(spark, d):
    rows = _channel_files(spark, d)
    return rows.select("video_id", "channel", "spike_threshold", "sample_interval_sec", "hash_distance", "stable_frames", "top_n", "window_sec", F.col("weights")["laughter"].alias("laughter"), F.col("weights")["other"].alias("other"), F.col("weights")["chat_spike"].alias("chat_spike"), F.array_join("reaction_keywords", "|").alias("keywords"))


@query
def frames_by_channel(spark, d):
    """Frames sampled and debounced by the parameters of each video's file."""
    table = _channel_files(spark, d).select("video_id", "sample_interval_sec", "hash_distance", "stable_frames")
    channels = Channels(table)
    return screen.stable_frames(screen.sampled_frames(view(spark, d, "fx_frames"), 30.0, channels), channels).select("video_id", "frame_index", "phash")


@query
def raw_chat_read(spark, d):
    stamp = F.date_format(F.timestamp_micros("published_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = _chat(spark, d).select("video_id", "msg_ord", "author", "text", stamp.alias("timestamp_ms"), "type", "amount")
    files = readers.write_raw(rows, path := f"{_shared(spark)}/chat", "msg_ord")
    return chat.parsed(readers.read_raw(spark, path, schema.CHAT_RAW, files))


@query
def raw_asr_read(spark, d):
    files = readers.write_raw(raw_speech(spark, d), path := f"{_shared(spark)}/asr", "ord")
    return readers.read_raw(spark, path, schema.ASR_RAW, files)


@query
def raw_ocr_read(spark, d):
    files = readers.write_raw(view(spark, d, "fx_ocr"), path := f"{_shared(spark)}/ocr", "ord")
    return readers.read_raw(spark, path, schema.OCR_RAW, files)


@query
def timeline_roundtrip(spark, d):
    files = readers.write_timeline(timeline(spark, d), path := f"{_shared(spark)}/timeline")
    rows = readers.read_timeline(spark, path, strict=True, files=files)
    return rows.select("video_id", "seg_ord", "time_start", "time_end", "time_display", "ocr.dialogue", "asr.text", "chat.density_per_min", _messages("chat.messages").alias("messages"), "events.chat_spike", F.col("score.total").alias("score_total"), "merge.match_status")


@query
def timeline_array_read(spark, d):
    """Timelines written as arrays, read back and searched."""
    files = readers.write_timeline_arrays(timeline(spark, d), path := f"{_shared(spark)}/timeline")
    rows = search.by_keyword(readers.read_timeline_arrays(spark, path, files), "the")
    return rows.select("video_id", "seg_ord", "time_start", "time_display", "ocr.dialogue", "asr.text", _messages("chat.messages").alias("messages"), "events.chat_spike", F.col("score.total").alias("score_total"), "merge.match_status")


@query
def newest_timeline(spark, d):
    """Roots of up to eight runs each, some with a timeline of their own."""
    v = F.col("video_id")
    root = F.concat(F.lit("/runs/"), (v % 25).cast("string"))
    files = _durations(spark, d).select(root.alias("root"), F.when(v < 25, F.when(v % 4 == 0, F.concat(root, F.lit("/timeline.json"))).otherwise(F.concat(root, F.lit("/a/b/timeline.json")))).otherwise(F.concat(root, F.lit("/run"), v.cast("string"), F.lit("/timeline.json"))).alias("path"), (v * 7919 % 1000).alias("modified"))
    return readers.newest_timeline(files)


@query
def full_pipeline(spark, d):
    rows = build_timeline(raw_speech(spark, d), _levels(spark, d), _chat(spark, d), view(spark, d, "fx_ocr"), FULL)
    return rows.select("video_id", "seg_ord", "time_start", "time_end", "scene_type", "ocr.dialogue", "asr.text", "chat.message_count", "score.total", "merge.source_type", "merge.match_status")


@query
def report_rows(spark, d):
    """The rows of each report of the whole set."""
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("report"), "n") for name, rows in build_reports(align.classified(timeline(spark, d)), Params()).items()]
    return reduce(DataFrame.unionByName, counts)
