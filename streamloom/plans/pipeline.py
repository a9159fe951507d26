"""The whole build: raw tables to a classified timeline and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from streamloom.operators import align, chat, clips, reports, screen, speech, subtitles
from streamloom.params import AnyParams
from streamloom.storage import Workspace


def build_timeline(raw_speech: DataFrame, levels: DataFrame, raw_chat: DataFrame, raw_screen: DataFrame | None, params: AnyParams) -> DataFrame:
    """Speech, windows within the stream's duration, screen rows, alignment and scene types."""
    ws = Workspace(raw_speech.sparkSession, "timeline")
    peaks = speech.peaks_with_fallback(ws.table(levels, "levels"))
    spoken = ws.table(speech.speech_segments(raw_speech, peaks, params), "speech")
    windows = chat.windows_with_messages(raw_chat, chat.stream_durations(spoken), params)
    if raw_screen is None:
        timeline = align.align_mvp(spoken, windows, params)
    else:
        timeline = align.align_full(spoken, windows, screen.screen_segments(raw_screen, params), params)
    return align.classified(timeline)


def build_reports(timeline: DataFrame, params: AnyParams) -> dict[str, DataFrame]:
    """The report tables; write or persist the timeline first, since each of them reads it."""
    return {
        "index": reports.index_events(timeline),
        "youtube": reports.youtube_chapters(timeline),
        "sheet": reports.transcript_sheet(timeline),
        "characters": reports.character_stats(timeline),
        "scenes": reports.scene_distribution(timeline),
        "overview": reports.time_overview(timeline),
        "conflicts": reports.conflict_rows(timeline),
        "conflict_summary": reports.conflict_summary(timeline),
        "subtitles": subtitles.all_tracks(timeline),
        "clips": clips.clip_manifest(timeline, params),
    }
