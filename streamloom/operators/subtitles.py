"""Subtitle tracks of a timeline: (track, video_id, n, block)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.functions import scalar as S
from streamloom.operators import scans


def _track(timeline: DataFrame, name: str, text: Column) -> DataFrame:
    """The rows with a text, numbered in blocks of segments; the timeline is read twice."""
    rows = timeline.withColumn("text", text).where(F.coalesce("text", F.lit("")) != "")
    rows = scans.with_numbers(rows, ["video_id"], F.floor(F.col("seg_ord") / scans.SPAN), ["seg_ord"], "n")
    return rows.select(F.lit(name).alias("track"), "video_id", "n", S.srt_block(F.col("n"), F.col("time_start"), F.col("time_end"), F.col("text")).alias("block"))


def _original(named: bool) -> Column:
    return S.original_text(F.col("ocr.dialogue"), F.col("ocr.character"), F.col("asr.text"), F.col("asr.speaker_guess"), named)


def _streamer() -> Column:
    return S.streamer_text(F.col("asr.text"), F.col("asr.speaker_guess"))


def original_track(timeline: DataFrame, named: bool = True) -> DataFrame:
    """T1"""
    return _track(timeline, "original", _original(named))


def streamer_track(timeline: DataFrame) -> DataFrame:
    """T2"""
    return _track(timeline, "streamer", _streamer())


def dual_track(timeline: DataFrame, named: bool = True) -> DataFrame:
    """The original above the streamer; either may be missing."""
    return _track(timeline, "dual", F.concat_ws("\n", _original(named), _streamer()))


def all_tracks(timeline: DataFrame, named: bool = True) -> DataFrame:
    """T4"""
    return reduce(DataFrame.unionByName, [original_track(timeline, named), streamer_track(timeline), dual_track(timeline, named)])


def track_counts(timeline: DataFrame) -> DataFrame:
    return all_tracks(timeline).groupBy("track", "video_id").agg(F.count("*").alias("subtitles"))
