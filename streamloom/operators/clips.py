"""Highlights of a timeline and the manifest of their clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.functions import scalar as S
from streamloom.operators import scans
from streamloom.params import AnyParams

#: Seconds of a video whose intervals one task scans.
BLOCK_SEC = 1 << 12


def highlights(timeline: DataFrame, params: AnyParams) -> DataFrame:
    """The rows of the highest scores of at least min_score."""
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score.total"), "seg_ord"))
    timeline, params = params.of(timeline)
    rows = timeline.where(F.col("score.total") >= params.min_score).withColumn("rank", rank).where(F.col("rank") <= params.top_n)
    return rows.select("video_id", "seg_ord", "rank", "time_start", "time_end", F.col("score.total").alias("score"))


def with_intervals(rows: DataFrame, params: AnyParams) -> DataFrame:
    """Rows with the number of their merged interval, by start.

    Intervals merge while the next one starts within the gap of the running
    end, so a row's interval is the count of breaks before it. Running ends and
    counts are scanned in blocks of time, so no task holds a video.
    """
    rows, params = params.of(rows)
    pad, gap = params.clip_padding_sec, params.clip_gap_sec
    rows = rows.withColumns({"clip_start": F.greatest(F.lit(0.0), F.col("time_start") - pad), "clip_end": F.col("time_end") + pad})
    rows = rows.withColumn("_block", F.floor(F.col("clip_start") / BLOCK_SEC))
    scanned = lambda rows, scan: scans.running(rows, ["video_id"], "_block", ["clip_start", "clip_end", "seg_ord"], scan)
    rows = scanned(rows, {"_before": (F.max, F.col("clip_end"))})
    rows = rows.withColumn("_new", F.when(F.col("clip_start") <= F.col("_before") + gap, 0).otherwise(1))
    rows = scanned(rows, {"_breaks": (F.sum, F.col("_new"))})
    clip = F.coalesce("_breaks", F.lit(0)) + F.col("_new")
    return rows.withColumn("clip", clip.cast("int")).drop("_block", "_before", "_new", "_breaks", "_own")


def merged_intervals(rows: DataFrame, params: AnyParams) -> DataFrame:
    return with_intervals(rows, params).groupBy("video_id", "clip").agg(F.min("clip_start").alias("start"), F.max("clip_end").alias("end"))


def clip_manifest(timeline: DataFrame, params: AnyParams) -> DataFrame:
    """A row for each clip with its name, duration, best score and segments."""
    rows = with_intervals(highlights(timeline, params), params)
    clips = rows.groupBy("video_id", F.col("clip").alias("n")).agg(F.min("clip_start").alias("start"), F.max("clip_end").alias("end"), F.max("score").alias("score"), F.count("*").alias("segments"))
    return clips.withColumns({"duration": S.rounded(F.col("end") - F.col("start"), 1), "filename": S.clip_name(F.col("n"), F.col("start"))})


def clip_totals(manifest: DataFrame) -> DataFrame:
    """A17"""
    return manifest.groupBy("video_id").agg(F.count("*").alias("clips"), S.rounded(F.sum("duration"), 6).alias("total_sec"))
