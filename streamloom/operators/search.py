"""Queries over a timeline, all within each video."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.functions import scalar as S


def by_character(timeline: DataFrame, name: str) -> DataFrame:
    """R1"""
    return timeline.where(F.contains(F.coalesce("ocr.character", F.lit("")), F.lit(name)) & (F.coalesce("ocr.character", F.lit("")) != ""))


def by_keyword(timeline: DataFrame, word: str) -> DataFrame:
    """R2: in the dialogue or the speech."""
    return timeline.where(S.contains_any(F.col("ocr.dialogue"), (word,)) | S.contains_any(F.col("asr.text"), (word,)))


def top_reactions(timeline: DataFrame, top: int = 10) -> DataFrame:
    """The highest scores above 0, with their rank and the count of scored segments."""
    scored = timeline.where(F.col("score.total") > 0)
    counts = scored.groupBy("video_id").agg(F.count("*").alias("scored"))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score.total"), "seg_ord"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).join(counts, "video_id")


def chapters(timeline: DataFrame) -> DataFrame:
    """Chapters in the order they come up, with first time and size."""
    named = timeline.withColumn("chapter", F.col("ocr.chapter")).where(F.coalesce("chapter", F.lit("")) != "")
    rows = named.groupBy("video_id", "chapter").agg(F.min_by("time_start", "seg_ord").alias("first_time"), F.min("seg_ord").alias("first_ord"), F.count("*").alias("segments"))
    return rows.select("video_id", F.row_number().over(Window.partitionBy("video_id").orderBy("first_ord")).alias("n"), "chapter", S.fmt_ts(F.col("first_time")).alias("first_seen"), "segments")


def by_chapter(timeline: DataFrame, name: str) -> DataFrame:
    """R5"""
    return timeline.where((F.coalesce("ocr.chapter", F.lit("")) != "") & F.contains("ocr.chapter", F.lit(name)))


def conflicts(timeline: DataFrame) -> DataFrame:
    """Conflicts with previews of both texts."""
    return timeline.where(F.col("merge.match_status") == "conflict").select("video_id", "seg_ord", S.fmt_ts(F.col("time_start")).alias("at"), F.substring(F.nullif("ocr.dialogue", F.lit("")), 1, 40).alias("ocr_text"), F.substring(F.nullif("asr.text", F.lit("")), 1, 40).alias("asr_text"))


def superchats(timeline: DataFrame) -> DataFrame:
    """Segments with paid messages, and a row for each kept one of type superchat."""
    rows = timeline.where(F.col("chat.superchat_count") > 0)
    paid = F.filter("chat.messages", lambda m: m["type"] == "superchat")
    rows = rows.select("video_id", "seg_ord", S.fmt_ts(F.col("time_start")).alias("at"), F.col("chat.superchat_count").alias("superchat_count"), F.posexplode_outer(paid).alias("message_ord", "m"))
    return rows.select("video_id", "seg_ord", "at", "superchat_count", "message_ord", F.col("m.author").alias("author"), F.substring("m.text", 1, 40).alias("text"), F.col("m.amount").alias("amount"))


def lines(rows: DataFrame, scored: bool = False) -> DataFrame:
    """(video_id, seg_ord, line)."""
    return rows.select("video_id", "seg_ord", S.display_line(scored).alias("line"))
