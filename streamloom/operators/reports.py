"""Report tables of a timeline: statistics, conflicts, the index and the transcript sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.functions import scalar as S
from streamloom.operators import scans

KINDS = ("opening", "chapter", "debut", "chat", "reaction")
TOP_REACTIONS = 10


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def character_stats(timeline: DataFrame) -> DataFrame:
    """Lines, first and last time and total duration of each character, most lines first."""
    rows = timeline.where(_filled("ocr.character")).groupBy("video_id", F.col("ocr.character").alias("character")).agg(
        F.count("*").alias("lines"),
        F.min("time_start").alias("first_time"),
        F.max("time_end").alias("last_time"),
        F.sum(F.col("time_end") - F.col("time_start")).alias("duration"),
        F.min("seg_ord").alias("first_ord"),
    )
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("lines"), "first_ord"))
    return rows.select("video_id", rank.alias("rank"), "character", "lines", "first_time", "last_time", S.rounded(F.col("duration"), 6).alias("duration"), S.fmt_duration(S.rounded(F.col("duration"), 6)).alias("duration_text"))


def character_totals(timeline: DataFrame) -> DataFrame:
    """A12"""
    return character_stats(timeline).groupBy("video_id").agg(F.count("*").alias("characters"), F.sum("lines").alias("lines"))


def scene_distribution(timeline: DataFrame) -> DataFrame:
    """A10: rows and percentage of each scene type."""
    rows = timeline.groupBy("video_id", "scene_type").agg(F.count("*").alias("n"))
    return rows.withColumn("percent", S.rounded(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("video_id")), 6))


def time_overview(timeline: DataFrame) -> DataFrame:
    """From the first row's start to the last row's end."""
    rows = timeline.groupBy("video_id").agg(F.min_by("time_start", "seg_ord").alias("first_time"), F.max_by("time_end", "seg_ord").alias("last_time"), F.count("*").alias("segments"), S.rounded(F.avg(F.col("time_end") - F.col("time_start")), 6).alias("mean_sec"))
    return rows.withColumn("duration", S.rounded(F.col("last_time") - F.col("first_time"), 6)).withColumn("duration_text", S.fmt_duration(F.col("duration")))


def conflict_summary(timeline: DataFrame) -> DataFrame:
    """A13"""
    status = lambda x: F.count_if(F.col("merge.match_status") == x).alias(x.removesuffix("_possible"))
    rows = timeline.groupBy("video_id").agg(F.count("*").alias("segments"), F.count_if(F.col("merge.source_type") == "ocr_asr").alias("ocr_asr"), status("consistent"), status("conflict"), status("readback_possible"), status("unverified"))
    return rows.withColumn("consistency", S.rounded(F.try_divide("consistent", "ocr_asr"), 6))


def conflict_rows(timeline: DataFrame) -> DataFrame:
    """Conflicts in order with both texts, a suggestion and the note."""
    rows = timeline.where(F.col("merge.match_status") == "conflict")
    rows = rows.withColumn("suggested", S.resolution(F.col("ocr.dialogue"), F.col("asr.text")))
    rows = scans.with_numbers(rows, ["video_id"], F.floor(F.col("seg_ord") / scans.SPAN), ["seg_ord"], "n")
    return rows.select("video_id", "n", S.fmt_ts(F.col("time_start")).alias("at"), F.col("ocr.dialogue").alias("ocr_text"), F.col("asr.text").alias("asr_text"), F.col("suggested.code").alias("suggestion"), F.col("suggested.wrong").alias("wrong"), F.col("suggested.right").alias("right"), F.col("merge.conflict_note").alias("note"))


def chapter_transitions(timeline: DataFrame) -> DataFrame:
    """Rows whose chapter differs from the last one named; no task holds a video."""
    rows = timeline.select("video_id", "seg_ord", "time_start", F.col("ocr.chapter").alias("chapter")).where(_filled("chapter"))
    rows = rows.withColumn("_block", F.floor(F.col("seg_ord") / scans.SPAN))
    rows = scans.running(rows, ["video_id"], "_block", ["seg_ord"], {"_before": (F.max, F.struct("seg_ord", "chapter"))})
    return rows.where(~F.col("chapter").eqNullSafe(F.col("_before.chapter"))).drop("_block", "_before")


def debuts(timeline: DataFrame) -> DataFrame:
    """The first row of each character."""
    rows = timeline.withColumn("character", F.col("ocr.character")).where(_filled("character"))
    first = F.row_number().over(Window.partitionBy("video_id", "character").orderBy("seg_ord"))
    return rows.withColumn("nth", first).where("nth = 1").select("video_id", "seg_ord", "time_start", "character")


def opening(timeline: DataFrame) -> DataFrame:
    """The first row with the streamer's speech."""
    rows = timeline.where(F.col("asr.speaker_guess") == "streamer")
    return rows.groupBy("video_id").agg(F.min_by("time_start", "seg_ord").alias("time_start"), F.min("seg_ord").alias("seg_ord"))


def _spike_summary(density: Column, baseline: Column, paid: Column) -> Column:
    return F.concat(S.half_even(density), F.lit(" msgs/min, mean "), S.half_even(baseline), F.when(paid > 0, F.concat(F.lit(", SC x"), paid.cast("string"))).otherwise(""))


def _reaction_summary(text: Column, total: Column) -> Column:
    return F.concat(F.coalesce(S.preview(text, 30), F.lit("")), F.lit(" (score: "), S.half_even(total), F.lit(")"))


def spike_events(timeline: DataFrame) -> DataFrame:
    """Chat spikes with rounded density and baseline, and their paid messages."""
    summary = _spike_summary(F.col("chat.density_per_min"), F.col("chat.baseline_per_min"), F.col("chat.superchat_count"))
    return timeline.where(F.col("events.chat_spike") & F.col("chat").isNotNull()).select("video_id", "seg_ord", "time_start", summary.alias("summary"))


def reaction_events(timeline: DataFrame, top: int = TOP_REACTIONS) -> DataFrame:
    """The highest scores with a preview of the speech."""
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score.total"), "seg_ord"))
    rows = timeline.where(F.col("score.total") > 0).withColumn("rank", rank).where(F.col("rank") <= top)
    return rows.select("video_id", "seg_ord", "rank", "time_start", _reaction_summary(F.col("asr.text"), F.col("score.total")).alias("summary"))


def index_events(timeline: DataFrame) -> DataFrame:
    """All events in time order, the first of each kind in a display second.

    Kinds rank as in KINDS; within a kind rows come in time order, reactions by
    their score. The timeline is read once: windows mark what each row is, and
    its events are unfolded together.
    """
    video = Window.partitionBy("video_id")
    so_far = video.orderBy("seg_ord").rowsBetween(Window.unboundedPreceding, -1)
    streamer, density = F.coalesce(F.col("asr.speaker_guess") == "streamer", F.lit(False)), F.col("chat.density_per_min")
    rows = timeline.select(
        "video_id",
        "seg_ord",
        "time_start",
        streamer.alias("streamer"),
        F.nullif("ocr.chapter", F.lit("")).alias("chapter"),
        F.nullif("ocr.character", F.lit("")).alias("character"),
        F.col("score.total").alias("total"),
        F.when(F.col("events.chat_spike") & F.col("chat").isNotNull(), _spike_summary(density, F.col("chat.baseline_per_min"), F.col("chat.superchat_count"))).alias("spike"),
        F.when(F.col("score.total") > 0, _reaction_summary(F.col("asr.text"), F.col("score.total"))).alias("reaction"),
    )
    rows = rows.withColumns(
        {
            "opens": F.col("streamer") & (F.coalesce(F.sum(F.col("streamer").cast("int")).over(so_far), F.lit(0)) == 0),
            "before": F.last("chapter", ignorenulls=True).over(so_far),
            "rank": F.row_number().over(video.orderBy(F.desc_nulls_last("total"), "seg_ord")),
            "debut": F.col("character").isNotNull() & (F.row_number().over(Window.partitionBy("video_id", "character").orderBy("seg_ord")) == 1),
        }
    )
    event = lambda k, holds, place, summary: F.when(holds, F.struct(F.lit(k).alias("kind_rank"), F.lit(KINDS[k]).alias("kind"), F.col(place).cast("bigint").alias("in_kind"), summary.alias("summary")))
    events = F.array(
        event(0, F.col("opens"), "seg_ord", F.lit("streamer opens")),
        event(1, F.col("chapter").isNotNull() & ~F.col("chapter").eqNullSafe(F.col("before")), "seg_ord", F.col("chapter")),
        event(2, F.col("debut"), "seg_ord", F.concat(F.col("character"), F.lit(" appears"))),
        event(3, F.col("spike").isNotNull(), "seg_ord", F.col("spike")),
        event(4, F.col("reaction").isNotNull() & (F.col("rank") <= TOP_REACTIONS), "rank", F.col("reaction")),
    )
    rows = rows.select("video_id", "time_start", S.fmt_ts(F.col("time_start")).alias("at"), F.inline(F.filter(events, lambda x: x.isNotNull())))
    order = ["time_start", "kind_rank", "in_kind"]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("video_id", "at", "kind").orderBy(*order))).where("nth = 1")
    n = F.row_number().over(Window.partitionBy("video_id").orderBy(*order))
    return rows.select("video_id", n.alias("n"), "time_start", "at", "kind", "summary")


def youtube_chapters(timeline: DataFrame) -> DataFrame:
    """U4: a line for each event."""
    return index_events(timeline).select("video_id", "n", F.concat(S.youtube_time(F.col("time_start")), F.lit(" "), F.col("summary")).alias("line"))


def transcript_sheet(timeline: DataFrame) -> DataFrame:
    """Eleven columns for reading, and a mark for the row; a conflict's overrides a spike's."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    conflict, spike = F.col("merge.match_status") == "conflict", F.col("events.chat_spike")
    score = F.col("score.total")
    return timeline.select(
        "video_id",
        "seg_ord",
        S.fmt_ts(F.col("time_start")).alias("at"),
        empty("ocr.chapter").alias("chapter"),
        empty("ocr.character").alias("character"),
        empty("ocr.dialogue").alias("ocr_text"),
        empty("asr.text").alias("asr_text"),
        empty("asr.speaker_guess").alias("speaker"),
        F.when(F.col("chat").isNull(), "").otherwise(F.concat(S.half_even(F.col("chat.density_per_min")), F.lit("/min"))).alias("density"),
        F.when(F.col("chat.superchat_count") > 0, F.col("chat.superchat_count").cast("string")).otherwise("").alias("superchats"),
        F.when(F.col("events.streamer_reaction") | spike, "Y").otherwise("").alias("reaction"),
        F.col("merge.match_status").alias("match_status"),
        F.when(score > 0, score).alias("score"),
        F.when(conflict, "conflict").when(spike, "spike").otherwise("").alias("row_mark"),
    )
