"""On-screen text: sampled frames to rows, rows to segments.

raw: video_id, ord, chapter, name, dialogue, frame_time, frame_index; frames:
video_id, frame_ord, frame_index, phash, dialogue_text, name_text, chapter_text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom import schema
from streamloom.functions import scalar as S
from streamloom.operators import scans
from streamloom.params import AnyParams

UNSIGNED = (1 << 64) - 1
#: Frames of a video that one task scans.
BLOCK_FRAMES = 1 << 16


def with_durations(raw: DataFrame, params: AnyParams) -> DataFrame:
    """time_end is the next row's start; a default follows a long gap and the last row."""
    ahead = F.lead("frame_time").over(Window.partitionBy("video_id").orderBy("ord"))
    raw, params = params.of(raw.withColumn("ahead", ahead))
    start, ahead = F.col("frame_time"), F.col("ahead")
    end = F.when(ahead.isNull() | (ahead - start > params.max_duration_sec), start + params.default_duration_sec).otherwise(ahead)
    return raw.withColumns({"time_start": start, "time_end": end}).drop("ahead", "_own")


def first_seen(raw: DataFrame) -> DataFrame:
    """chapter_change and new_character on the first row that has the value."""
    def first(c: str):
        return (F.coalesce(F.col(c), F.lit("")) != "") & (F.row_number().over(Window.partitionBy("video_id", c).orderBy("ord")) == 1)

    return raw.withColumns({"chapter_change": first("chapter"), "new_character": first("name")})


def screen_segments(raw: DataFrame, params: AnyParams) -> DataFrame:
    """Timeline rows of on-screen text; seg_ord is the raw order."""
    rows, params = params.of(first_seen(with_durations(raw, params)))
    dialogue = F.coalesce("dialogue", F.lit(""))
    choice, cg = S.story_flags(dialogue, params.story_keywords)
    flags = {"chapter_change": F.col("chapter_change"), "new_character": F.col("new_character"), "choice_point": choice, "cg_unlock": cg}
    return rows.select(
        "video_id",
        F.col("ord").cast("int").alias("seg_ord"),
        "time_start",
        "time_end",
        S.fmt_ts(F.col("time_start")).alias("time_display"),
        F.struct(F.nullif("chapter", F.lit("")).alias("chapter"), F.nullif("name", F.lit("")).alias("character"), dialogue.alias("dialogue"), F.lit(0.9).alias("confidence"), F.col("frame_index").alias("source_frame")).cast(schema.OCR).alias("ocr"),
        F.lit(None).cast(schema.ASR).alias("asr"),
        F.lit(None).cast(schema.CHAT).alias("chat"),
        F.lit("unknown").alias("scene_type"),
        F.struct(*(flags.get(x, F.lit(False)).alias(x) for x in schema.EVENT_FLAGS)).alias("events"),
        F.struct(F.lit(0.0).alias("total"), F.struct(*(F.lit(0.0).alias(x) for x in schema.SCORE_PARTS)).alias("breakdown")).alias("score"),
        F.struct(F.lit("ocr_only").alias("source_type"), F.lit("unverified").alias("match_status"), F.lit(None).cast("string").alias("conflict_note")).alias("merge"),
    )


def sampled_frames(frames: DataFrame, fps: float, params: AnyParams) -> DataFrame:
    """Every step-th frame."""
    rows, params = params.of(frames)
    interval = params.sample_interval_sec
    step = F.greatest(F.lit(1).cast("bigint"), (F.lit(float(fps)) * interval).cast("bigint"))
    return rows.where(F.col("frame_index") % step == 0).select(*frames.columns)


def _in_stretches(frames: DataFrame, distance: Column) -> DataFrame:
    """frames with stretch: the place of the last frame so far that begins a run whatever came before.

    A frame is within the distance of its run's anchor, so one that differs by
    more than twice the distance from the frame before it differs by more than
    the distance from that frame's anchor: it is an anchor itself. So is one
    without a hash, and the one after it. Frames are scanned in blocks.
    """
    place, order = F.struct("frame_index", "frame_ord"), ["frame_index", "frame_ord"]
    rows = frames.withColumn("_block", F.floor(F.col("frame_index") / BLOCK_FRAMES))
    rows = scans.running(rows, ["video_id"], "_block", order, {"_prior": (F.max, F.struct("frame_index", "frame_ord", "phash"))})
    far = F.bit_count(F.col("phash").bitwiseXOR(F.col("_prior.phash"))) > 2 * distance
    rows = rows.withColumn("_cut", F.when(F.coalesce(far, F.lit(True)), place))
    rows = scans.running(rows, ["video_id"], "_block", order, {"stretch": (F.max, F.col("_cut"))})
    return rows.withColumn("stretch", F.greatest("stretch", "_cut")).drop("_block", "_prior", "_cut")


def stable_frames(frames: DataFrame, params: AnyParams) -> DataFrame:
    """The anchor frame of each run of like hashes that lasts long enough.

    A frame is held against its run's anchor, not its neighbour, so the runs
    are a fold in frame order: a step that needs Python. Runs never cross a
    frame that is an anchor for certain, so the stretches between such frames
    are dealt out, many of them within one video. The fold streams over sorted
    partitions and holds one batch and one anchor. A frame without a hash is
    like no other.
    """
    rows, own = params.of(frames)
    number = lambda v: v if isinstance(v, Column) else F.lit(v)
    rows = rows.select(*frames.columns, number(own.hash_distance).cast("int").alias("_distance"), number(own.stable_frames).cast("int").alias("_stable"))
    rows = _in_stretches(rows, F.col("_distance"))
    rows = rows.select(*frames.columns, "_distance", "_stable", F.col("stretch.frame_index").alias("_first"), F.col("stretch.frame_ord").alias("_nth"))
    names = ("video_id", "_first", "_nth", "phash", "_distance", "_stable")
    at, width = [rows.columns.index(c) for c in names], len(frames.columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier, stretch, held, count = None, None, None, 0
        for batch in batches:
            own = batch.select(range(width))
            # -1: the anchor is the row of an earlier batch
            anchor, fired = -1, []
            for k, (*here, value, distance, stable) in enumerate(zip(*(batch.column(i).to_pylist() for i in at), strict=True)):
                like = count > 0 and here == stretch and None not in (value, held) and ((value ^ held) & UNSIGNED).bit_count() <= distance
                if like:
                    count += 1
                else:
                    anchor, stretch, held, count = k, here, value, 1
                if count == stable and anchor < 0:
                    yield earlier
                elif count == stable:
                    fired.append(anchor)
            if anchor >= 0:
                earlier = own.slice(anchor, 1)
            yield own.take(pa.array(fired, pa.int64()))

    return rows.repartition("video_id", "_first", "_nth").sortWithinPartitions("video_id", "_first", "_nth", "frame_index", "frame_ord").mapInArrow(fold, frames.schema)


def collapsed_reveals(frames: DataFrame) -> DataFrame:
    """Texts that extend the one before become one row, with the first frame's place, name and chapter.

    Frames of one index stand in the order of frame_ord.
    """
    place = F.struct("frame_index", "frame_ord")
    over = Window.partitionBy("video_id").orderBy("frame_index", "frame_ord")
    rows = frames.where(F.coalesce("dialogue_text", F.lit("")) != "").withColumn("before", F.lag("dialogue_text").over(over))
    rows = rows.withColumn("new", F.when(F.startswith("dialogue_text", "before"), 0).otherwise(1)).withColumn("run", F.sum("new").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = lambda c: F.min_by(c, place)
    return rows.groupBy("video_id", "run").agg(
        (F.max("run") - 1).alias("ord"),
        first("chapter_text").alias("chapter"),
        first("name_text").alias("name"),
        F.max_by("dialogue_text", place).alias("dialogue"),
        F.min("frame_index").alias("frame_index"),
    ).drop("run")


def rows_of_frames(frames: DataFrame, fps: float, params: AnyParams) -> DataFrame:
    """Frames to raw rows."""
    rows = collapsed_reveals(stable_frames(sampled_frames(frames, fps, params), params))
    return rows.select("video_id", "ord", "chapter", "name", "dialogue", (F.col("frame_index") / fps).alias("frame_time"), "frame_index")
