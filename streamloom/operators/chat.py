"""Chat messages to windows with spikes and representative messages.

chat: video_id, msg_ord, author, text, type, amount, published_us; durations:
video_id, duration. Windows are sparse: an absent row is an empty window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.functions import scalar as S
from streamloom.functions.scalar import contains_any, offset_sec, published_us
from streamloom.params import PAID, AnyParams, Channels, Params


def parsed(raw: DataFrame) -> DataFrame:
    """Raw chat rows with their time in microseconds."""
    return raw.withColumn("published_us", published_us(F.col("timestamp_ms"))).drop("timestamp_ms")


def stream_anchor(chat: DataFrame) -> DataFrame:
    """A2: (video_id, start_us): the time of the first message in input order, 0 where unknown."""
    return chat.groupBy("video_id").agg(F.coalesce(F.min_by("published_us", "msg_ord"), F.lit(0)).cast("bigint").alias("start_us"))


def chat_offsets(chat: DataFrame) -> DataFrame:
    """chat with offset_sec."""
    return chat.join(stream_anchor(chat), "video_id").withColumn("offset_sec", offset_sec(F.col("published_us"), F.col("start_us"))).drop("start_us")


def stream_durations(segments: DataFrame) -> DataFrame:
    """A1: (video_id, duration) of segments with time_end."""
    return segments.groupBy("video_id").agg(F.max("time_end").alias("duration"))


def in_range(chat: DataFrame, durations: DataFrame, params: AnyParams) -> DataFrame:
    """Chat with offset_sec, duration and win_idx, within the windows of its video; indices truncate toward zero."""
    rows, params = params.of(chat_offsets(chat).join(durations, "video_id", "left").withColumn("duration", F.coalesce("duration", F.lit(0.0))))
    w = params.window_sec
    rows = rows.withColumn("win_idx", (F.col("offset_sec") / w).cast("bigint"))
    return rows.where((F.col("win_idx") >= 0) & (F.col("win_idx") < F.greatest(F.lit(1).cast("bigint"), (F.col("duration") / w).cast("bigint") + 1)))


def chat_windows(chat: DataFrame, durations: DataFrame, params: AnyParams) -> DataFrame:
    """A3-A5: counts, density, baseline and spike of each non-empty window.

    Counting combines before the shuffle; only windows are summed per video.
    """
    return _windows(in_range(chat, durations, params), params)


def _windows(rows: DataFrame, params: AnyParams) -> DataFrame:
    counts = rows.groupBy("video_id", "win_idx").agg(F.count("*").alias("message_count"), F.count_if(F.col("type").isin(*PAID)).alias("superchat_count"), F.max("duration").alias("duration"))
    baseline = F.when(F.col("duration") > 0, F.sum("message_count").over(Window.partitionBy("video_id")) / (F.col("duration") / 60)).otherwise(0.0)
    counts, params = params.of(counts.withColumn("_baseline", baseline))
    w = params.window_sec
    counts = counts.withColumn("_density", F.col("message_count") / (w / 60))
    return counts.select(
        "video_id",
        "win_idx",
        (F.col("win_idx") * w).alias("time_start"),
        ((F.col("win_idx") + 1) * w).alias("time_end"),
        "message_count",
        "superchat_count",
        S.rounded(F.col("_density"), 1).alias("density_per_min"),
        S.rounded(F.col("_baseline"), 1).alias("baseline_per_min"),
        (F.col("_density") > F.col("_baseline") * params.spike_threshold).alias("is_spike"),
    )


def kept_messages(chat: DataFrame, durations: DataFrame, params: AnyParams) -> DataFrame:
    """The messages that stand for their window, with kept_rank.

    All paid ones, up to N with a keyword, and others only while fewer than N
    are kept. Ranks are taken within (video, window, class).
    """
    return _kept(in_range(chat, durations, params), params)


def _kept(rows: DataFrame, params: AnyParams) -> DataFrame:
    rows, params = params.of(rows)
    n = F.lit(params.max_messages) if isinstance(params, Params) else params.max_messages
    rows = rows.withColumn("class", F.when(F.col("type").isin(*PAID), 0).when(contains_any(F.col("text"), params.reaction_keywords), 1).otherwise(2))
    window, order = ["video_id", "win_idx"], ["offset_sec", "msg_ord"]
    whole = Window.partitionBy(*window)
    rows = rows.withColumns({"rank": F.row_number().over(Window.partitionBy(*window, "class").orderBy(*order)), "paid": F.count_if(F.col("class") == 0).over(whole), "keyed": F.count_if(F.col("class") == 1).over(whole)})
    left = n - F.col("paid") - F.least(n, F.col("keyed"))
    rows = rows.where((F.col("class") == 0) | (F.col("class") == 1) & (F.col("rank") <= n) | (F.col("class") == 2) & (F.col("rank") <= left))
    kept_rank = F.row_number().over(Window.partitionBy(*window).orderBy("class", "rank"))
    return rows.withColumn("kept_rank", kept_rank).select("video_id", "win_idx", "kept_rank", "msg_ord", "author", "text", "type", "amount")


def windows_with_messages(chat: DataFrame, durations: DataFrame, params: AnyParams) -> DataFrame:
    """Windows with their representative messages, in order."""
    rows = in_range(chat, durations, params)
    message = F.struct("kept_rank", F.struct("author", "text", "type", "amount").alias("m"))
    kept = _kept(rows, params).groupBy("video_id", "win_idx").agg(F.transform(F.array_sort(F.collect_list(message)), lambda x: x["m"]).alias("messages"))
    return _windows(rows, params).join(kept, ["video_id", "win_idx"])


def run_summary(windows: DataFrame) -> DataFrame:
    """Messages, windows and spikes of each video."""
    return windows.groupBy("video_id").agg(F.sum("message_count").alias("messages"), F.count("*").alias("windows"), F.count_if("is_spike").alias("spikes"))


def spikes_by_channel(chat: DataFrame, durations: DataFrame, channels: DataFrame, params: Params) -> DataFrame:
    """Windows that spike by their channel's threshold; channels: video_id, spike_threshold (null: the default)."""
    own = Channels(channels.select("video_id", "spike_threshold"), params)
    rows, by_row = own.of(chat_windows(chat, durations, own).where("is_spike"))
    return rows.select("video_id", "win_idx", "message_count", by_row.spike_threshold.alias("spike_threshold"))
