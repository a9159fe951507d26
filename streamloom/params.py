"""Parameters with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: markers, keywords and glyph pairs that results depend on
LAUGHTER = ("www", "ｗｗ", "草", "笑", "hhh", "ww")
CONFUSABLE = (("伺", "何"), ("巳", "己"), ("已", "己"), ("末", "未"), ("士", "土"), ("壺", "壷"))
CHOICE_MARKS, CG_MARK = ("選択", "分岐"), "CG"
PAID = ("superchat", "super_sticker")
SUBTITLED = ("streamer", "mixed")


@dataclass(frozen=True)
class Params:
    """One channel's parameters; the defaults are fixed values."""

    channel: str = ""
    window_sec: float = 10.0
    spike_threshold: float = 2.5
    max_messages: int = 5
    overlay_messages: int = 10
    min_segment_sec: float = 0.5
    short_sec: float = 2.0
    language_confidence: float = 0.7
    default_duration_sec: float = 4.0
    max_duration_sec: float = 12.0
    sample_interval_sec: float = 0.5
    stable_frames: int = 2
    hash_distance: int = 4
    overlap_ratio: float = 0.3
    consistent: float = 0.2
    readback: float = 0.15
    weights: dict[str, float] = field(default_factory=lambda: {"volume_spike": 15.0, "laughter": 20.0, "keyword_hit": 20.0, "chat_spike": 25.0, "silence_then_burst": 10.0})
    reaction_keywords: tuple[str, ...] = ()
    story_keywords: tuple[str, ...] = ()
    min_score: float = 15.0
    top_n: int = 30
    clip_padding_sec: float = 3.0
    clip_gap_sec: float = 2.0
    title: str = ""

    def of(self, rows: DataFrame) -> tuple[DataFrame, Params]:
        """Rows, and the parameters that hold for them: the same ones for all."""
        return rows, self


class Channels:
    """Parameters by row: those of each video's channel, defaults where they are missing or null.

    table has one row for each video, and a second one is an error: video_id and columns named as the fields of
    Params, any of them; weights is a map, keywords are arrays. Operators take it
    in the place of Params, and read columns where those hold numbers.
    """

    def __init__(self, table: DataFrame, default: Params = Params()):
        self.default = default
        names = [c for c in table.columns if c != "video_id"]
        rows = table.groupBy("video_id").agg(F.collect_list(F.struct(*names, F.lit(True).alias("_"))).alias("own"))
        several = F.raise_error(F.concat(F.lit("several rows of parameters for video "), F.coalesce(F.col("video_id").cast("string"), F.lit("null"))))
        self.table = rows.select("video_id", F.when(F.size("own") > 1, several).otherwise(F.col("own")[0]).alias("_own"))
        self.names = set(names)

    def of(self, rows: DataFrame) -> tuple[DataFrame, _RowParams]:
        """rows with the column _own, and the parameters that it holds."""
        return rows.drop("_own").join(self.table, "video_id", "left"), _RowParams(self)


class _RowParams:
    """The fields of Params as columns of rows that have _own."""

    def __init__(self, channels: Channels):
        self._channels = channels

    def __getattr__(self, name: str) -> Column | dict[str, Column]:
        default = getattr(self._channels.default, name)
        own = F.col(f"_own.{name}") if name in self._channels.names else None
        if isinstance(default, dict):
            return {k: F.lit(float(v)) if own is None else F.coalesce(own[k].cast("double"), F.lit(float(v))) for k, v in default.items()}
        standard = F.array(*map(F.lit, default)).cast("array<string>") if isinstance(default, tuple) else F.lit(default)
        return standard if own is None else F.coalesce(own, standard)


AnyParams = Params | Channels
