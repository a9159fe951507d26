"""Transcripts and audio levels to scored speech segments.

raw: video_id, ord, start, end, text, no_speech_prob, language; audio: video_id,
sample_idx, amplitude.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom import schema
from streamloom.functions import scalar as S
from streamloom.operators import scans
from streamloom.params import AnyParams
from streamloom.storage import Workspace

LOUDER_DB, MERGE_GAP, FEW_PEAKS, LOUDEST = 6.0, 2, 10, 20
#: Windows of a video that one task scans.
BLOCK_WINDOWS = 4096
GAP_SEC, LARGE_GAP_SEC, BURST_CHARS, BURST_SEC = 3.0, 8.0, 6, 1.5


def audio_levels(audio: DataFrame, samples: int) -> DataFrame:
    """dB of each full window of `samples` samples; partial sums combine before the shuffle."""
    rows = audio.groupBy("video_id", F.floor(F.col("sample_idx") / samples).alias("win_idx")).agg(F.avg(F.col("amplitude") * F.col("amplitude")).alias("power"), F.count("*").alias("n"))
    return rows.where(F.col("n") == samples).select("video_id", "win_idx", (20 * F.log10(F.sqrt("power") + 1e-10)).alias("db"))


def audio_baseline(levels: DataFrame) -> DataFrame:
    """Median dB of each video; no task holds a video's levels."""
    return scans.medians(levels, ["video_id"], "db", "baseline_db")


def _near_peaks(levels: DataFrame, loudest: int) -> tuple[DataFrame, DataFrame]:
    """(loud, other): the loud windows with the start of their island, and the `loudest` windows that are quiet and outside of all peaks.

    A video's windows are scanned in blocks of BLOCK_WINDOWS, of which each
    knows the last loud window before it and the first one after it; other
    windows than these are not kept. Ties for the loudest take the later window.
    """
    ws = Workspace(levels.sparkSession, "peaks")
    levels = ws.table(levels.select("video_id", "win_idx", "db"), "levels")
    known = audio_baseline(levels)
    if loudest:
        rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("db"), F.desc("win_idx")))
        top = levels.withColumn("rank", rank).where(F.col("rank") <= loudest)
        known = known.join(top.groupBy("video_id").agg(F.min(F.struct("db", "win_idx")).alias("least")), "video_id")
    rows = levels.withColumn("block", F.floor(F.col("win_idx") / BLOCK_WINDOWS))
    # what holds for a video goes to its blocks, so that its rows stay apart
    rows = rows.join(rows.select("video_id", "block").distinct().join(known, "video_id"), ["video_id", "block"])
    rows = rows.withColumn("loud", F.col("db") >= F.col("baseline_db") + LOUDER_DB)
    place = F.when(F.col("loud"), F.col("win_idx"))
    rows = scans.running(rows, ["video_id"], "block", ["win_idx"], {"before": (F.max, place)}, {"after": (F.min, place)})
    kept = rows.where(F.col("loud") | (F.struct("db", "win_idx") >= F.col("least")) if loudest else F.col("loud"))
    near = ws.table(kept.select("video_id", "block", "win_idx", "db", "baseline_db", "loud", "before", "after"), "near")

    new = F.col("before").isNull() | (F.col("win_idx") - F.col("before") > MERGE_GAP + 1)
    loud = near.where("loud").withColumn("first", F.when(new, F.col("win_idx")))
    loud = scans.running(loud, ["video_id"], "block", ["win_idx"], {"island": (F.max, F.col("first"))})
    loud = loud.withColumn("island", F.greatest("island", "first"))
    # a stored end is exclusive but compared inclusively
    between = (F.col("after") - F.col("before") <= MERGE_GAP + 1) | (F.col("win_idx") == F.col("before") + 1)
    return loud, near.where(~F.col("loud") & ~F.coalesce(between, F.lit(False)))


def _peaks(rows: DataFrame) -> DataFrame:
    """A peak of the windows of each island."""
    runs = rows.groupBy("video_id", "island").agg(F.min("win_idx").alias("first_win"), F.max("win_idx").alias("last_win"), F.max("db").alias("peak_db"), F.max("baseline_db").alias("baseline_db"))
    return runs.select("video_id", F.col("first_win").cast("double").alias("start"), (F.col("last_win") + 1).cast("double").alias("end"), "peak_db", (F.col("peak_db") - F.col("baseline_db")).alias("db_above_baseline"))


def volume_peaks(levels: DataFrame) -> DataFrame:
    """Runs of loud windows with at most MERGE_GAP quiet ones between two."""
    return _peaks(_near_peaks(levels, 0)[0])


def peaks_with_fallback(levels: DataFrame) -> DataFrame:
    """Where a video has few peaks, its loudest windows outside of them too; each is a peak of its own."""
    loud, other = _near_peaks(levels, LOUDEST)
    counts = loud.where("first IS NOT NULL").groupBy("video_id").agg(F.count("*").alias("peaks"))
    more = other.join(counts, "video_id", "left").where(F.coalesce("peaks", F.lit(0)) < FEW_PEAKS)  # LOUDEST rows a video at most
    return _peaks(loud.unionByName(more.withColumn("island", F.col("win_idx")), allowMissingColumns=True))


def silence_bursts(raw: DataFrame) -> DataFrame:
    """Rows after a silence, found before any row is dropped."""
    over = Window.partitionBy("video_id").orderBy("start", "ord")
    rows = raw.withColumn("gap", F.col("start") - F.lag("end").over(over))
    short = (F.length(S.strip(F.col("text"))) < BURST_CHARS) | (F.col("end") - F.col("start") < BURST_SEC)
    rows = rows.where((F.col("gap") >= GAP_SEC) & ((F.col("gap") >= LARGE_GAP_SEC) | ~short))
    return rows.select("video_id", "ord", "start", "end", S.rounded(F.col("gap"), 2).alias("gap_before_sec"))


def admitted(raw: DataFrame, params: AnyParams) -> DataFrame:
    """Rows long enough and not blank, their text stripped."""
    rows, params = params.of(raw.withColumn("text", S.strip(F.col("text"))))
    return rows.where((F.col("end") - F.col("start") >= params.min_segment_sec) & (F.coalesce("text", F.lit("")) != ""))


def speech_parts(raw: DataFrame, peaks: DataFrame, params: AnyParams) -> DataFrame:
    """Admitted rows with their signals and scores.

    Peaks and segments meet on whole seconds, both ends included, by running
    counts of the peaks that have begun and ended.
    """
    rows, params = params.of(admitted(raw, params))
    seconds = lambda *ids: ["video_id", *ids, F.col("start").cast("bigint").alias("first"), F.col("end").cast("bigint").alias("last")]
    hit = scans.meeting(rows.select(*seconds("ord")), peaks.select(*seconds()), ["video_id"], ["ord"]).withColumn("has_volume", F.lit(True))
    bursts = silence_bursts(raw).select("video_id", S.rounded(F.col("start"), 1).alias("tenth")).distinct().withColumn("has_burst", F.lit(True))
    rows = rows.withColumn("tenth", S.rounded(F.col("start"), 1)).join(hit, ["video_id", "ord"], "left").join(bursts, ["video_id", "tenth"], "left")
    w = {k: F.lit(0.0) for k in schema.SCORE_PARTS} | {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in params.weights.items()}
    flags = {
        "volume_spike": F.coalesce("has_volume", F.lit(False)),
        "laughter": S.laughter(F.col("text")),
        "keyword_hit": S.contains_any(F.col("text"), params.reaction_keywords),
        "silence_then_burst": F.coalesce("has_burst", F.lit(False)),
    }
    rows = rows.withColumns({f"s_{k}": F.when(v, w[k]).otherwise(0.0) for k, v in flags.items()} | {f"f_{k}": v for k, v in flags.items()})
    guess = S.speaker(F.col("language"), F.col("end") - F.col("start"), F.coalesce("no_speech_prob", F.lit(0.0)), params.language_confidence, params.short_sec)
    rows = rows.withColumns({"speaker_guess": guess, "confidence": S.confidence(F.coalesce("no_speech_prob", F.lit(0.0))), "score_total": F.col("s_volume_spike") + F.col("s_laughter") + F.col("s_keyword_hit") + F.col("s_silence_then_burst")})
    reaction = (F.col("f_volume_spike") | F.col("f_laughter") | F.col("f_keyword_hit")) & (F.col("speaker_guess") == "streamer")
    return rows.withColumn("streamer_reaction", reaction)


def speech_segments(raw: DataFrame, peaks: DataFrame, params: AnyParams) -> DataFrame:
    """Timeline rows of speech; seg_ord is the raw order."""
    rows = speech_parts(raw, peaks, params)
    zero = F.lit(0.0)
    parts = {k: F.col(f"s_{k}") for k in ("volume_spike", "laughter", "keyword_hit", "silence_then_burst")}
    return rows.select(
        "video_id",
        F.col("ord").cast("int").alias("seg_ord"),
        F.col("start").alias("time_start"),
        F.col("end").alias("time_end"),
        S.fmt_ts(F.col("start")).alias("time_display"),
        F.lit(None).cast(schema.OCR).alias("ocr"),
        F.struct("text", "speaker_guess", "language", "confidence").cast(schema.ASR).alias("asr"),
        F.lit(None).cast(schema.CHAT).alias("chat"),
        F.lit("unknown").alias("scene_type"),
        F.struct(*(F.coalesce(F.col("streamer_reaction"), F.lit(False)).alias(x) if x == "streamer_reaction" else F.lit(False).alias(x) for x in schema.EVENT_FLAGS)).alias("events"),
        F.struct(F.col("score_total").alias("total"), F.struct(*(parts.get(x, zero).alias(x) for x in schema.SCORE_PARTS)).alias("breakdown")).alias("score"),
        F.struct(F.lit("asr_only").alias("source_type"), F.lit("unverified").alias("match_status"), F.lit(None).cast("string").alias("conflict_note")).alias("merge"),
    )
