"""Scalar functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from streamloom.params import CG_MARK, CHOICE_MARKS, CONFUSABLE, LAUGHTER, SUBTITLED


#: Multiplying by this and subtracting again leaves a double's upper half.
SPLIT = float((1 << 27) + 1)


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits: the nearest one to its exact binary value, of two equally near ones the even one.

    Where x times the power of ten comes out halfway, the product's own error,
    from the halves of x, tells on which side the exact product lies.
    """
    if not digits:
        return F.rint(x)
    scale = float(10**digits)
    product, high, below = x * scale, x * SPLIT - (x * SPLIT - x), F.floor(x * scale).cast("double")
    error = (high * scale - product) + (x - high) * scale
    up = F.when(error > 0, 1.0).when(error < 0, 0.0).otherwise(F.abs(below % 2))
    return F.when(product - below == 0.5, below + up).otherwise(F.rint(product)) / scale


def fmt_ts(sec: Column) -> Column:
    """HH:MM:SS, truncated; hours are not capped."""
    s = F.floor(sec).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def fmt_srt(sec: Column) -> Column:
    """HH:MM:SS,mmm; negatives count as 0, milliseconds are truncated."""
    x = F.greatest(F.lit(0.0), sec)
    return F.concat(fmt_ts(x), F.format_string(",%03d", ((x % 1) * 1000).cast("int")))


def fmt_duration(sec: Column) -> Column:
    """42s, 3m05s, 3m, 1h02m."""
    whole = F.floor(sec).cast("bigint")
    minutes, seconds = F.floor(whole / 60), whole % 60
    return (
        F.when(sec < 60, F.concat(rounded(sec, 0).cast("bigint").cast("string"), F.lit("s")))
        .when(minutes >= 60, F.format_string("%dh%02dm", F.floor(minutes / 60), minutes % 60))
        .when(seconds == 0, F.format_string("%dm", minutes))
        .otherwise(F.format_string("%dm%02ds", minutes, seconds))
    )


def offset_sec(published_us: Column, start_us: Column) -> Column:
    """seconds since the start; 0 where either is unknown."""
    return F.coalesce((published_us - F.coalesce(start_us, F.lit(0))) / 1e6, F.lit(0.0))


def published_us(published: Column) -> Column:
    """Microseconds of an ISO-8601 string; null if blank or malformed."""
    return F.unix_micros(F.try_to_timestamp(F.nullif(published, F.lit(""))))


def edit_ratio(a: Column, b: Column) -> Column:
    """edit distance by code points over the longer length."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when(x == y, 0.0).when((x == "") | (y == ""), 1.0).otherwise(F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """overlap over the shorter duration; 0 if that is not positive."""
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / shorter)


def contains_any(text: Column, keywords: tuple[str, ...] | Column) -> Column:
    """whether text holds any keyword, by case and literally."""
    if isinstance(keywords, Column):
        return F.coalesce(F.exists(keywords, lambda k: F.contains(text, k)), F.lit(False))
    return F.coalesce(reduce(lambda a, b: a | b, (F.contains(text, F.lit(k)) for k in keywords), F.lit(False)), F.lit(False))


def laughter(text: Column) -> Column:
    """F8"""
    return contains_any(F.lower(text), LAUGHTER)


def speaker(language: Column, duration: Column, no_speech: Column, confidence: float | Column, short: float | Column) -> Column:
    """unknown if short and unsure, else by language."""
    return F.when((duration < short) & (1 - no_speech < confidence), "unknown").when(language == "zh", "streamer").when(language == "ja", "game_voice").otherwise("unknown")


def confidence(no_speech: Column) -> Column:
    """F10"""
    return rounded(1 - no_speech, 3)


def match_status(ocr_text: Column, asr_text: Column, guess: Column, consistent: float | Column, readback: float | Column) -> Column:
    """readback is tested first, both strictly."""
    return status_of(edit_ratio(ocr_text, asr_text), guess, consistent, readback)


def status_of(ratio: Column, guess: Column, consistent: float | Column, readback: float | Column) -> Column:
    """F11 of an edit ratio that is already known; it is named twice."""
    return F.when((ratio < readback) & F.coalesce(guess == "game_voice", F.lit(False)), "readback_possible").when(ratio < consistent, "consistent").otherwise("conflict")


def conflict_note(ocr_text: Column, asr_text: Column) -> Column:
    """F12"""
    return F.concat(F.lit("OCR: "), F.substring(ocr_text, 1, 50), F.lit(" | ASR: "), F.substring(asr_text, 1, 50))


def _has(x: Column) -> Column:
    return F.coalesce(x != "", F.lit(False))


def _set(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def scene_type(dialogue: Column, character: Column, asr_text: Column, guess: Column, choice: Column, chapter_change: Column, spike: Column) -> Column:
    """the first scene that fits; never unknown."""
    shown, spoken = _has(dialogue), _has(asr_text)
    return (
        F.when(_set(choice), "choice")
        .when(_set(chapter_change) & ~shown, "transition")
        .when(shown & _has(character), "dialogue")
        .when(shown, "narration")
        .when(spoken & _set(guess == "game_voice"), "narration")
        .when(spoken, "reaction")
        .when(_set(spike), "reaction")
        .otherwise("silence")
    )


def resolution(ocr_text: Column, asr_text: Column) -> Column:
    """a code for what the texts of a conflict suggest, and the glyphs of a confusable pair."""
    x, y = F.coalesce(ocr_text, F.lit("")), F.coalesce(asr_text, F.lit(""))
    ratio = F.length(x) / F.nullif(F.length(y), F.lit(0))
    both = (x != "") & (y != "")
    pair = F.lit(None).cast("struct<wrong:string,right:string>")
    for wrong, right in reversed(CONFUSABLE):
        pair = F.when(F.contains(x, F.lit(wrong)) & F.contains(y, F.lit(right)), F.struct(F.lit(wrong).alias("wrong"), F.lit(right).alias("right"))).otherwise(pair)
    code = (
        F.when(ocr_text.isNull() & asr_text.isNull(), "")
        .when(asr_text.isNull(), "ocr_only")
        .when(ocr_text.isNull(), "asr_only")
        .when(both & (ratio > 3), "asr_missed")
        .when(both & (ratio < 0.3), "ocr_partial")
        .when(pair.isNotNull(), "prefer_asr")
        .otherwise("manual")
    )
    return F.struct(code.alias("code"), F.when(code == "prefer_asr", pair["wrong"]).alias("wrong"), F.when(code == "prefer_asr", pair["right"]).alias("right"))


def original_text(dialogue: Column, character: Column, asr_text: Column, guess: Column, named: bool = True) -> Column:
    """the dialogue, led by its character in brackets, else a game voice's text."""
    shown = F.concat(F.when(_has(character), F.concat(F.lit("【"), character, F.lit("】"))).otherwise(""), dialogue) if named else dialogue
    return F.when(_has(dialogue), shown).when(_has(asr_text) & _set(guess == "game_voice"), asr_text)


def streamer_text(asr_text: Column, guess: Column) -> Column:
    return F.when(_has(asr_text) & _set(guess.isin(*SUBTITLED)), asr_text)


def srt_block(n: Column, start: Column, end: Column, text: Column) -> Column:
    """F16: number, times and text, with a line break at the end."""
    return F.concat(n.cast("string"), F.lit("\n"), fmt_srt(start), F.lit(" --> "), fmt_srt(end), F.lit("\n"), text, F.lit("\n"))


def preview(text: Column, n: int, mark: str = "...") -> Column:
    """F17"""
    return F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, mark).otherwise(""))


def half_even(x: Column) -> Column:
    """A number rounded half to even, as text."""
    return rounded(x, 0).cast("bigint").cast("string")


def display_line(scored: bool = False) -> Column:
    """a timeline row as one line of text."""
    part = lambda shown, *text: F.when(shown, F.concat(*(F.lit(t) if isinstance(t, str) else t for t in text)))
    parts = [
        F.concat(F.lit("["), fmt_ts(F.col("time_start")), F.lit("]")),
        part(_has(F.col("ocr.character")), "【", F.col("ocr.character"), "】"),
        part(_has(F.col("ocr.dialogue")), "OCR: ", preview(F.col("ocr.dialogue"), 60)),
        part(_has(F.col("asr.text")), "ASR: ", preview(F.col("asr.text"), 60)),
        part(_set(F.col("chat.is_spike")), "Chat: ", half_even(F.col("chat.density_per_min")), "/min"),
    ]
    if scored:
        parts.append(part(F.col("score.total") > 0, "(score: ", half_even(F.col("score.total")), ")"))
    return F.concat_ws("  ", *parts, F.concat(F.lit("["), F.col("merge.source_type"), F.lit("]")))


def youtube_time(sec: Column) -> Column:
    """F19"""
    return F.regexp_replace(fmt_ts(sec), "^00:", "")


def story_flags(dialogue: Column, keywords: tuple[str, ...] | Column) -> tuple[Column, Column]:
    """(choice_point, cg_unlock) by the first configured keyword that the dialogue holds."""
    if isinstance(keywords, Column):
        first = F.get(F.filter(keywords, lambda k: F.contains(dialogue, k)), 0)
        return contains_any(first, CHOICE_MARKS), contains_any(first, (CG_MARK,))
    if not keywords:
        return F.lit(False), F.lit(False)
    first = F.coalesce(*(F.when(F.contains(dialogue, F.lit(k)), F.lit(k)) for k in keywords))
    return contains_any(first, CHOICE_MARKS), contains_any(first, (CG_MARK,))


def clip_name(n: Column, start: Column) -> Column:
    """F21"""
    return F.concat(F.format_string("clip_%03d_", n), F.replace(fmt_ts(start), F.lit(":"), F.lit("")), F.lit(".mp4"))


def strip(text: Column) -> Column:
    """without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def run_key(stem: Column) -> Column:
    """A short hash of a file's stem and its first characters that are safe in paths."""
    return F.concat(F.substring(F.md5(stem), 1, 8), F.lit("_"), F.translate(F.substring(stem, 1, 20), '\\/:*?"<>|', ""))


def default_title(title: Column, channel: Column, stem: Column) -> Column:
    """The given title, else channel in brackets and stem, else stem."""
    return F.coalesce(F.nullif(title, F.lit("")), F.when(_has(channel), F.concat(F.lit("【"), channel, F.lit("】"), stem)), stem)
