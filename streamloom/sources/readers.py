"""Sources and sinks: saved chat pages, raw caches, timelines, transcripts and subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from streamloom import schema
from streamloom.functions.scalar import fmt_ts
from streamloom.params import Params
from streamloom.sources.files import folder, read_files, write_files


#: Lines of a text that one file holds.
TEXT_LINES = 1_000_000
#: The keys of texts.
TEXT_KEYS = ("track", "video_id")


def _video_of(path: Column) -> Column:
    """The number of a .../video_id=N/... folder, or of a file's stem."""
    found = F.regexp_extract(path, r"(?:video_id=|/)(\d+)(?:/[^/]*|\.[a-z]+)$", 1)
    return F.nullif(found, F.lit("")).try_cast("bigint")


def parse_chat_pages(pages: DataFrame) -> DataFrame:
    """(video_id, page_ord, items) to raw chat rows in the order of pages and items."""
    rows = pages.select("video_id", "page_ord", F.posexplode("items").alias("item_ord", "item"))
    kind, snippet = F.col("item.snippet.type"), "item.snippet."
    return rows.select(
        "video_id",
        "page_ord",
        "item_ord",
        F.coalesce("item.authorDetails.displayName", F.lit("")).alias("author"),
        F.coalesce(snippet + "displayMessage", F.lit("")).alias("text"),
        F.coalesce(snippet + "publishedAt", F.lit("")).alias("timestamp_ms"),
        F.when(kind == "superChatEvent", "superchat").when(kind == "superStickerEvent", "super_sticker").otherwise("normal").alias("type"),
        F.when(kind == "superChatEvent", F.col(snippet + "superChatDetails.amountDisplayString")).when(kind == "superStickerEvent", F.col(snippet + "superStickerDetails.amountDisplayString")).alias("amount"),
    )


def read_chat_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved page files, one page a file, in the order of their names."""
    pages = spark.read.schema(schema.CHAT_PAGE).json(path, multiLine=True)
    pages = pages.withColumn("file", F.col("_metadata.file_path"))
    return parse_chat_pages(pages.select(_video_of(F.col("file")).alias("video_id"), F.col("file").alias("page_ord"), "items"))


def read_raw(spark: SparkSession, path: str, ddl: str, files: DataFrame | None = None) -> DataFrame:
    """JSON arrays of raw rows, a file for each video; `ord` is the place in the array.

    files, as write_raw returns them, spare the driver a listing.
    """
    return _of_arrays(spark, path, ddl, files).select("video_id", "ord", *(f"`{c.split()[0]}`" for c in ddl.split(", ")))


def _of_arrays(spark: SparkSession, path: str, ddl: str, files: DataFrame | None) -> DataFrame:
    """The objects of JSON arrays with video_id, file and ord, their place in the file's array."""
    if files is not None:
        kind = "array<struct<" + ", ".join("{}: {}".format(*c.split(" ", 1)) for c in ddl.split(", ")) + ">>"
        rows = read_files(files, path).select(F.concat(F.lit(f"{path}/"), "file").alias("file"), F.posexplode(F.from_json("value", kind)).alias("ord", "_row"))
        return rows.select("file", "ord", _video_of(F.col("file")).alias("video_id"), "_row.*")
    rows = spark.read.schema(ddl).option("recursiveFileLookup", "true").json(path, multiLine=True)
    rows = rows.withColumns({"file": F.col("_metadata.file_path"), "_place": F.monotonically_increasing_id()})
    place = F.row_number().over(Window.partitionBy("file").orderBy("_place")) - 1
    return rows.withColumns({"ord": place, "video_id": _video_of(F.col("file"))}).drop("_place")


def _write_arrays(rows: DataFrame, path: str, order: str, nulls: bool) -> DataFrame:
    """The rows of each video as the lines of one JSON array, in order; no video is gathered into one value."""
    over = Window.partitionBy("video_id").orderBy(order)
    row = F.to_json(F.struct(*(c for c in rows.columns if c not in ("video_id", order))), {"ignoreNullFields": str(not nulls).lower()})
    first, last = F.lag(F.lit(1)).over(over).isNull(), F.lead(F.lit(1)).over(over).isNull()
    lines = rows.select("video_id", F.col(order).alias("_order"), F.concat(F.when(first, "[").otherwise(","), row, F.when(last, "]").otherwise("")).alias("value"))
    return write_files(lines, path, F.concat(folder("video_id"), F.lit("/part-00000.txt")), ["_order"], F.col("value"))


def write_raw(rows: DataFrame, path: str, order: str) -> DataFrame:
    """Raw rows as a JSON array for each video, in the order of a column; the names of the files."""
    return _write_arrays(rows, path, order, nulls=True)


def write_timeline(timeline: DataFrame, path: str) -> DataFrame:
    """JSON rows in a folder and a file for each video, in order; absent layers are omitted; the names of the files."""
    row = F.to_json(F.struct(*(c for c in timeline.columns if c != "video_id")))
    return write_files(timeline, path, F.concat(folder("video_id"), F.lit("/part-00000.json")), ["seg_ord"], row)


def write_timeline_arrays(timeline: DataFrame, path: str) -> DataFrame:
    """Each video's timeline as one JSON array, without video_id and seg_ord; absent layers are omitted; the names of the files."""
    return _write_arrays(timeline, path, "seg_ord", nulls=False)


def read_timeline_arrays(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """Timelines that are one JSON array each, indented or not, with defaults for what is missing.

    seg_ord is the place in the array, video_id the number in the file's path
    or, where there is none, a hash of its folder. files, as
    write_timeline_arrays returns them, spare the driver a listing.
    """
    rows = _of_arrays(spark, path, ", ".join(c for c in schema.TIMELINE.split(", ") if c.split()[0] not in ("video_id", "seg_ord")), files)
    folder = F.xxhash64(F.regexp_extract("file", "^(.*)/[^/]*$", 1))
    rows = rows.withColumns({"video_id": F.coalesce("video_id", folder), "seg_ord": F.col("ord").cast("int")})
    return with_defaults(rows).select(*schema.TIMELINE_COLUMNS)


def read_timeline(spark: SparkSession, path: str, strict: bool = False, files: DataFrame | None = None) -> DataFrame:
    """Timeline rows with defaults for what is missing; strict fails on malformed rows.

    files, as write_timeline returns them, spare the driver a listing.
    """
    mode = "FAILFAST" if strict else "PERMISSIVE"
    if files is None:
        return with_defaults(spark.read.schema(schema.TIMELINE).json(path, mode=mode))
    rows = read_files(files, path, by_line=True)
    rows = rows.select(_video_of(F.concat(F.lit(f"{path}/"), "file")).alias("_video"), F.from_json("value", schema.TIMELINE, {"mode": mode}).alias("_row"))
    rows = rows.select(F.coalesce("_video", "_row.video_id").alias("video_id"), *(f"_row.{c}" for c in schema.TIMELINE_COLUMNS if c != "video_id"))
    return with_defaults(rows)


def with_defaults(rows: DataFrame) -> DataFrame:
    flags = F.struct(*(F.coalesce(F.col(f"events.{x}"), F.lit(False)).alias(x) for x in schema.EVENT_FLAGS))
    parts = F.struct(*(F.coalesce(F.col(f"score.breakdown.{x}"), F.lit(0.0)).alias(x) for x in schema.SCORE_PARTS))
    return rows.withColumns(
        {
            "time_display": F.coalesce(F.nullif("time_display", F.lit("")), fmt_ts(F.col("time_start"))),
            "scene_type": F.coalesce("scene_type", F.lit("unknown")),
            "events": flags,
            "score": F.struct(F.coalesce("score.total", F.lit(0.0)).alias("total"), parts.alias("breakdown")),
            "merge": F.struct(F.coalesce("merge.source_type", F.lit("asr_only")).alias("source_type"), F.coalesce("merge.match_status", F.lit("unverified")).alias("match_status"), F.col("merge.conflict_note").alias("conflict_note")),
        }
    )


def newest_timeline(files: DataFrame) -> DataFrame:
    """(root, path, modified) to the timeline of each root: root/timeline.json, else the newest root/*/timeline.json."""
    below = F.regexp_replace(F.substring("path", F.length("root") + F.lit(1), F.length("path")), "^/", "")
    rank = F.when(below == "timeline.json", 2).when(below.rlike("^[^/]+/timeline[.]json$"), 1)
    return files.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("root").agg(F.max_by("path", F.struct("rank", "modified", "path")).alias("path"))


def read_newest_timeline(spark: SparkSession, root: str) -> DataFrame:
    """The newest timeline under a root, read; it is an error if there is none."""
    found = newest_timeline(list_timelines(spark, root)).first()
    if found is None:
        raise FileNotFoundError(f"no timeline.json under {root}")
    return read_timeline_arrays(spark, found.path)


def list_timelines(spark: SparkSession, root: str) -> DataFrame:
    """The timeline files under a root, as (root, path, modified)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "timeline.json").load(root)
    return files.select(F.lit(root.rstrip("/")).alias("root"), F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("modificationTime").alias("modified"))


#: fixed values: where each parameter stands in a channel's file.
PARAM_PATHS = {
    "channel": "channel.name",
    "window_sec": "chat.aggregate_window_sec",
    "spike_threshold": "chat.spike_threshold",
    "max_messages": "chat.max_messages_per_segment",
    "min_segment_sec": "asr.min_segment_sec",
    "short_sec": "asr.short_utterance_sec",
    "language_confidence": "asr.language_confidence_threshold",
    "sample_interval_sec": "ocr.sample_interval_sec",
    "hash_distance": "ocr.hash_diff_threshold",
    "stable_frames": "ocr.stable_threshold",
    "default_duration_sec": "ocr.default_duration_sec",
    "max_duration_sec": "ocr.max_dialogue_duration_sec",
    "overlap_ratio": "alignment.overlap_ratio_threshold",
    "consistent": "alignment.edit_distance_consistent",
    "readback": "alignment.edit_distance_readback",
    "weights": "highlight.weights",
    "top_n": "highlight.top_n",
    "min_score": "highlight.min_score",
    "clip_padding_sec": "highlight.clip_padding_sec",
    "clip_gap_sec": "highlight.clip_merge_gap_sec",
    "reaction_keywords": "keywords.reaction",
    "story_keywords": "keywords.story",
}


def _kind(default: object) -> str:
    kinds = {str: "string", int: "int", float: "double", dict: "map<string,double>", tuple: "array<string>"}
    return kinds[type(default)]


def with_param_defaults(channels: DataFrame) -> DataFrame:
    """A row for each channel, with the default of each parameter that is missing or null, weight by weight."""
    own, out = {c.lower() for c in channels.columns}, {}
    for name, default in vars(Params()).items():
        if isinstance(default, dict):
            standard = F.map_from_arrays(F.array(*map(F.lit, default)), F.array(*map(F.lit, default.values())))
            if name in own:
                given = F.coalesce(F.col(name), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
                keys = F.map_keys(given)
                standard = F.map_concat(F.map_filter(standard, lambda k, _: ~F.array_contains(keys, k)), given)  # noqa: B023
            out[name] = standard
            continue
        standard = F.array(*map(F.lit, default)).cast("array<string>") if isinstance(default, tuple) else F.lit(default)
        out[name] = F.coalesce(F.col(name), standard) if name in own else standard
    return channels.withColumns(out)


def read_channel_params(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object for each channel, with video_id, defaults applied.

    Parameters stand in the sections of PARAM_PATHS, or by their own names at
    the top; weights are a map and keywords arrays.
    """
    kinds = {name: _kind(default) for name, default in vars(Params()).items()}
    sections: dict[str, list[str]] = {}
    for name, place in list(PARAM_PATHS.items())[1:]:
        sections.setdefault(place.split(".")[0], []).append(f"{place.split('.')[1]}:{kinds[name]}")
    flat = [f"{name} {kind}" for name, kind in kinds.items() if name not in sections]
    ddl = ", ".join(["video_id bigint", *flat, *(f"{s} struct<{','.join(own)}>" for s, own in sections.items())])
    rows = spark.read.schema(ddl).json(path, multiLine=not path.endswith("l"))
    # a channel is a name or a section, which reads as its text
    own = {name: F.coalesce(F.col(place), F.col(name)) for name, place in list(PARAM_PATHS.items())[1:]}
    own["channel"] = F.when(F.startswith("channel", F.lit("{")), F.get_json_object("channel", "$.name")).otherwise(F.col("channel"))
    return with_param_defaults(rows.select("video_id", *(own.get(name, F.col(name)).alias(name) for name in kinds)))


def params_of(row: Row) -> Params:
    """One channel's parameters, for plans that run on a channel."""
    known = vars(Params())
    return Params(**{k: tuple(v) if isinstance(known[k], tuple) else v for k, v in row.asDict().items() if k in known and v is not None})


def write_lines(rows: DataFrame, path: str, keys: list[str], order: str, value: str) -> DataFrame:
    """A text for each value of keys, whose lines are value in the order of a column that counts them; the names of the files.

    Lines are written as they come: no text is gathered, and one of more than
    TEXT_LINES lines lies in several files, in the order of their names.
    """
    rows = rows.withColumn("_part", F.floor(F.col(order) / TEXT_LINES).cast("bigint"))
    return write_files(rows, path, F.concat(folder(*keys), F.format_string("/part-%05d.txt", "_part")), [order], F.col(value))


def read_texts(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """The files of write_lines, each as one value, without the last line's end.

    files, as write_lines returns them, spare the driver a listing; the keys
    are strings then, and null where a folder has another key.
    """
    if files is None:
        rows = spark.read.text(path, wholetext=True)
    else:
        own = lambda c: F.nullif(F.nullif(F.url_decode(F.regexp_extract("file", f"(?:^|/){c}=([^/]*)/", 1)), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit(""))
        rows = read_files(files, path).select("value", *(own(c).alias(c) for c in TEXT_KEYS))
    return rows.withColumn("value", F.regexp_replace("value", r"\n\z", ""))


def write_youtube(lines: DataFrame, path: str) -> DataFrame:
    """(video_id, n, line) as one text for each video."""
    return write_lines(lines, path, ["video_id"], "n", "line")


def write_subtitles(blocks: DataFrame, path: str) -> DataFrame:
    """(track, video_id, n, block) as one text for each track and video."""
    return write_lines(blocks, path, ["track", "video_id"], "n", "block")
