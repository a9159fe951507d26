"""The views that queries read, derived from the given tables; each as DuckDB SQL that also gives Spark's."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamloom import schema
from streamloom.functions import scalar as S
from streamloom.storage import Workspace

FX_CHAT = """
select user_id video_id, event_id msg_ord, concat('user', cast(event_id % 97 as varchar)) author,
  concat(event_type, ' ', props) text,
  case when event_type='purchase' and value>=40 then 'superchat'
       when event_type='signup' and value>=60 then 'super_sticker' else 'normal' end type,
  case when (event_type='purchase' and value>=40) or (event_type='signup' and value>=60)
       then concat('US$', cast(cast(floor(value) as int) as varchar)) end amount,
  1704067200000000 + (epoch_us(ts) - 1704067200000000) // 12960 published_us
from events
"""
FX_ASR = r"""
with t as (select conv_id video_id, turn, role, regexp_replace(text,'[^\x00-\x7F]','?','g') text,
             length(text) n from conversations),
u as (select *, 300+n*20 dur_ms, (n*977)%20000 gap_ms from t),
w as (select *, cast(sum(gap_ms+dur_ms) over (partition by video_id order by turn) as bigint) end_ms from u)
select video_id, turn, (end_ms-dur_ms)/1000.0::double "start", end_ms/1000.0::double "end", text,
  (n%10)/10.0::double no_speech_prob,
  case role when 'user' then 'zh' when 'assistant' then 'ja' else 'en' end language
from w
"""
FX_OCR = """
select video_id, turn ord, concat('Chapter ', cast(turn // 3 as varchar)) chapter,
  case when (video_id+turn)%4=3 then '' else concat('char', cast((video_id+turn)%3 as varchar)) end name,
  case (video_id*7+turn)%4 when 0 then text when 1 then replace(text,'q','g')
       when 2 then reverse(text) else concat(substring(text,1,20),' CG') end dialogue,
  "start" + ((video_id+turn)%5)*0.5::double frame_time,
  cast(floor(("start" + ((video_id+turn)%5)*0.5::double)*30) as bigint) frame_index
from fx_asr where (video_id*5+turn)%6 <> 0
"""
FX_AUDIO = """
select video_id, sample_idx,
  amplitude * case when case when video_id%3=0 then sample_idx//10%5=0 else sample_idx//10%23 in (0,1,4,8) end then 1.0::double else 0.2::double end amplitude
from (
  select l_suppkey video_id,
    row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice)-1 sample_idx,
    l_quantity/50.0::double amplitude
  from lineitem)
"""
FX_TIMELINE = """
select a.video_id, a.turn seg_ord, a."start" time_start, a."end" time_end, o.chapter,
  nullif(o.name,'') as character_name, o.dialogue, o.frame_index source_frame, a.text asr_text, a.language,
  case a.language when 'zh' then 'streamer' when 'ja' then 'game_voice' else 'unknown' end speaker_guess,
  case when (a.video_id+a.turn)%3=0 then 6.0::double*(1+(a.video_id*13+a.turn)%9) end density_per_min,
  case when (a.video_id+a.turn)%3=0 then 21.5::double end baseline_per_min,
  case when (a.video_id+a.turn)%3=0 then (a.video_id+a.turn*2)%4 else 0 end superchat_count,
  coalesce((a.video_id+a.turn)%3=0 and 6*(1+(a.video_id*13+a.turn)%9)>40, false) chat_spike,
  coalesce(a.turn%3=0 and o.dialogue is not null, false) chapter_change,
  coalesce((a.video_id+a.turn)%11=0 and o.dialogue is not null, false) choice_point,
  5.0::double*((a.video_id*3+a.turn*7)%14) score_total,
  case when o.dialogue is null then 'asr_only' else 'ocr_asr' end source_type,
  case when o.dialogue is null then 'unverified' when (a.video_id*7+a.turn)%4=0 then 'consistent'
       when (a.video_id*7+a.turn)%4=1 then 'readback_possible' else 'conflict' end match_status
from fx_asr a left join fx_ocr o on a.video_id=o.video_id and a.turn=o.ord
"""
FX_FRAMES = """
select video_id, turn*30+k frame_ord, cast(floor("start"*30) as bigint)+k*15 frame_index,
  substring(text,1,(1+k//2)*8) dialogue_text, concat('char', cast((video_id+turn)%3 as varchar)) name_text,
  concat('Chapter ', cast(turn//3 as varchar)) chapter_text,
  (turn*7919 + video_id*104729 + (k//2)*(k//2)*2047 + k%2) % 65536 phash
from fx_asr cross join (values (0),(1),(2),(3),(4),(5),(6),(7)) kk(k)
"""
VIEWS = {"fx_chat": FX_CHAT, "fx_asr": FX_ASR, "fx_ocr": FX_OCR, "fx_audio": FX_AUDIO, "fx_timeline": FX_TIMELINE, "fx_frames": FX_FRAMES}
SOURCES = ("events", "conversations", "lineitem")


def duck(*names: str) -> str:
    """A WITH clause of views and of those they read."""
    wanted = [v for v in VIEWS if v in names or v == "fx_asr" and set(names) & {"fx_ocr", "fx_timeline", "fx_frames"} or v == "fx_ocr" and "fx_timeline" in names]
    return "with " + ",\n".join(f"{v} as ({VIEWS[v].strip()})" for v in wanted)


def _spark(sql: str) -> str:
    sql = sql.replace("cross join (values (0),(1),(2),(3),(4),(5),(6),(7)) kk(k)", "lateral view explode(array(0,1,2,3,4,5,6,7)) kk as k")
    sql = re.sub(r"(\d+\.\d+)::double", r"\1D", sql).replace("::double", "D").replace("//", " div ").replace("varchar", "string").replace("epoch_us(ts)", "unix_micros(cast(ts as timestamp))")
    sql = sql.replace('"start"', "`start`").replace('"end"', "`end`").replace("\\", "\\\\")
    sql = re.sub(r"(regexp_replace\([^)]*),'g'\)", r"\1)", sql)
    return re.sub(rf"\bfrom ({'|'.join([*VIEWS, *SOURCES])})\b|\bjoin ({'|'.join(VIEWS)})\b", lambda m: f"{m[0].split()[0]} {{{m[1] or m[2]}}}", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of a folder."""
    if name in SOURCES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _spark(VIEWS[name])
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql))})


_written: dict[tuple[str, str], DataFrame] = {}


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline of a folder's tables, built and written once in a program, as one is before it is searched."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _written:
        _written[key] = Workspace(spark, "timelines").table(built_timeline(spark, sf_dir), "timeline")
    return _written[key]


def built_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_timeline in the timeline's schema; chat messages are the first ten of the video."""
    rows, c = view(spark, sf_dir, "fx_timeline"), F.col
    first = view(spark, sf_dir, "fx_chat")
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("video_id").orderBy("msg_ord"))).where("nth <= 10")
    first = first.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.struct("author", "text", "type", "amount").alias("m")))), lambda x: x["m"]).alias("messages"))
    rows = rows.join(first, "video_id", "left")
    flag = {"chapter_change": c("chapter_change"), "choice_point": c("choice_point"), "chat_spike": c("chat_spike"), "streamer_reaction": (c("speaker_guess") == "streamer") & (c("score_total") >= 50)}
    return rows.select(
        "video_id",
        c("seg_ord").cast("int").alias("seg_ord"),
        "time_start",
        "time_end",
        S.fmt_ts(c("time_start")).alias("time_display"),
        F.when(c("dialogue").isNotNull(), F.struct("chapter", c("character_name").alias("character"), "dialogue", F.lit(0.9).alias("confidence"), "source_frame")).cast(schema.OCR).alias("ocr"),
        F.struct(c("asr_text").alias("text"), "speaker_guess", "language", F.lit(None).cast("double").alias("confidence")).cast(schema.ASR).alias("asr"),
        F.when(c("density_per_min").isNotNull(), F.struct(F.lit(1).cast("bigint").alias("message_count"), "messages", "superchat_count", "density_per_min", "baseline_per_min", c("chat_spike").alias("is_spike"))).cast(schema.CHAT).alias("chat"),
        F.lit("unknown").alias("scene_type"),
        F.struct(*(flag.get(x, F.lit(False)).alias(x) for x in schema.EVENT_FLAGS)).alias("events"),
        F.struct(c("score_total").alias("total"), F.struct(*(F.lit(0.0).alias(x) for x in schema.SCORE_PARTS)).alias("breakdown")).alias("score"),
        F.struct("source_type", "match_status", F.when(c("match_status") == "conflict", S.conflict_note(c("dialogue"), c("asr_text"))).alias("conflict_note")).alias("merge"),
    )


def raw_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_asr").withColumnRenamed("turn", "ord")
