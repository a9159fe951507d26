"""Column types of the tables, and empty layers."""

from __future__ import annotations

MESSAGE = "struct<author:string,text:string,type:string,amount:string>"
OCR = "struct<chapter:string,character:string,dialogue:string,confidence:double,source_frame:bigint>"
ASR = "struct<text:string,speaker_guess:string,language:string,confidence:double>"
CHAT = f"struct<message_count:bigint,messages:array<{MESSAGE}>,superchat_count:bigint,density_per_min:double,baseline_per_min:double,is_spike:boolean>"
EVENT_FLAGS = ("chapter_change", "new_character", "choice_point", "cg_unlock", "streamer_reaction", "chat_spike")
EVENTS = f"struct<{','.join(f'{x}:boolean' for x in EVENT_FLAGS)}>"
SCORE_PARTS = ("volume_spike", "laughter", "keyword_hit", "streamer_reaction", "chat_spike", "silence_then_burst", "speech_rate_change", "repeated_word")
SCORE = f"struct<total:double,breakdown:struct<{','.join(f'{x}:double' for x in SCORE_PARTS)}>>"
MERGE = "struct<source_type:string,match_status:string,conflict_note:string>"

TIMELINE = f"video_id bigint, seg_ord int, time_start double, time_end double, time_display string, ocr {OCR}, asr {ASR}, chat {CHAT}, scene_type string, events {EVENTS}, score {SCORE}, merge {MERGE}"
TIMELINE_COLUMNS = ("video_id", "seg_ord", "time_start", "time_end", "time_display", "ocr", "asr", "chat", "scene_type", "events", "score", "merge")

CHAT_RAW = "author string, text string, timestamp_ms string, type string, amount string"
ASR_RAW = "start double, end double, text string, no_speech_prob double, language string"
OCR_RAW = "chapter string, name string, dialogue string, frame_time double, frame_index bigint"
CHAT_PAGE = (
    "items array<struct<snippet:struct<displayMessage:string,publishedAt:string,type:string,"
    "superChatDetails:struct<amountDisplayString:string>,superStickerDetails:struct<amountDisplayString:string>>,"
    "authorDetails:struct<displayName:string>>>, nextPageToken string"
)
