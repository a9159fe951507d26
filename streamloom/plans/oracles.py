"""DuckDB SQL for each query of queries.py that SQL can express."""

from __future__ import annotations

import re

from streamloom.params import CONFUSABLE
from streamloom.plans.fixtures import duck

ORACLE_SQL: dict[str, str] = {}


def _ts(x: str) -> str:
    return f"printf('%02d:%02d:%02d', floor({x} / 3600)::bigint, floor({x} % 3600 / 60)::bigint, floor({x})::bigint % 60)"


def _srt(x: str) -> str:
    return f"({_ts(x)} || printf(',%03d', trunc(({x} % 1) * 1000)::int))"


def _round(x: str, n: int) -> str:
    """x to n digits, by its exact binary value: at a halfway product the product's error decides, then evenness."""
    scale = f"1e{n}::double"
    high = "(v * 134217729::double - (v * 134217729::double - v))"
    error = f"({high} * {scale} - v * {scale} + (v - {high}) * {scale})"
    even = f"case when {error} > 0 then ceil(v * {scale}) when {error} < 0 then floor(v * {scale}) else round_even(v * {scale}, 0) end"
    return f"list_transform([{x}], lambda v: case when v * {scale} - floor(v * {scale}) = 0.5::double then {even} else round_even(v * {scale}, 0) end / {scale})[1]"


def _even(x: str) -> str:
    return f"round_even({x}, 0)::bigint::varchar"


def _plain(sql: str) -> str:
    """SQL with each rounded[x; n] written out."""
    return re.sub(r"rounded\[([^;]*); (\d)\]", lambda m: _round(m[1], int(m[2])), sql)


def _add(name: str, views: str, body: str) -> None:
    """views: names that the query starts from; body may go on with common tables."""
    body = _plain(body)
    ORACLE_SQL[name] = f"{duck(*views.split())}{',' if body.lstrip().startswith(('o as', 'w as', 'l as', 's as', 'e as')) else ''}\n{body.strip()}"


_OFFSETS = """o as (
  select c.*, coalesce((published_us - coalesce(a.start_us, 0)) / 1e6::double, 0::double) offset_sec
  from fx_chat c join (select video_id, arg_min(published_us, msg_ord) start_us from fx_chat group by video_id) a using (video_id)),
r as (
  select o.*, coalesce(duration, 0::double) duration, trunc(offset_sec / 10)::bigint win_idx
  from o left join (select video_id, max("end") duration from fx_asr group by video_id) using (video_id)
  where trunc(offset_sec / 10) between 0 and trunc(coalesce(duration, 0::double) / 10)),
c as (
  select video_id, win_idx, count(*) message_count, count(*) filter (type <> 'normal') superchat_count, max(duration) duration
  from r group by video_id, win_idx),
b as (
  select *, case when duration > 0 then sum(message_count) over (partition by video_id) / (duration / 60) else 0 end base,
    message_count / (10 / 60::double) density from c),
wins as (
  select video_id, win_idx, win_idx * 10::double time_start, (win_idx + 1) * 10::double time_end, message_count, superchat_count,
    rounded[density; 1] density_per_min, rounded[base; 1] baseline_per_min, density > base * 1.5::double is_spike
  from b),
k as (
  select *, case when type <> 'normal' then 0 when contains(text, 'error') or contains(text, 'click') then 1 else 2 end class from r),
n as (
  select *, row_number() over (partition by video_id, win_idx, class order by offset_sec, msg_ord) rank,
    count(*) filter (class = 0) over (partition by video_id, win_idx) paid,
    count(*) filter (class = 1) over (partition by video_id, win_idx) keyed from k),
kept as (
  select video_id, win_idx, row_number() over (partition by video_id, win_idx order by class, rank)::int kept_rank, msg_ord, type,
    concat_ws('/', author, text, type, coalesce(amount, '-')) m
  from n where class = 0 or class = 1 and rank <= 5 or class = 2 and rank <= 5 - paid - least(5, keyed)),
msgs as (select video_id, win_idx, list(m order by kept_rank) messages from kept group by video_id, win_idx)
"""
_add("chat_pages_parse", "fx_chat", """select video_id, msg_ord // 2000 page_ord,
  (row_number() over (partition by video_id, msg_ord // 2000 order by msg_ord) - 1)::int item_ord, author, text, type, amount, published_us from fx_chat""")
_add("chat_offsets", "fx_chat fx_asr", _OFFSETS + "select video_id, msg_ord, offset_sec from o")
_add("stream_anchor", "fx_chat", "select video_id, arg_min(published_us, msg_ord) start_us from fx_chat group by video_id")
_add("chat_windows", "fx_chat fx_asr", _OFFSETS + "select video_id, win_idx, time_start, time_end, message_count, superchat_count from wins")
_add("chat_baseline", "fx_chat fx_asr", _OFFSETS + "select distinct video_id, baseline_per_min from wins")
_add("chat_spikes", "fx_chat fx_asr", _OFFSETS + "select video_id, win_idx, message_count, density_per_min, baseline_per_min from wins where is_spike")
_add("chat_run_summary", "fx_chat fx_asr", _OFFSETS + "select video_id, sum(message_count)::bigint messages, count(*) windows, count(*) filter (is_spike) spikes from wins group by video_id")
_add("chat_kept_messages", "fx_chat fx_asr", _OFFSETS + "select video_id, win_idx, kept_rank, msg_ord, type from kept")
_add("spikes_by_channel", "fx_chat fx_asr", _OFFSETS + """select video_id, win_idx, message_count, t spike_threshold
from (select *, case when video_id in (select video_id from fx_asr) and video_id % 2 = 1 then 2.5::double else 1.5::double end t from b) where density > base * t""")

_LEVELS = """l as (
  select video_id, sample_idx // 10 win_idx, 20 * log10(sqrt(avg(amplitude * amplitude)) + 1e-10::double) db
  from fx_audio group by video_id, sample_idx // 10 having count(*) = 10),
m as (select video_id, median(db) base from l group by video_id),
q as (
  select l.*, base, case when win_idx - lag(win_idx) over (partition by video_id order by win_idx) <= 3 then 0 else 1 end fresh
  from l join m using (video_id) where db >= base + 6),
i as (select *, sum(fresh) over (partition by video_id order by win_idx) island from q),
p as (
  select video_id, min(win_idx)::double s, (max(win_idx) + 1)::double e, max(db) peak, max(db) - max(base) above
  from i group by video_id, island),
f as (
  select l.video_id, l.win_idx, db, row_number() over (partition by l.video_id order by db desc, l.win_idx desc) rank from l),
g as (
  select f.video_id, win_idx::double s, win_idx + 1::double e, db peak, db - base above from f join m using (video_id)
  where rank <= 20 and (select count(*) from p where p.video_id = f.video_id) < 10
    and not exists (select 1 from p where p.video_id = f.video_id and f.win_idx between p.s and p.e)),
peaks as (select * from p union all select * from g)
"""
_PEAK = 'select video_id, s "start", e "end", rounded[peak; 6] peak_db, rounded[above; 6] db_above_baseline from '
_add("audio_rms", "fx_audio", _LEVELS + "select video_id, win_idx, rounded[db; 6] db from l")
_add("audio_baseline", "fx_audio", _LEVELS + "select video_id, rounded[base; 6] baseline_db from m")
_add("volume_peaks", "fx_audio", _LEVELS + _PEAK + "p")
_add("peak_fallback", "fx_audio", _LEVELS + _PEAK + "peaks")

_BURSTS = """bursts as (
  select video_id, turn ord, "start", "end", rounded[gap; 2] gap_before_sec
  from (select *, "start" - lag("end") over (partition by video_id order by "start", turn) gap from fx_asr)
  where gap >= 3 and (gap >= 8 or length(trim(text)) >= 6 and "end" - "start" >= 1.5))"""
ORACLE_SQL["silence_bursts"] = duck("fx_asr") + ",\n" + _plain(_BURSTS) + "\nselect * from bursts"

_SPEECH = (
    _LEVELS.rstrip()
    + ",\n"
    + _BURSTS
    + r""",
a as (select * replace (trim(text) as text) from fx_asr where "end" - "start" >= 0.5::double and trim(text) <> ''),
v as (
  select *, exists (select 1 from peaks where peaks.video_id = a.video_id and trunc(peaks.s) <= trunc(a."end") and trunc(peaks.e) >= trunc(a."start")) vol,
    regexp_matches(lower(text), 'www|ｗｗ|草|笑|hhh|ww') laugh, contains(text, 'error') or contains(text, 'click') keyed,
    rounded["start"; 1] in (select rounded["start"; 1] from bursts where bursts.video_id = a.video_id) burst,
    case when "end" - "start" < 2 and 1 - no_speech_prob < 0.7::double then 'unknown' when language = 'zh' then 'streamer' when language = 'ja' then 'game_voice' else 'unknown' end guess
  from a),
speech as (
  select *, case when vol then 15::double else 0 end s1, case when laugh then 20::double else 0 end s2,
    case when keyed then 20::double else 0 end s3, case when burst then 10::double else 0 end s4 from v)
"""
)
_add("asr_segments", "fx_asr fx_audio", _SPEECH + """select video_id, turn ord, "start", "end", text, guess speaker_guess, rounded[1 - no_speech_prob; 3] confidence,
  s1 s_volume_spike, s2 s_laughter, s3 s_keyword_hit, s4 s_silence_then_burst, s1 + s2 + s3 + s4 score_total,
  (vol or laugh or keyed) and guess = 'streamer' streamer_reaction from speech""")

_SCREEN = """s as (
  select *, frame_time time_start, lead(frame_time) over (partition by video_id order by ord) ahead,
    coalesce(chapter, '') <> '' and row_number() over (partition by video_id, chapter order by ord) = 1 chapter_change,
    coalesce(name, '') <> '' and row_number() over (partition by video_id, name order by ord) = 1 new_character,
    coalesce(not contains(dialogue, 'CG') and contains(dialogue, '分岐'), false) choice_point, coalesce(contains(dialogue, 'CG'), false) cg_unlock
  from fx_ocr),
screen as (select *, case when ahead is null or ahead - time_start > 12 then time_start + 4 else ahead end time_end from s)
"""
_add("ocr_durations", "fx_ocr", _SCREEN + "select video_id, ord, time_start, time_end from screen")
_add("first_seen_flags", "fx_ocr", _SCREEN + "select video_id, ord, chapter_change, new_character from screen")
_add("story_flags", "fx_ocr", _SCREEN + "select video_id, ord, choice_point, cg_unlock from screen")
_add("ocr_segments", "fx_ocr", _SCREEN + f"""select video_id, ord::int seg_ord, time_start, time_end, {_ts('time_start')} time_display, nullif(chapter, '') chapter, nullif(name, '') as character, dialogue,
  0.9::double confidence, frame_index source_frame, chapter_change, new_character, choice_point, cg_unlock, 'ocr_only' source_type, 'unverified' match_status from screen""")
_add("frame_sampling", "fx_frames", "select video_id, frame_index from fx_frames where frame_index % 15 = 0")
_REVEALS = """t as (
  select f.*, row(frame_index, frame_ord) place,
    case when starts_with(dialogue_text, lag(dialogue_text) over (partition by video_id order by frame_index, frame_ord)) then 0 else 1 end fresh
  from {source} f where coalesce(dialogue_text, '') <> ''),
u as (select *, sum(fresh) over (partition by video_id order by frame_index, frame_ord rows between unbounded preceding and current row) run from t),
v as (
  select video_id, (run - 1)::bigint ord, arg_min(chapter_text, place) chapter, arg_min(name_text, place) as name, arg_max(dialogue_text, place) dialogue, min(frame_index) frame_index
  from u group by video_id, run)
"""
_add("reveal_collapse", "fx_frames", "s as (select 1),\n" + _REVEALS.format(source="fx_frames") + "select * from v")

_OVERLAY = (
    _OFFSETS.rstrip()
    + ",\n"
    + _SPEECH.rstrip()
    + """,
touch as (
  select p.video_id, p.turn, w.* exclude (video_id), messages from speech p join wins w on w.video_id = p.video_id and w.win_idx between trunc(p."start" / 10) and trunc(p."end" / 10)
  join msgs m on m.video_id = w.video_id and m.win_idx = w.win_idx),
over as (
  select video_id, turn, sum(message_count)::bigint message_count, sum(superchat_count)::bigint superchat_count, max(density_per_min) density_per_min,
    arg_max(baseline_per_min, win_idx) baseline_per_min, bool_or(is_spike) is_spike, array_to_string(flatten(list(messages order by win_idx))[1:10], '|') messages
  from touch group by video_id, turn),
laid as (
  select p.video_id, turn::int seg_ord, "start" time_start, "end" time_end, message_count, superchat_count, density_per_min, baseline_per_min, is_spike, messages,
    coalesce(is_spike, false) chat_spike, s1 + s2 + s3 + s4 + case when is_spike then 25 else 0 end score_total, case when is_spike then 25::double else 0 end chat_score, 'asr_only' source_type
  from speech p left join over using (video_id, turn)),
lone as (
  select video_id, win_idx::int seg_ord, time_start, time_end, message_count, superchat_count, density_per_min, baseline_per_min, is_spike, array_to_string(messages[1:5], '|') messages,
    true chat_spike, 25::double score_total, 25::double chat_score, 'event_only' source_type
  from wins join msgs using (video_id, win_idx)
  where is_spike and not exists (select 1 from speech p where p.video_id = wins.video_id and wins.win_idx between trunc(p."start" / 10) and trunc(p."end" / 10)))
"""
)
_add("overlay_chat", "fx_chat fx_asr fx_audio", _OVERLAY + "select * from laid")
_add("event_only_segments", "fx_chat fx_asr fx_audio", _OVERLAY + "select * from lone")
_add("align_mvp", "fx_chat fx_asr fx_audio", _OVERLAY + """select * replace (row_number() over (partition by video_id order by time_start, case source_type when 'event_only' then 1 else 0 end, seg_ord)::int as seg_ord)
from (select * from laid union all select * from lone)""")

_PAIRS = (
    _SPEECH.rstrip()
    + ",\n"
    + _SCREEN.rstrip()
    + """,
pairs as (
  select p.video_id, p.turn::int seg_ord, x.ord::int ocr_ord, (least(p."end", x.time_end) - greatest(p."start", x.time_start)) / least(p."end" - p."start", x.time_end - x.time_start) ratio,
    x.dialogue, p.text, guess
  from speech p join screen x on x.video_id = p.video_id and least(p."end", x.time_end) > greatest(p."start", x.time_start)),
near as (select * from pairs where ratio >= 0.3::double),
rated as (
  select *, case when dialogue = '' and text = '' then 0 when dialogue = '' or text = '' then 1 else levenshtein(dialogue, text) / greatest(length(dialogue), length(text))::double end r from near),
judged as (select *, case when r < 0.15::double and guess = 'game_voice' then 'readback_possible' when r < 0.2::double then 'consistent' else 'conflict' end status from rated)
"""
)
_add("overlap_candidates", "fx_ocr fx_audio", _PAIRS + "select video_id, seg_ord, ocr_ord, rounded[ratio; 6] ratio from near")
_add("match_status", "fx_ocr fx_audio", _PAIRS + """select video_id, seg_ord, ocr_ord, rounded[r; 6] ratio, status,
  case when status = 'conflict' then concat('OCR: ', substring(dialogue, 1, 50), ' | ASR: ', substring(text, 1, 50)) end note from judged""")

_SCENE = """case when choice_point then 'choice' when chapter_change and coalesce(dialogue, '') = '' then 'transition'
  when coalesce(dialogue, '') <> '' and coalesce(character_name, '') <> '' then 'dialogue' when coalesce(dialogue, '') <> '' then 'narration'
  when coalesce(asr_text, '') <> '' and speaker_guess = 'game_voice' then 'narration' when coalesce(asr_text, '') <> '' or chat_spike then 'reaction' else 'silence' end"""
_add("scene_types", "fx_timeline", f"select video_id, seg_ord::int seg_ord, {_SCENE} scene_type from fx_timeline")
_add("scene_distribution", "fx_timeline", f"""select video_id, scene_type, count(*) n, rounded[count(*) * 100::double / sum(count(*)) over (partition by video_id); 6] percent
from (select *, {_SCENE} scene_type from fx_timeline) group by video_id, scene_type""")


def _line(scored: bool = False) -> str:
    score = f", case when score_total > 0 then '(score: ' || {_even('score_total')} || ')' end" if scored else ""
    shown = lambda c, label: f"case when coalesce({c}, '') <> '' then '{label}: ' || substring({c}, 1, 60) || case when length({c}) > 60 then '...' else '' end end"
    return f"""concat_ws('  ', '[' || {_ts('time_start')} || ']', case when coalesce(character_name, '') <> '' then '【' || character_name || '】' end,
  {shown('dialogue', 'OCR')}, {shown('asr_text', 'ASR')}, case when chat_spike and density_per_min is not null then 'Chat: ' || {_even('density_per_min')} || '/min' end{score}, '[' || source_type || ']')"""


_T = "fx_timeline"
_RANKED = "row_number() over (partition by video_id order by score_total desc, seg_ord)::int"
_add("search_character", _T, f"select video_id, seg_ord::int seg_ord, {_line()} line from fx_timeline where contains(character_name, 'char1')")
_add("search_keyword", _T, f"select video_id, seg_ord::int seg_ord, {_line()} line from fx_timeline where contains(coalesce(dialogue, ''), 'the') or contains(asr_text, 'the')")
_add("top_reactions", _T, f"select video_id, rank, seg_ord, scored, line from (select video_id, {_RANKED} rank, seg_ord::int seg_ord, count(*) over (partition by video_id) scored, {_line(True)} line from fx_timeline where score_total > 0) where rank <= 10")
_add("chapter_list", _T, f"""select video_id, row_number() over (partition by video_id order by min(seg_ord))::int n, chapter, {_ts('arg_min(time_start, seg_ord)')} first_seen, count(*) segments
from fx_timeline where coalesce(chapter, '') <> '' group by video_id, chapter""")
_add("chapter_filter", _T, f"select video_id, seg_ord::int seg_ord, {_line()} line from fx_timeline where contains(chapter, 'Chapter 1')")
_add("search_conflicts", _T, f"select video_id, seg_ord::int seg_ord, {_ts('time_start')} as at, nullif(substring(dialogue, 1, 40), '') ocr_text, nullif(substring(asr_text, 1, 40), '') asr_text from fx_timeline where match_status = 'conflict'")
_add("search_superchats", "fx_timeline fx_chat", f"""e as (select *, row_number() over (partition by video_id order by msg_ord) nth from fx_chat),
p as (select *, (row_number() over (partition by video_id order by msg_ord) - 1)::int message_ord from e where nth <= 10 and type = 'superchat')
select t.video_id, seg_ord::int seg_ord, {_ts('time_start')} as at, superchat_count, message_ord, author, substring(text, 1, 40) text, amount
from fx_timeline t left join p using (video_id) where superchat_count > 0 and density_per_min is not null""")


def _duration(x: str) -> str:
    return f"""case when {x} < 60 then {_even(x)} || 's' when {x} >= 3600 then printf('%dh%02dm', floor({x} / 3600)::bigint, floor({x} / 60)::bigint % 60)
  when floor({x})::bigint % 60 = 0 then printf('%dm', floor({x} / 60)::bigint) else printf('%dm%02ds', floor({x} / 60)::bigint, floor({x})::bigint % 60) end"""


_STATS = f"""s as (select video_id, character_name as character, count(*) as lines, min(time_start) first_time, max(time_end) last_time, rounded[sum(time_end - time_start); 6] duration, min(seg_ord) first_ord
  from fx_timeline where coalesce(character_name, '') <> '' group by video_id, character_name)
"""
_add("character_stats", _T, _STATS + f"select video_id, row_number() over (partition by video_id order by lines desc, first_ord)::int rank, character, lines, first_time, last_time, duration, {_duration('duration')} duration_text from s")
_add("character_totals", _T, _STATS + "select video_id, count(*) characters, sum(lines)::bigint as lines from s group by video_id")
_add("time_overview", _T, f"""s as (select video_id, arg_min(time_start, seg_ord) first_time, arg_max(time_end, seg_ord) last_time, count(*) segments, rounded[avg(time_end - time_start); 6] mean_sec from fx_timeline group by video_id),
t as (select *, rounded[last_time - first_time; 6] duration from s)
select *, {_duration('duration')} duration_text from t""")
_add("conflict_summary", _T, """s as (select video_id, count(*) segments, count(*) filter (source_type = 'ocr_asr') ocr_asr, count(*) filter (match_status = 'consistent') consistent,
  count(*) filter (match_status = 'conflict') conflict, count(*) filter (match_status = 'readback_possible') readback, count(*) filter (match_status = 'unverified') unverified from fx_timeline group by video_id)
select *, case when ocr_asr > 0 then rounded[consistent / ocr_asr::double; 6] end consistency from s""")
_PAIR = " ".join(f"when contains(dialogue, '{a}') and contains(asr_text, '{b}') then ['{a}', '{b}']" for a, b in CONFUSABLE)
_add("conflict_rows", _T, f"""s as (
  select *, case when dialogue <> '' and asr_text <> '' and length(dialogue) / length(asr_text)::double > 3 then 'asr_missed'
    when dialogue <> '' and asr_text <> '' and length(dialogue) / length(asr_text)::double < 0.3::double then 'ocr_partial'
    when case {_PAIR} end is not null then 'prefer_asr' else 'manual' end suggestion, case {_PAIR} end pair
  from fx_timeline where match_status = 'conflict')
select video_id, row_number() over (partition by video_id order by seg_ord)::int n, {_ts('time_start')} as at, dialogue ocr_text, asr_text, suggestion,
  case when suggestion = 'prefer_asr' then pair[1] end wrong, case when suggestion = 'prefer_asr' then pair[2] end as right, concat('OCR: ', substring(dialogue, 1, 50), ' | ASR: ', substring(asr_text, 1, 50)) note
from s""")

_EVENTS = f"""e as (select *, lag(chapter) over (partition by video_id order by seg_ord) before from fx_timeline where coalesce(chapter, '') <> ''),
chapters as (select video_id, seg_ord::int seg_ord, time_start, chapter from e where chapter is distinct from before),
debuts as (select video_id, min(seg_ord)::int seg_ord, arg_min(time_start, seg_ord) time_start, character_name as character from fx_timeline where coalesce(character_name, '') <> '' group by video_id, character_name),
spikes as (select video_id, seg_ord::int seg_ord, time_start, concat({_even('density_per_min')}, ' msgs/min, mean ', {_even('baseline_per_min')}, case when superchat_count > 0 then concat(', SC x', superchat_count) else '' end) summary
  from fx_timeline where chat_spike and density_per_min is not null),
reactions as (select * from (select video_id, seg_ord::int seg_ord, {_RANKED} rank, time_start,
    concat(substring(asr_text, 1, 30), case when length(asr_text) > 30 then '...' else '' end, ' (score: ', {_even('score_total')}, ')') summary from fx_timeline where score_total > 0) where rank <= 10),
opening as (select video_id, min(seg_ord) seg_ord, arg_min(time_start, seg_ord) time_start from fx_timeline where speaker_guess = 'streamer' group by video_id),
every as (
  select video_id, 0 k, 'opening' kind, seg_ord i, time_start, 'streamer opens' summary from opening
  union all select video_id, 1, 'chapter', seg_ord, time_start, chapter from chapters
  union all select video_id, 2, 'debut', seg_ord, time_start, character || ' appears' from debuts
  union all select video_id, 3, 'chat', seg_ord, time_start, summary from spikes
  union all select video_id, 4, 'reaction', rank, time_start, summary from reactions),
firsts as (select * from (select *, {_ts('time_start')} as at, row_number() over (partition by video_id, {_ts('time_start')}, kind order by time_start, k, i) nth from every) where nth = 1),
idx as (select video_id, row_number() over (partition by video_id order by time_start, k, i)::int n, time_start, "at", kind, summary from firsts)
"""
_YT = """concat(case when starts_with("at", '00:') then substring("at", 4) else "at" end, ' ', summary)"""
_add("index_chapters", _T, _EVENTS + "select * from chapters")
_add("index_debuts", _T, _EVENTS + "select * from debuts")
_add("index_spikes", _T, _EVENTS + "select * from spikes")
_add("index_reactions", _T, _EVENTS + "select * from reactions")
_add("index_events", _T, _EVENTS + "select * from idx")
_add("youtube_chapters", _T, _EVENTS + f"select video_id, n, {_YT} line from idx")
_add("youtube_text", _T, _EVENTS + f"select video_id, string_agg({_YT}, chr(10) order by n) as value from idx group by video_id")
_add("transcript_sheet", _T, f"""select video_id, seg_ord::int seg_ord, {_ts('time_start')} as at, case when dialogue is null then '' else coalesce(chapter, '') end chapter, coalesce(character_name, '') as character, coalesce(dialogue, '') ocr_text,
  coalesce(asr_text, '') asr_text, speaker_guess speaker, case when density_per_min is null then '' else {_even('density_per_min')} || '/min' end density,
  case when density_per_min is not null and superchat_count > 0 then superchat_count::varchar else '' end superchats,
  case when speaker_guess = 'streamer' and score_total >= 50 or chat_spike then 'Y' else '' end reaction, match_status, case when score_total > 0 then score_total end score,
  case when match_status = 'conflict' then 'conflict' when chat_spike then 'spike' else '' end row_mark from fx_timeline""")

_TRACKS = f"""s as (
  select *, case when coalesce(dialogue, '') <> '' then concat(case when coalesce(character_name, '') <> '' then '【' || character_name || '】' else '' end, dialogue)
      when asr_text <> '' and speaker_guess = 'game_voice' then asr_text end original,
    case when asr_text <> '' and speaker_guess in ('streamer', 'mixed') then asr_text end streamer from fx_timeline),
u as (
  select 'original' track, video_id, seg_ord, time_start, time_end, original body from s union all select 'streamer', video_id, seg_ord, time_start, time_end, streamer from s
  union all select 'dual', video_id, seg_ord, time_start, time_end, concat_ws(chr(10), original, streamer) from s),
v as (select *, row_number() over (partition by track, video_id order by seg_ord)::int n from u where coalesce(body, '') <> ''),
tracks as (select track, video_id, n, concat(n, chr(10), {_srt('time_start')}, ' --> ', {_srt('time_end')}, chr(10), body, chr(10)) block from v)
"""
for _name in ("original", "streamer", "dual"):
    _add(f"srt_{_name}", _T, _TRACKS + f"select * from tracks where track = '{_name}'")
_add("srt_counts", _T, _TRACKS + "select track, video_id, count(*) subtitles from tracks group by track, video_id")
_add("srt_text", _T, _TRACKS + "select track, video_id, string_agg(block, chr(10) order by n) as value from tracks group by track, video_id")


def _clips(source: str) -> str:
    return f"""e as (select *, greatest(0, time_start - 3) a, time_end + 3 b from {source}),
f as (select *, case when a <= max(b) over (partition by video_id order by a, b, seg_ord rows between unbounded preceding and 1 preceding) + 2 then 0 else 1 end fresh from e),
g as (select *, sum(fresh) over (partition by video_id order by a, b, seg_ord)::int clip from f),
clips as (select video_id, clip n, min(a) s, max(b) t, max(score_total) score, count(*) segments, rounded[max(b) - min(a); 1] duration from g group by video_id, clip)
"""


_HIGH = f"(select * from (select *, {_RANKED} rank from fx_timeline where score_total >= 15) where rank <= 30)"
_add("highlights", _T, f"select video_id, seg_ord::int seg_ord, rank, time_start, time_end, score_total score from {_HIGH}")
_add("merged_intervals", _T, _clips("fx_timeline") + 'select video_id, n clip, s "start", t "end" from clips')
_add("clip_manifest", _T, _clips(_HIGH) + f"""select video_id, n, rounded[s; 6] "start", rounded[t; 6] "end", duration, score, segments, printf('clip_%03d_', n) || replace({_ts('s')}, ':', '') || '.mp4' filename from clips""")
_add("clip_totals", _T, _clips(_HIGH) + "select video_id, count(*) clips, rounded[sum(duration); 6] total_sec from clips group by video_id")

_STEMS = "s as (select distinct video_id, concat('stream: ', video_id, '/part?', repeat('x', (video_id % 30)::int)) stem from fx_asr)\n"
_add("run_keys", "fx_asr", _STEMS + r"""select video_id, concat(substring(md5(stem), 1, 8), '_', regexp_replace(substring(stem, 1, 20), '[\\/:*?"<>|]', '', 'g')) run_key from s""")
_add("titles", "fx_asr", _STEMS + "select video_id, case when video_id % 3 = 0 then 'Own title' when video_id % 3 = 1 then concat('【Channel】', stem) else stem end title from s")
_add("raw_chat_read", "fx_chat", "select video_id, (row_number() over (partition by video_id order by msg_ord) - 1)::int ord, author, text, type, amount, published_us from fx_chat")
_add("raw_asr_read", "fx_asr", 'select video_id, (row_number() over (partition by video_id order by turn) - 1)::int ord, "start", "end", text, no_speech_prob, language from fx_asr')
_add("raw_ocr_read", "fx_ocr", "select video_id, (row_number() over (partition by video_id order by ord) - 1)::int ord, chapter, name, dialogue, frame_time, frame_index from fx_ocr")
_add("timeline_roundtrip", "fx_timeline fx_chat", f"""e as (select *, row_number() over (partition by video_id order by msg_ord) nth from fx_chat),
p as (select video_id, string_agg(concat_ws('/', author, text, type, coalesce(amount, '-')), '|' order by nth) messages from e where nth <= 10 group by video_id)
select t.video_id, seg_ord::int seg_ord, time_start, time_end, {_ts('time_start')} time_display, dialogue, asr_text text, density_per_min, case when density_per_min is not null then messages end messages, chat_spike, score_total, match_status
from fx_timeline t left join p using (video_id)""")
_add("timeline_array_read", "fx_timeline fx_chat", f"""e as (select *, row_number() over (partition by video_id order by msg_ord) nth from fx_chat),
p as (select video_id, string_agg(concat_ws('/', author, text, type, coalesce(amount, '-')), '|' order by nth) messages from e where nth <= 10 group by video_id),
n as (select *, (row_number() over (partition by video_id order by seg_ord) - 1)::int place from fx_timeline)
select n.video_id, place seg_ord, time_start, {_ts('time_start')} time_display, dialogue, asr_text text, case when density_per_min is not null then messages end messages, chat_spike, score_total, match_status
from n left join p using (video_id) where contains(coalesce(dialogue, ''), 'the') or contains(asr_text, 'the')""")
_add("scores_by_channel", "fx_asr fx_audio", _SPEECH + """, own as (
  select *, case when video_id % 2 = 0 then case when vol then 5 else 0 end + case when contains(text, 'er') then 20 else 0 end
    else case when vol then 15 else 0 end + case when contains(text, 'in') or contains(text, 'zz') then 7 else 0 end end + s2 + s4 score
  from speech where "end" - "start" >= 1),
r as (select *, row_number() over (partition by video_id order by score desc, turn)::int rank from own where score >= case when video_id % 2 = 0 then 20 else 15 end)
select video_id, turn::int seg_ord, rank, "start" time_start, "end" time_end, score::double score from r where rank <= 30""")
_add("channel_params_read", "fx_frames", """s as (select distinct video_id, video_id % 2 = 0 even from fx_frames)
select video_id, concat('c', video_id) channel, (1.5 + video_id % 3)::double spike_threshold, case when even then 0.25 else 1.0 end::double sample_interval_sec, case when even then 6 else 4 end::int hash_distance,
  case when even then 2 else 3 end::int stable_frames, (video_id % 5)::int top_n, 10.0::double window_sec, case when even then 7.0 else 20.0 end::double laughter, 2.0::double other, 25.0::double chat_spike,
  case when even then 'a|b' else '' end keywords
from s""")
_add("newest_timeline", "fx_asr", """e as (select distinct video_id v from fx_asr),
f as (select concat('/runs/', v % 25) root, case when v >= 25 then concat('/runs/', v % 25, '/run', v, '/timeline.json') when v % 4 = 0 then concat('/runs/', v % 25, '/timeline.json') end path,
  case when v >= 25 then 1 else 2 end rank, v * 7919 % 1000 modified from e)
select root, arg_max(path, row(rank, modified, path)) path from f where path is not null group by root""")


def _add_recursive(name: str, views: str, body: str) -> None:
    _add(name, views, body)
    ORACLE_SQL[name] = ORACLE_SQL[name].replace("with ", "with recursive ", 1)


_FOLD = """{rows}k as (select *, row_number() over (partition by video_id order by frame_index, frame_ord) k from {source}),
st as (
  select video_id, k, phash anchor, frame_index at_frame, frame_ord at_ord, 1 n from k where k = 1
  union all
  select k.video_id, k.k, case when far then k.phash else anchor end, case when far then k.frame_index else at_frame end, case when far then k.frame_ord else at_ord end, case when far then 1 else n + 1 end
  from (select st.*, k.phash, k.frame_index, k.k kk, bit_count(xor(k.phash, st.anchor)) > 4 far from st join k on k.video_id = st.video_id and k.k = st.k + 1) x
  join k on k.video_id = x.video_id and k.k = x.kk),
stable as (select video_id, at_frame frame_index, at_ord frame_ord, anchor phash from st where n = 2)
"""
_add_recursive("frame_debounce", "fx_frames", "s as (select 1),\n" + _FOLD.format(rows="", source="fx_frames") + "select video_id, frame_index, phash from stable")
_add_recursive("frames_by_channel", "fx_frames", "s as (select * from fx_frames where frame_index % (case when video_id % 2 = 0 then 7 else 30 end) = 0),\n"
    + _FOLD.format(rows="", source="s").replace("> 4 far", "> case when st.video_id % 2 = 0 then 6 else 4 end far").replace("where n = 2", "where n = case when video_id % 2 = 0 then 2 else 3 end")
    + "select video_id, frame_index, phash from stable")
_add_recursive("frames_to_rows", "fx_frames", "s as (select * from fx_frames where frame_index % 15 = 0),\n" + _FOLD.format(rows="", source="s").rstrip() + """,
p as (select f.* from fx_frames f join stable using (video_id, frame_ord)),
""" + _REVEALS.format(source="p") + "select video_id, ord, chapter, name, dialogue, frame_index / 30::double frame_time, frame_index from v")

_MATCHES = """cand as (
  select l.video_id, l.seg, x.ord::int ocr_ord, (least(l.e, x.time_end) - greatest(l.s, x.time_start)) / least(l.e - l.s, x.time_end - x.time_start) ratio
  from lefts l join screen x on x.video_id = l.video_id and least(l.e, x.time_end) > greatest(l.s, x.time_start)),
opts as (select video_id, seg, list(ocr_ord order by ratio desc, ocr_ord) o from cand where ratio >= 0.3::double group by video_id, seg),
ends as (select video_id, max(seg) k from lefts group by video_id),
took as (
  select video_id, 0 n, []::int[] used, null::int pick from ends
  union all
  select video_id, n, case when pick is null then used else list_append(used, pick) end, pick from (
    select took.video_id, took.n + 1 n, used, list_filter(o, lambda x: not list_contains(used, x))[1] pick
    from took join ends on ends.video_id = took.video_id and took.n < k left join opts on opts.video_id = took.video_id and opts.seg = took.n + 1)),
matches as (select video_id, n::int seg_ord, pick ocr_ord from took where pick is not null)
"""
_MATCHED_SPEECH = (
    _SPEECH.rstrip()
    + ",\n"
    + _SCREEN.rstrip()
    + """,
lefts as (select video_id, row_number() over (partition by video_id order by "start", turn)::int seg, "start" s, "end" e from speech),
"""
    + _MATCHES
)
_add_recursive("greedy_match", "fx_ocr fx_audio", _MATCHED_SPEECH + "select * from matches")
_add_recursive("match_totals", "fx_ocr fx_audio", _MATCHED_SPEECH + "select s.video_id, count(m.ocr_ord) matched, count(*) - count(m.ocr_ord) unmatched from screen s left join matches m on m.video_id = s.video_id and m.ocr_ord = s.ord group by s.video_id")
_add_recursive("unmatched_ocr", "fx_ocr fx_audio", _MATCHED_SPEECH + "select video_id, ord::int seg_ord from screen s where not exists (select 1 from matches m where m.video_id = s.video_id and m.ocr_ord = s.ord)")

_ALIGNED = (
    _OVERLAY.rstrip()
    + ",\n"
    + _SCREEN.rstrip()
    + """,
rows_of as (select l.*, p.text, p.guess, 0 rank from laid l join speech p on p.video_id = l.video_id and p.turn = l.seg_ord union all select *, null, null, 1 from lone),
al as (select *, row_number() over (partition by video_id order by time_start, rank, seg_ord)::int seg from rows_of),
lefts as (select video_id, seg, time_start s, time_end e from al),
"""
    + _MATCHES.rstrip()
    + """,
fused as (
  select al.video_id, al.seg ord, al.time_start, al.time_end, nullif(x.chapter, '') chapter, nullif(x.name, '') as character, x.dialogue, al.text, guess, al.message_count, al.chat_spike,
    coalesce(x.chapter_change, false) chapter_change, coalesce(x.choice_point, false) choice_point, coalesce(x.cg_unlock, false) cg_unlock, al.score_total total,
    al.source_type source0, x.ord is not null and al.text is not null both_sides,
    case when x.dialogue = '' and al.text = '' then 0 when x.dialogue = '' or al.text = '' then 1 else levenshtein(x.dialogue, al.text) / greatest(length(x.dialogue), length(al.text))::double end r
  from al left join matches m on m.video_id = al.video_id and m.seg_ord = al.seg left join screen x on x.video_id = m.video_id and x.ord = m.ocr_ord),
judged as (
  select * exclude (source0, both_sides, r), case when both_sides then 'ocr_asr' else source0 end source_type,
    case when both_sides and r < 0.15::double and guess = 'game_voice' then 'readback_possible' when both_sides and r < 0.2::double then 'consistent' when both_sides then 'conflict'
      when source0 = 'event_only' then 'not_applicable' else 'unverified' end match_status
  from fused),
complete as (
  select * from judged
  union all
  select video_id, ord, time_start, time_end, nullif(chapter, ''), nullif(name, ''), dialogue, null, null, null, false, chapter_change, choice_point, cg_unlock, 0, 'ocr_only', 'unverified'
  from screen s where not exists (select 1 from matches m where m.video_id = s.video_id and m.ocr_ord = s.ord)),
final as (
  select * exclude (ord), row_number() over (partition by video_id order by time_start, case source_type when 'event_only' then 1 when 'ocr_only' then 2 else 0 end, ord)::int seg_ord,
    case when match_status = 'conflict' then concat('OCR: ', substring(dialogue, 1, 50), ' | ASR: ', substring(text, 1, 50)) end conflict_note from complete)
"""
)
_add_recursive("align_full", "fx_chat fx_ocr fx_audio", _ALIGNED + "select video_id, seg_ord, time_start, chapter, dialogue, text, message_count, chapter_change, cg_unlock, total, source_type, match_status, conflict_note from final")
_add_recursive("full_pipeline", "fx_chat fx_ocr fx_audio", _ALIGNED + """select video_id, seg_ord, time_start, time_end,
  case when choice_point then 'choice' when chapter_change and coalesce(dialogue, '') = '' then 'transition' when coalesce(dialogue, '') <> '' and character is not null then 'dialogue'
    when coalesce(dialogue, '') <> '' then 'narration' when coalesce(text, '') <> '' and guess = 'game_voice' then 'narration' when coalesce(text, '') <> '' or chat_spike then 'reaction' else 'silence' end scene_type,
  dialogue, text, message_count, total, source_type, match_status from final""")

for _name, _scan in (("indexed_keyword", "search_keyword"), ("indexed_character", "search_character"), ("indexed_chapter", "chapter_filter")):
    ORACLE_SQL[_name] = ORACLE_SQL[_scan]
_REPORTS = {"index": "index_events", "youtube": "youtube_chapters", "sheet": "transcript_sheet", "characters": "character_stats", "scenes": "scene_distribution", "overview": "time_overview", "conflicts": "conflict_rows", "conflict_summary": "conflict_summary", "clips": "clip_manifest"}
ORACLE_SQL["report_rows"] = (
    "\nunion all\n".join(f"select '{report}' report, count(*)::bigint n from ({ORACLE_SQL[own]})" for report, own in _REPORTS.items())
    + f"\nunion all\nselect 'subtitles' report, coalesce(sum(subtitles), 0)::bigint n from ({ORACLE_SQL['srt_counts']})"
)
