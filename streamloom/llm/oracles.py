"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_UNIT = "((('0x' || substr(md5(concat_ws(':', '{seed}', {of})), 1, 13))::bigint)::double + 0.5) / 4503599627370496"
_OWN = "coalesce(doc_id::varchar, ''), md5(coalesce(text, ''))"
_KEY = "coalesce('=' || source, '~')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
with d as (select row_number() over () k, doc_id, coalesce(text, '') t, {_WORDS} w from documents),
r as (select k, doc_id, t, w, unnest(case when len(w) >= 3 then generate_series(1, len(w) - 2) else [] end) i from d),
g as (select k, i, count(*) over (partition by k, w[i], w[i + 1], w[i + 2]) n from r),
c as (select distinct k, unnest([i, i + 1, i + 2]) p from g where n > 1),
n as (select k, count(*) n from c group by k),
b as (
  select doc_id, len(w)::bigint n_words, coalesce(length(array_to_string(w, '')), 0)::bigint word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::bigint n_dup_lines,
    coalesce(n.n, 0)::bigint n_repeat_words, t
  from d left join n using (k)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars < 2 * n_words or word_chars > 20 * n_words or 10 * n_symbols > n_words
    or 10 * n_dup_lines > 3 * len(string_split(t, chr(10)))
    or 2 * length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) > length(regexp_replace(t, '\P{{L}}+', '', 'g'))
    or 2 * length(regexp_replace(t, '\P{{L}}+', '', 'g')) < word_chars) kept
from f
"""

OP3 = r"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path
  from pages),
r as (
  select *, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end rule
  from u)
select page_id, host, path, rule, case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end verdict
from r
"""

OP5 = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, octet_length(encode(h))::bigint n, sha256(h) digest, min(page_id) over (partition by sha256(h)) first from p)
select page_id, n payload_bytes, digest payload_digest,
  case when n >= 100 and first <> page_id then 'revisit' else 'response' end record_type,
  case when n >= 100 and first <> page_id then first end refers_to
from d
"""

#: CRC-32 by nibbles: each row of the list is the remainder of its index, shifted four times.
_CRC_TABLE = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
_NIBBLES = "flatten(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: [('0x' || b[2])::bigint, ('0x' || b[1])::bigint]))"

OP7 = f"""
with d as (
  select doc_id, (octet_length(encode(coalesce(text, ''))) + 16)::bigint size, {_KEY} s,
    {_UNIT.format(seed="shard", of=_OWN)} u,
    xor(list_reduce(list_prepend(4294967295::bigint, {_NIBBLES}), lambda c, x: xor(c >> 4, {_CRC_TABLE}[(xor(c, x) & 15) + 1])), 4294967295::bigint)::bigint text_crc32
  from documents),
r as (select *, row_number() over (partition by s order by u, doc_id, text_crc32, size) r, count(*) over (partition by s) n from d),
p as (
  select *, row_number() over (order by (r - {_UNIT.format(seed="shard", of="s")}) / n, s, u, doc_id, text_crc32, size) - 1 g, count(*) over () total
  from r),
q as (select *, (g * 40) // total shard from p)
select doc_id, size, text_crc32, 'rows' law, shard::int shard, (g - (shard * total + 39) // 40)::bigint slot, null::int grown_shard
from q
"""

_MIX = r"""
d as (
  select *, len(WORDS)::bigint size, KEY s, UNIT u,
    0.5::double + 0.5::double * coalesce(length(regexp_replace(coalesce(text, ''), '\P{L}+', '', 'g'))::double
      / nullif(length(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')), 0), 0) q
  from TABLE),
s as (select s, sum(size)::bigint source_size, [1, 2, 3][(row_number() over (order by s) - 1) % 3 + 1] w from d group by s),
o as (
  select s, source_size, w,
    sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by source_size / w, s rows between unbounded preceding and 1 preceding), 0) l,
    sum(w) over () - coalesce(sum(w) over (order by source_size / w, s rows between unbounded preceding and 1 preceding), 0) o
  from s),
e as (select l, o from o where l * w <= 3 * source_size * o order by source_size / w, s limit 1),
t as (
  select x.s, x.source_size, case when e.o is not null and x.o <= e.o then (e.l * x.w)::double / e.o else (3 * x.source_size)::double end target
  from o x left join e on true),
k as (
  select d.*, t.source_size, t.target, least(3, floor(coalesce(t.target / nullif(t.source_size, 0), 0)))::bigint epochs,
    coalesce(sum(size) over (partition by d.s order by -ln(u) / q, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint prior
  from d join t using (s)),
m as (select *, epochs + case when 2 * prior + size <= 2 * (target - epochs * source_size) and epochs < 3 then 1 else 0 end times from k)
""".replace("WORDS", _WORDS).replace("KEY", _KEY).replace("UNIT", _UNIT.format(seed="mix", of=_OWN))

OP9 = f"with {_MIX.replace('TABLE', 'documents')} select doc_id, size, source_size, target, times * size taken from m"

_ID_NIBBLES = "flatten(list_transform(regexp_extract_all(hex(encode(doc_id::varchar)), '..'), lambda b: [('0x' || b[2])::bigint, ('0x' || b[1])::bigint]))"
_SIZED = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"
_RECORD = " || ".join(_SIZED.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13 = f"""
with recursive d as (
  select row_number() over () k, doc_id, coalesce('=' || source, '') s, sha256({_RECORD} || {_SIZED.format("text")}) leaf,
    case when xor(list_reduce(list_prepend(4294967295::bigint, {_ID_NIBBLES}), lambda c, x: xor(c >> 4, {_CRC_TABLE}[(xor(c, x) & 15) + 1])), 4294967295::bigint) % 5 = 0
      then sha256({_RECORD} || {_SIZED.format(_LOWERED)}) end tampered
  from documents),
l as (select *, row_number() over (partition by s order by doc_id nulls first, leaf) - 1 p, count(*) over (partition by s) total from d),
t as (
  select 0 h, s, p, total, leaf digest from l
  union all
  select h + 1, s, p // 16, (total + 15) // 16, sha256(string_agg(digest, '' order by p)) from t where total > 1 group by h, s, p // 16, total),
r as (select s, digest subroot, row_number() over (order by s) - 1 p, count(*) over () total from t where total = 1),
u as (
  select 100 h, p, total, subroot digest from r
  union all
  select h + 1, p // 16, (total + 15) // 16, sha256(string_agg(digest, '' order by p)) from u where total > 1 group by h, p // 16, total),
n as (select h, s, p, digest from t where total > 1 union all select h, null, p, digest from u where total > 1),
b as (
  select h, s, p, coalesce(string_agg(digest, '') over (x rows between unbounded preceding and 1 preceding), '') before,
    coalesce(string_agg(digest, '') over (x rows between 1 following and unbounded following), '') after
  from n window x as (partition by h, s, p // 16 order by p)),
f as (
  select l.k, b.h, before, after from l join b on b.s = l.s and b.p = l.p // (16 ** b.h)::bigint
  union all
  select l.k, b.h, before, after from l join r using (s) join b on b.s is null and b.p = r.p // (16 ** (b.h - 100))::bigint),
g as (select k, string_agg(before || after, '' order by h) beside, list(before || '#' || after order by h) path from f group by k)
select *, folded_root = root verified
from (
  select doc_id, leaf, subroot, (select digest from u where total = 1) root, sha256(coalesce(beside, '')) proof_sha256,
    list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(path, [])), lambda c, x: sha256(split_part(x, '#', 1) || c || split_part(x, '#', 2))) folded_root
  from l join r using (s) left join g using (k))
"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1,
    "op3_url_filters": OP3,
    "op5_warc": OP5,
    "op7_sharding": OP7,
    "op9_source_mixing": OP9,
    "op13_merkle_manifest": OP13,
}
