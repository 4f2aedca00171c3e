"""DuckDB SQL that gives the rows of the queries."""

from __future__ import annotations

from tracewarden.llm.chat import CLOSE, HISTORY, MARKS, OPEN, STRIDE
from tracewarden.llm.codes import ENTRIES, PARTS, ROUNDS, SCALE
from tracewarden.llm.secrets import ACCESS, ALLOW, CANDIDATE, HEX, PARTS as ALLOWED_PARTS, SCANS

_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIXING = rf"""
with docs as (select doc_id, source, coalesce(len(regexp_extract_all(text, {_WORD})), 0)::bigint as size,
  coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, ''))) as drawn from documents),
good as (select doc_id, case when max(quality) > 0 then 2.0 when max(quality) <= 0 then 0.5 else 1.0 end as weight
  from labels where doc_id is not null group by doc_id),
totals as (select source, sum(size)::double as source_size,
  [5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as w from docs group by source),
caps as (select *, source_size * 3.0::double as cap, sum(source_size) over () as all_size, sum(w) over () as all_w from totals),
levels as (select *, (all_size - coalesce(sum(cap) over before, 0)) / (all_w - coalesce(sum(w) over before, 0)) as level, row_number() over before as place
  from caps window before as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
chosen as (select level from levels where cap >= level * w order by place limit 1),
targets as (select source, source_size, least(cap, (select level from chosen) * w) as target from levels),
keyed as (select d.*, -ln((('0x' || substr(md5(drawn), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
    / coalesce(weight, 1.0)::double as key from docs d left join good using (doc_id)),
sums as (select *, coalesce(sum(size) over (partition by source order by key, doc_id, size
    rows between unbounded preceding and 1 preceding), 0)::double as before from keyed),
all_of as (select s.*, source_size, target,
    case when source_size > 0 then floor(target / source_size) else 0 end as epochs
  from sums s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size::bigint as source_size, target,
  (size * (epochs + (before + size / 2.0::double <= target - epochs * source_size)::int))::bigint as taken from all_of
"""

SUBSTRINGS = rf"""
with docs as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, {_WORD}), []) as w from documents),
runs as (select r, doc_id, unnest(range(1, len(w) - 11)) as i, w from docs where len(w) >= 13 and doc_id is not null),
texts as (select r, doc_id, i, array_to_string(w[i:i + 12], ' ') as run from runs),
firsts as (select run, min(doc_id) as lo from texts group by run),
gone as (select distinct r, unnest(range(i, i + 13)) as i from texts join firsts using (run) where doc_id > lo),
words as (select r, doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from docs),
kept as (select r, count(*) as n, string_agg(word, ' ' order by i) as kept from words anti join gone using (r, i) group by r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from docs left join kept using (r)
"""

_ESCAPED = "replace(replace(replace({0}, '\\', '\\b'), '<', '\\l'), '>', '\\g')"
CHAT = rf"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized as (select *, len(regexp_extract_all(text, {_WORD})) + {MARKS} as tokens,
  len('{OPEN}') + len({_ESCAPED.format("role")}) + 1 + len({_ESCAPED.format("text")}) + {len(CLOSE)} as chars from rows),
placed as (select *, row_number() over w as i, sum(tokens) over w as stop from sized
  window w as (partition by conv_id order by turn, role, text rows unbounded preceding)),
cut as (select *, stop - tokens as start, (stop - tokens) // {STRIDE} as low, (stop - 1) // {STRIDE} as high from placed),
wins as (select conv_id, low, high, min(i) as i, min(start) as start, sum(chars) as chars from cut group by all),
systems as (select conv_id, min(i) as i, arg_min(start, i) as start, arg_min(chars, i) as chars from cut where role = 'system' group by conv_id),
past as (select w.conv_id, w.chars,
    coalesce((select sum(c.chars) from cut c where c.conv_id = w.conv_id and c.i < w.i and c.start >= w.start - {HISTORY}), 0) as near,
    case when s.i < w.i and s.start < w.start - {HISTORY} then s.chars else 0 end as system
  from wins w left join systems s using (conv_id)),
formatted as (select conv_id, sum(chars + near + system)::bigint as formatted_chars from past group by conv_id),
turns as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
    coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256 from cut group by conv_id)
select * from turns join formatted using (conv_id)
"""

BENCHMARK = rf"""
with docs as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
items as (select item_id::varchar as item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null and text is not null),
grams as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as gram
  from (select *, least(len(w), 13) as n, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from items where len(w) > 0)),
windows as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as gram
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from grams) where len(w) >= n)),
hits as (select r, i, n, item_id from windows join grams using (n, gram)),
words as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + n)) as j from hits) group by r),
named as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct r, item_id from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from docs left join words using (r) left join named using (r)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WHOLE = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _plain(pattern: str, kind: str, place: int, docs: str = "docs") -> str:
    # Matches with their places: a match ends where the gaps and matches so far end.
    whole = _quoted(pattern)
    return f"""
    select r, {place} as place, '{kind}' as kind, pos - len(m) as start, pos as stop, m from (
      select r, m, sum(len(gap) + len(m)) over (partition by r order by i) as pos from (
        select r, unnest(ms) as m, unnest(gs) as gap, unnest(range(len(ms))) as i from (
          select r, regexp_extract_all(text, {whole}) as ms,
            string_split_regex(text, {whole})[:len(regexp_extract_all(text, {whole}))] as gs from {docs})))
    """


def _blank(pattern: str, docs: str, counts: str = "true") -> str:
    # Spaces in place of the matches.
    return f"""select r, array_to_string(list_transform(range(1, len(gs) + 1), lambda i: gs[i] || case when i > len(ms) then ''
      when {counts} then repeat(' ', len(ms[i])) else ms[i] end), '') as text
      from (select r, regexp_extract_all(text, {_quoted(pattern)}) as ms, string_split_regex(text, {_quoted(pattern)}) as gs from {docs})"""


#: The classes without look-aheads, which RE2 lacks; each after those before it.
_CLASSES = (
    "regexp_full_match(m, '[0-9A-Fa-f]+') and regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Fa-f]')",
    "regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]')",
    "regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]')",
    "regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Z]')",
    "regexp_matches(m, '[A-Za-z]')",
)
_SCAN = "case " + " ".join(f"when {like} then {k}" for k, like in enumerate(_CLASSES)) + " end"
SECRETS = f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
assign as (select *, regexp_extract(m, {_quoted(_WHOLE)}, 1) as value from ({_plain(_WHOLE, "assign", 0)})),
base as (select r, place, kind, start, stop from assign where len(value) >= 8
  union all select r, place, kind, start, stop from ({_plain(ACCESS, "access", 1)})
  union all select r, place, kind, start, stop from ({_plain(HEX, "hex", 2)})),
no_assign as ({_blank(_WHOLE, "docs", f"len(regexp_extract(ms[i], {_quoted(_WHOLE)}, 1)) >= 8")}),
no_access as ({_blank(ACCESS, "no_assign")}),
no_hex as ({_blank(HEX, "no_access")}),
clear as ({_blank(ALLOWED_PARTS, "no_hex")}),
strings as (select *, {_SCAN} as scan from ({_plain(CANDIDATE, "entropy", 3, "clear")})
  where not ({" or ".join(f"regexp_matches(m, {_quoted(a)})" for a in ALLOW)})),
windows as (select r, start, stop, m, i, scan, {SCANS[0].window} as w,
    list_histogram(string_split(substr(m, i, {SCANS[0].window}), '')) as counts
  from (select *, unnest(range(1, len(m) - {SCANS[0].window} + 2)) as i from strings where scan is not null)),
hot as (select r, start, stop, i, w from windows
  where log2(w) - list_sum(list_transform(map_values(counts), lambda c: c * log2(c))) / w
    >= case scan {" ".join(f"when {k} then {s.bits}" for k, s in enumerate(SCANS))} end - 1e-9),
spans as (select r, start + min(i) - 1 as start, start + max(i) - 1 + {SCANS[0].window} as stop from hot group by r, hot.start, stop),
added as (select r, 3 as place, 'entropy' as kind, start, stop from spans),
found as (select * from base union all select * from added),
lines as (select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, place) filter (place < 3) as base,
    string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, place) as spans from found group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join lines using (r)
"""

_DIGITS = "[" + ", ".join(f"('0x' || hex[{5 * g + 1}:{5 * g + 5}])::int" for g in range(8)) + "]"
_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
WARC = f"""
with hashed as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
coded as (select page_id, payload_bytes, array_to_string(list_transform({_DIGITS}, lambda d:
    substr({_BASE32}, (d >> 15) % 32 + 1, 1) || substr({_BASE32}, (d >> 10) % 32 + 1, 1)
    || substr({_BASE32}, (d >> 5) % 32 + 1, 1) || substr({_BASE32}, d % 32 + 1, 1)), '') as payload_digest from hashed),
roles as (select *, min(page_id) over (partition by payload_digest) as first from coded)
select page_id, payload_bytes, payload_digest,
  case when first is not distinct from page_id then 'response' else 'revisit' end as record_type,
  case when first is distinct from page_id then first end as refers_to from roles
"""

VECTORS = """
with usable as (select vec_id, embedding::double[] as v from embeddings
  where vec_id is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from usable a join usable b
  on a.vec_id < b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.95),
both_ways as (select a, b from links union all select b, a from links),
reach as (with recursive walk as (select vec_id as a, vec_id as b from usable
  union select w.a, l.b from walk w join both_ways l on w.b = l.a) select a, min(b) as component_id from walk group by a),
counts as (select a, count(*) as n from both_ways group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id,
  coalesce(component_id, vec_id) = vec_id as kept
from embeddings left join counts on vec_id = counts.a left join reach on vec_id = reach.a
"""

#: The codebooks of one more round: floor(sum / count), also below zero.
_ROUND = """,
near{k} as (select v.vec_id, v.p, v.i, arg_min(b.e, [{distance}, b.e]) as e, min({distance}) as d
  from pieces v join books{j} b on v.p = b.p group by v.vec_id, v.p, v.i),
sums{k} as (select v.p, n.e, x, sum(v.v[x]) as s, count(*) as n
  from pieces v join near{k} n on v.i = n.i and v.p = n.p, unnest(range(1, len(v.v) + 1)) as u(x) group by all),
means{k} as (select p, e, list(((s - ((s % n) + n) % n) // n)::bigint order by x) as v from sums{k} group by p, e),
books{k} as (select b.p, b.e, coalesce(m.v, b.v) as v from books{j} b left join means{k} m on b.p = m.p and b.e = m.e)"""
_DISTANCE = "list_sum(list_transform(list_zip(v.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
CODES = f"""
with usable as (select row_number() over (order by vec_id nulls last, embedding) - 1 as i, vec_id, label,
    list_transform(embedding::double[], lambda x: floor({SCALE} * x)::bigint) as v from embeddings
  where embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
pieces as (select i, vec_id, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] as v from usable, unnest(range({PARTS})) as t(p)),
books0 as (select p, i as e, v from pieces where i < {ENTRIES}){
    "".join(_ROUND.format(k=k + 1, j=k, distance=_DISTANCE) for k in range(ROUNDS + 1))},
coded as (select u.i, any_value(u.vec_id) as vec_id, any_value(label) as label,
    string_agg(printf('%02x', e::int), '' order by p) as code, sum(d)::bigint as error from usable u join near{ROUNDS + 1} n on u.i = n.i group by u.i)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from books{ROUNDS}) as codebooks_sha256 from coded
"""

_CRC = """xor(list_reduce([4294967295] || list_transform(string_split(c::varchar, ''), lambda x: ord(x)::bigint), lambda crc, byte:
  list_reduce([xor(crc, byte)] || range(8), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
TRIE = rf"""
with given as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first,
      sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as i,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as id,
    len(regexp_extract_all(coalesce(text, ''), {_WORD})) as words from conversations where conv_id is not null),
ids as (select c, {_CRC} % 4 as h, c - c % 20 as base from (select distinct c from given)),
turns as (select ids.c, g.i, id, words from ids join given g on g.c = base and g.i <= h
  union all select ids.c, 3 + g.i, id, words from ids join given g on g.c = ids.c and g.i > h),
paths as (select c, row_number() over w as d, sha256(string_agg(id, '' ) over w) as key, words from turns window w as (partition by c order by i)),
kept as (select *, coalesce(lag(key) over (partition by c order by d), '') as parent from paths),
ends as (select ids.c, coalesce(max_by(key, d), '') as key from ids left join kept using (c) group by ids.c),
ended as (select key, sha256(string_agg(c::varchar, ',' order by c)) as ends_sha256 from ends group by key),
nodes as (select key, d as depth, any_value(parent) as parent, min(c) as conv_id, count(*) as n, any_value(words) as words from kept group by key, d
  union all select '', 0, null, min(c), count(*), 0 from ids having count(*) > 0),
children as (select parent as key, count(*) as n_children from nodes where parent is not null group by parent),
below as (select key as top, key from nodes where key = '' union all select '', key from nodes where key <> ''
  union all select distinct a.key, b.key from kept a join kept b on a.c = b.c and a.d <= b.d),
sums as (select top, count(*) filter (n_children is null) as n_leaves, sum((n - 1) * words) as saved
  from below join nodes using (key) left join children using (key) group by top)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n as n_convs, coalesce(n_children, 0) as n_children, n_leaves,
  saved::bigint as saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
from nodes n join sums on sums.top = n.key left join children c on c.key = n.key left join ended e on e.key = n.key left join nodes p on p.key = n.parent
"""

ORACLES: dict[str, str] = {
    "op1_warc": WARC,
    "op3_source_mixing": MIXING,
    "op4_substring_dedup": SUBSTRINGS,
    "op5_embedding_near_dedup": VECTORS,
    "op6_chat_formatting": CHAT,
    "op8_benchmark_decontamination": BENCHMARK,
    "op9_secret_scans": SECRETS,
    "op11_vector_codes": CODES,
    "op13_prefix_trie": TRIE,
}
