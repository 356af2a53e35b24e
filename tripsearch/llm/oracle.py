"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned checksum of an ASCII text that is not empty."""
    byte = "list_reduce(list_prepend(xor(a, b), [0::bigint, 1, 2, 3, 4, 5, 6, 7]), lambda x, y: xor(x >> 1, case when x % 2 = 1 then 3988292384::bigint else 0::bigint end))"
    letters = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint)"
    return f"cast(xor(list_reduce(list_prepend(4294967295::bigint, {letters}), lambda a, b: {byte}), 4294967295) as bigint)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLE_SQL = {
    "op3_substring_bytes": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents
), win as (
  select doc_id, i, hash(substr(x, 2 * i + 1, 100)) as h, substr(x, 2 * i + 1, 100) as s from d, lateral unnest(range(0, n - 49)) t(i)
), least as (select h, s, min(doc_id) as m from win group by h, s having min(doc_id) <> max(doc_id)
), hits as (select win.doc_id, i from win join least using (h, s) where win.doc_id > m
), gone as (select distinct doc_id, i + k as j from hits, range(0, 50) t(k)
), spans as (
  select doc_id, count(*) as n_removed, sum(case when prev is null or prev < j - 1 then 1 else 0 end) as n_spans
  from (select doc_id, j, lag(j) over (partition by doc_id order by j) as prev from gone) group by 1
), kept as (
  select d.doc_id, string_agg(substr(x, 2 * i + 1, 2), '' order by i) as k
  from d join spans using (doc_id), lateral unnest(range(0, n)) t(i)
  where not exists (select 1 from gone where gone.doc_id = d.doc_id and gone.j = t.i) group by 1
)
select d.doc_id, cast(n as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(case when n_removed is null then x else coalesce(k, '') end)) as kept_sha256
from d left join spans using (doc_id) left join kept using (doc_id)
""",
    "op4_substring_words": """
with d as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), win as (
  select doc_id, unnest(range(1, len(w) - 48)) as i, unnest(list_transform(range(1, len(w) - 48), lambda k: sha256(array_to_string(w[k:k + 49], ' ')))) as h
  from d where len(w) >= 50
), least as (select h, min(doc_id) as m from win group by h having min(doc_id) <> max(doc_id)
), gone as (select distinct win.doc_id, i + k as j from win join least using (h), range(0, 50) t(k) where win.doc_id > m
), per as (select doc_id, list(j) as js, count(*) as n from gone group by 1
)
select d.doc_id, len(w) as n_words, coalesce(n, 0) as n_removed,
  sha256(coalesce(array_to_string(case when n is null then w
    else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: not list_contains(js, p[2])), lambda p: p[1]) end, ' '), '')) as kept_sha256
from d left join per using (doc_id)
""",
    "op5_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), true)
), pairs as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
  vec_id, score
from pairs qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10
""",
    "op6_url_filters": """
with u as (
  select page_id, url, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
    case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id, url, low,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), rules(action, rhost, rpath) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best as (
  select p.page_id, p.url, arg_min(action, (-length(rhost || rpath), rhost || rpath)) as action,
    arg_min(rhost || rpath, (-length(rhost || rpath), rhost || rpath)) as rule
  from (select distinct page_id, url, host, path from p) p join rules
    on (p.host = rhost or ends_with(p.host, '.' || rhost)) and starts_with(p.path, rpath)
  group by 1, 2
)
select p.page_id, coalesce(p.host, '') as host, coalesce(p.path, '') as path, best.rule,
  coalesce(best.action, case when not coalesce(regexp_matches(low, '://blog\\..*\\.org/de/'), false) and (
      coalesce(regexp_matches(low, 'utm_source=feed([^a-z0-9_.%-]|$)'), false)
      or coalesce(regexp_matches(low, '://m\\..*/de/'), false)
      or coalesce(regexp_matches(low, '\\?page=.*&ref='), false)
      or coalesce(regexp_matches(low, '[^a-z0-9_.%-]login([^a-z0-9_.%-]|$)'), false)
      or coalesce(ends_with(low, '.exe'), false)) then 'block' else 'allow' end) as verdict
from p left join best on p.page_id = best.page_id and p.url = best.url
""",
    "op7_warc": """
with r as (
  select page_id, coalesce(html, '') as payload, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h
  from pages
)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(h, 5 * (i // 4) + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as bigint) + 1, 1)),
    'string_agg', '') as payload_digest,
  case when page_id < max(page_id) over w then 'revisit' else 'response' end as record_type,
  case when page_id < max(page_id) over w then max(page_id) over w end as refers_to
from r window w as (partition by payload)
""",
    "op8_jaccard": """
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w]
    else list_transform(range(1, len(w) - 3), lambda k: w[k:k + 4]) end) as s from d
), n as (select doc_id, count(*) as n from s group by 1
), rare as (select s from s group by s having count(*) > 1
), kept as (select doc_id, s from s join rare using (s)
), links as (
  select a.doc_id as a, b.doc_id as b from kept a join kept b on a.s = b.s and a.doc_id <> b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by 1, 2, na.n, nb.n having 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), reach(doc_id, other) as (
  select doc_id, doc_id from d union select reach.doc_id, links.b from reach join links on links.a = reach.other
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(other) as component_id
from d join reach using (doc_id) left join n using (doc_id) group by 1, 2
""",
    "op9_decontamination": """
with d as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents
), i as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from benchmark
), lengths as (select distinct least(len(w), 5) as m from i where len(w) > 0
), item as (
  select distinct item_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda k: w[k:k + least(len(w), 5) - 1])) as s
  from i where len(w) > 0
), doc as (
  select distinct doc_id, unnest(list_transform(range(1, len(w) - m + 2), lambda k: w[k:k + m - 1])) as s
  from d, lengths where len(w) >= m
), n as (select item_id, count(*) as n_item from item group by 1)
select doc_id, item_id, n_item, count(*) as n_shared, count(*) / n_item as containment
from doc join item using (s) join n using (item_id) group by 1, 2, 3 having 100 * count(*) >= 75 * n_item
""",
    "op11_merkle": f"""
with recursive leaves as (
  select doc_id, source, {_leaf("text")} as leaf,
    case when {crc32("doc_id::varchar")} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as start
  from documents
), sources as (
  select source, row_number() over (order by source nulls first) - 1 as tree, count(*) as n, count(*) over () as n_sources
  from documents group by source
), placed as (
  select doc_id, leaf, start, tree, n, n_sources, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos
  from leaves join sources on leaves.source is not distinct from sources.source
), up(tree, level, pos, h, n) as (
  select tree, 0, pos, leaf, n from placed
  union all
  select tree, level + 1, pos // 3, sha256(string_agg(h, '' order by pos)), max((n + 2) // 3) from up where n > 1 group by tree, level, pos // 3
), top(level, pos, h, n) as (
  select 0, up.tree, up.h, n_sources from up join sources using (tree) where up.n = 1
  union all
  select level + 1, pos // 3, sha256(string_agg(h, '' order by pos)), max((n + 2) // 3) from top where n > 1 group by level, pos // 3
), runs as (
  select tree, level, pos // 3 as parent, list({{'pos': pos, 'h': h}} order by pos) as run from up where n > 1 group by all
  union all
  select -1, level, pos // 3, list({{'pos': pos, 'h': h}} order by pos) from top where n > 1 group by all
), climb(home, place, tree, level, pos, h, proof) as (
  select tree, pos, tree, 0, pos, start, '' from placed
  union all
  select home, place, c.tree, c.level + 1, c.pos // 3,
    sha256(array_to_string(list_transform(run, lambda x: case when x.pos = c.pos then c.h else x.h end), '')),
    proof || array_to_string(list_transform(list_filter(run, lambda x: x.pos <> c.pos), lambda x: x.h), '')
  from climb c join runs on runs.tree = c.tree and runs.level = c.level and runs.parent = c.pos // 3
), whole(home, place, level, pos, h, proof) as (
  select home, place, 0, home, h, proof from climb where not exists (select 1 from runs where runs.tree = climb.tree and runs.level = climb.level)
  union all
  select home, place, c.level + 1, c.pos // 3,
    sha256(array_to_string(list_transform(run, lambda x: case when x.pos = c.pos then c.h else x.h end), '')),
    proof || array_to_string(list_transform(list_filter(run, lambda x: x.pos <> c.pos), lambda x: x.h), '')
  from whole c join runs on runs.tree = -1 and runs.level = c.level and runs.parent = c.pos // 3
)
select doc_id, leaf, s.h as subroot, r.h as root, sha256(w.proof) as proof_sha256, w.h as folded_root, w.h = r.h as verified
from placed p join (select tree, h from up where n = 1) s using (tree) cross join (select h from top where n = 1) r
join whole w on w.home = p.tree and w.place = p.pos
where not exists (select 1 from runs where runs.tree = -1 and runs.level = w.level)
""",
    "op12_conversations": f"""
with recursive hurt as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc32("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as hurt from conversations
), rows as (
  select conv_id, turn, case when hurt = 4 then 'user' else role end as role,
    case hurt when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when hurt = 3 then 2 else 1 end)) from hurt where hurt <> 0
), placed as (
  select conv_id, turn, role, text, left(role, 1) as initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare,
    row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || text)) as i from rows
), told as (
  select *, case when bare = '' then 'blank'
      when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
      when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(initial) over (partition by conv_id order by i) as before from placed
), facts as (
  select conv_id, count(*) as n_rows, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from told group by conv_id
), inserts(a, b, n) as (
  values (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)
), edits(b, initial, edit, c, price) as (
  select b, '*', 'D', b, 2 from range(4) t(b) union all select b, '+', 'R', case b when 2 then 3 else 2 end, 1 from range(4) t(b)
  union all values (0, 's', 'K', 1, 0), (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (3, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0)
), best(conv_id, i, state, v) as (
  select conv_id, 0::bigint, 0::bigint, {{'cost': 0::bigint, 'audit': ''}} from (select distinct conv_id from conversations)
  union all
  select p.conv_id, p.i + 1, e.c,
    min({{'cost': v.cost + 5 * x.n + e.price + case when t.fault = 'truncated' and e.edit <> 'D' then 5 else 0 end, 'audit': v.audit || repeat('I', x.n) || e.edit}})
  from best p join told t on t.conv_id is not distinct from p.conv_id and t.i = p.i + 1 join inserts x on x.a = p.state
    join edits e on e.b = x.b and (e.initial = '*' or t.fault in ('', 'truncated') and e.initial in ('+', t.initial))
  group by p.conv_id, p.i, e.c
), chosen as (
  select b.conv_id, min({{'cost': v.cost + 5 * w.n, 'audit': v.audit || repeat('I', w.n)}}) as v
  from best b left join facts f on f.conv_id is not distinct from b.conv_id join (values (0, 0), (1, 2), (2, 1), (3, 0)) w(state, n) using (state)
  where b.i = coalesce(f.n_rows, 0) group by b.conv_id
), said(conv_id, audit, p, i, state, lines) as (
  select conv_id, v.audit, 0, 0::bigint, 0::bigint, []::varchar[] from chosen
  union all
  select s.conv_id, s.audit, s.p + 1, i2, c2, case e when 'D' then lines else list_append(lines,
      case when e = 'K' then t.role when c2 = 2 then 'user' else 'assistant' end || ':' || case e when 'I' then '' else t.text end) end
  from (
    select *, substr(audit, p + 1, 1) as e, i + case substr(audit, p + 1, 1) when 'I' then 0 else 1 end as i2 from said where p < length(audit)
  ) s left join told t on t.conv_id is not distinct from s.conv_id and t.i = s.i2,
  lateral (select case when e = 'D' then s.state when e = 'K' and t.initial = 's' then 1 when s.state = 2 then 3 else 2 end as c2)
)
select s.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, c.v.cost as cost, s.audit, sha256(array_to_string(lines, chr(10))) as repaired_sha256, coalesce(n_rows, 0) as n_rows
from said s join chosen c on c.conv_id is not distinct from s.conv_id left join facts f on f.conv_id is not distinct from s.conv_id
where s.p = length(s.audit)
""",
}
