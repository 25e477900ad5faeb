"""DuckDB SQL of the corpus queries that SQL can express."""

from wardline.llm.mixing import GOLDEN, GRID

SQL = {
    "op2_benchmark_decontamination": """
with doc as (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents
), item as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark
), win as (
  select distinct item, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as t
  from (select *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from item where len(w) > 0)
), lens as (select distinct n from win), pos as (
  select r, i, n, array_to_string(w[i : i + n - 1], ' ') as t
  from (select doc.r, doc.w, lens.n, unnest(range(1, len(w) - n + 2)) as i from doc join lens on len(w) >= n)
), hit as (select r, i, pos.n, item from pos join win on win.n = pos.n and win.t = pos.t),
hits as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from (select distinct r, i, n from hit)) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct r, item from hit where item is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join hits using (r) left join items using (r)
""",
    "op7_url_filters": """
with page as (
  select page_id, url, cast(date '2024-01-01' + cast(page_id % 365 as integer) as date) as fetched_at,
    nullif(regexp_replace(regexp_extract(lower(url), '^[\\x00-\\x20]*[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\\[[0-9a-f:.]+\\]|[^/?#:@\\[\\]]+)', 1), '\\.+$', ''), '') as host
  from pages
), known as (
  select distinct regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) as domain from page where host is not null
), entry as (
  select domain, md5(domain) as m from known where domain <> ''
), listed as (
  select domain, cast(date '2024-01-01' + cast(('0x' || m[1:4])::int % 300 as integer) as date) as f,
    case when ('0x' || m[9:12])::int % 2 = 0 then date '2024-01-01' + cast(('0x' || m[1:4])::int % 300 + ('0x' || m[13:16])::int % 120 + 1 as integer) end as t
  from entry where ('0x' || m[5:8])::int % 4 = 0
), best as (
  select page_id, url, fetched_at, max_by(domain, length(domain)) as entry, max_by(f, length(domain)) as since
  from page join listed on (host = domain or ends_with(host, '.' || domain)) and f <= fetched_at and (t is null or fetched_at < t)
  group by all
)
select page.page_id, page.url, cast(page.fetched_at as varchar) as fetched_at, entry is not null as blocked, entry, cast(since as varchar) as listed_since
from page left join best on best.page_id is not distinct from page.page_id and best.url is not distinct from page.url
""",
    "op10_source_mixing": f"""
with doc as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from documents
), src as (
  select source, count(*) as n, cast(sum(size) as bigint) as source_size from doc group by source
), numbered as (
  select *, row_number() over (order by source asc nulls last) - 1 as idx from src
), weighed as (
  select *, [3.0::double, 1.0::double, 2.0::double][idx % 3 + 1] as w, 2.0::double * source_size as most, 1.5::double * sum(source_size) over () as total from numbered
), levels as (
  select *, most / w as ratio,
    (total - coalesce(sum(most) over (order by most / w, idx rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by most / w, idx rows between current row and unbounded following) as level
  from weighed
), filled as (
  select *, case when ratio <= level then most else w * max(case when ratio > level then level end) over () end as target from levels
), upper as (
  select *, case when idx = max(idx) over () then {GRID} else cast(coalesce(floor(sum(target) over (order by idx rows between unbounded preceding and current row) / total * {GRID}), 0) as bigint) end as hi from filled
), tgt as (
  select *, coalesce(lag(hi) over (order by idx), 0) as lo from upper
), facts as (
  select cast(ceil(1.5::double * sum(size)) as bigint) as total, count(*) as n from doc
), many as (
  select greatest(1, least(greatest(131072, n), total)) as slots from facts
), slot as (
  select i, ((i % {GRID}) * {GOLDEN}) % {GRID} as u from (select unnest(range(cast(slots as bigint))) as i from many)
), ranked as (
  select idx, i, row_number() over (partition by idx order by i) - 1 as r from slot join tgt on u >= lo and u < hi
), plan as (
  select tgt.*, cast(floor(target + 0.5) as bigint) as due, m
  from tgt left join (select idx, count(*) as m from ranked group by idx) using (idx)
), line as (
  select doc_id, size, plan.*, sum(size) over (partition by idx order by md5(concat_ws(':', coalesce(cast(doc_id as varchar), ''), cast(size as varchar), 'mix')), doc_id, size
    rows between unbounded preceding and current row) - size as s
  from doc join plan on doc.source is not distinct from plan.source
)
select doc_id, size, source_size, target, cast(greatest(0, least(due, s + size) - s) + greatest(0, least(due - source_size, s + size) - s) as bigint) as taken,
  case when size > 0 and s < due then case when m is null then slots + line.idx else i end end::bigint as slot
from line cross join many left join ranked on ranked.idx = line.idx and ranked.r = ((s + 1)::hugeint * coalesce(m, 1) - 1) // greatest(due, 1)
""",
    "op11_warc": """
with page as (
  select page_id, coalesce(html, '') as h, cast(strlen(coalesce(html, '')) as bigint) as n from pages
), found as (
  select *, case when n >= 1000 then max(page_id) over (partition by h) end as target from page
)
select page_id, n as payload_bytes, sha1(h) as payload_digest, case when n >= 1000 and page_id is distinct from target then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id is distinct from target then target end as refers_to
from found
""",
    "op12_conversation_repair": """
with recursive code as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations
), lot as (
  select *, xor(list_reduce(list_transform(range(1, len(key) + 1), lambda i: cast(ascii(key[i]) as bigint)),
    lambda c, b: list_reduce(range(8), lambda x, j: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), cast(4294967295 as bigint)), 4294967295) % 20 as lot from code
), hurt as (
  select conv_id, turn, case when lot = 4 then 'user' else role end as role, case lot when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case lot when 0 then 0 when 3 then 2 else 1 end)) as copy from lot
), conv as (
  select conv_id, row_number() over () as c from (select distinct conv_id from conversations)
), line as (
  select c, turn, role, text, row_number() over (partition by c order by turn nulls first, role, md5(text)) as i from hurt join conv on hurt.conv_id is not distinct from conv.conv_id
), fault as (
  select *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, row_number() over (partition by c, role, text order by i) > 1 as again,
    lag(role) over (partition by c order by i) as last_role from line
), judged as (
  select *, bare = '' as blank, bare <> '' and again as duplicate, bare <> '' and not again and not regexp_matches(bare, '[.!?]$') as truncated from fault
), counted as (
  select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate,
    count(*) filter (truncated) as truncated, count(*) filter (last_role[1] || role[1] not in ('su', 'ua', 'au')) as illegal, max(i) as n
  from judged group by c
), way as (
  select c, cast(0 as bigint) as i, cast(0 as bigint) as c0, '' as a0, cast(null as bigint) as c1, cast(null as varchar) as a1, cast(3 as bigint) as c2, 'I' as a2, cast(6 as bigint) as c3, 'II' as a3 from counted
  union all
  select c, i, n0[1], n0[2], n1[1], n1[2], n2[1], n2[2], n3[1], n3[2] from (
    select c, i, d0 as n0, m1 as n1, least(m2, z2) as n2, least(m3, case when least(m2, z2) is not null then row(least(m2, z2)[1] + 3, least(m2, z2)[2] || 'I') end) as n3 from (
      select *, least(row(d0[1] + 3, d0[2] || 'I'), case when m1 is not null then row(m1[1] + 3, m1[2] || 'I') end, case when m3 is not null then row(m3[1] + 3, m3[2] || 'I') end) as z2 from (
        select w.c, j.i, row(c0 + 4, a0 || 'D') as d0,
          least(case when c1 is not null then row(c1 + 4, a1 || 'D') end, case when role[1] = 's' and not (blank or duplicate) then row(c0 + x, a0 || 'K') end) as m1,
          least(case when c2 is not null then row(c2 + 4, a2 || 'D') end, case when not (blank or duplicate) then least(row(c0 + x + y, a0 || l), case when c1 is not null then row(c1 + x + y, a1 || l) end, case when c3 is not null then row(c3 + x + y, a3 || l) end) end) as m2,
          least(case when c3 is not null then row(c3 + 4, a3 || 'D') end, case when c2 is not null and not (blank or duplicate) then row(c2 + x + u, a2 || v) end) as m3
        from way w join (select *, case when truncated then 3 else 0 end as x, case when role[1] = 'u' then 0 else 3 end as y, case when role[1] = 'u' then 'K' else 'R' end as l,
          case when role[1] = 'a' then 0 else 3 end as u, case when role[1] = 'a' then 'K' else 'R' end as v from judged) j on j.c = w.c and j.i = w.i + 1)))
), best as (
  select c, least(row(c0, a0), case when c3 is not null then row(c3, a3) end)[1] as cost, least(row(c0, a0), case when c3 is not null then row(c3, a3) end)[2] as audit from way join counted using (c) where i = n
), letter as (
  select c, audit[p] as l, p, sum((audit[p] <> 'I')::int) over (partition by c order by p) as i, sum((audit[p] <> 'D')::int) over (partition by c order by p) as nth
  from (select c, audit, unnest(range(1, len(audit) + 1)) as p from best)
), kept as (
  select letter.c, p, l, nth, role, text, max((nth = 1 and l = 'K' and role[1] = 's')::int) over (partition by letter.c) as sys
  from letter left join line on l <> 'I' and line.c = letter.c and line.i = letter.i where l <> 'D'
), text as (
  select c, string_agg(case when l = 'K' then role when (nth - sys) % 2 = 1 then 'user' else 'assistant' end || ':' || case when l = 'I' then '' else text end, chr(10) order by p) as t from kept group by c
)
select conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from conv left join counted using (c) left join best using (c) left join text using (c)
""",
    "op13_filter_audit": """
with doc as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
    min(doc_id) over (partition by coalesce(text, '')) as first
  from documents
), mark as (
  select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id
), flag as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] as f
  from doc left join mark using (doc_id)
), cell as (
  select part, f, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from flag group by part, f
), letter as (
  select unnest([1, 2, 3, 4, 5]) as i
), ord as (
  select [a.i, b.i, c.i, d.i, e.i] as o from letter a, letter b, letter c, letter d, letter e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), step as (
  select o, array_to_string(list_transform(o, lambda x: chr(64 + x)), '') as filter_order, unnest([1, 2, 3, 4, 5]) as step from ord
), count as (
  select part, filter_order, step, o[step] as x,
    sum(case when not list_bool_or(list_transform(o[1 : step], lambda k: f[k])) then n else 0 end) as kept,
    sum(case when f[o[step]] and not coalesce(list_bool_or(list_transform(o[1 : step - 1], lambda k: f[k])), false) then n else 0 end) as removed,
    sum(case when f[o[step]] and coalesce(list_bool_or(list_transform(o[1 : step - 1], lambda k: f[k])), false) then n else 0 end) as redundant,
    sum(case when f[o[step]] and len(list_filter(f, lambda v: v)) = 1 then n else 0 end) as unique_fails,
    sum(case when f[o[step]] and not coalesce(list_bool_or(list_transform(o[1 : step - 1], lambda k: f[k])), false) then good else 0 end) as good_lost,
    sum(case when f[o[step]] and not coalesce(list_bool_or(list_transform(o[1 : step - 1], lambda k: f[k])), false) then toxic else 0 end) as toxic_lost
  from step cross join cell group by part, o, filter_order, step
)
select part, filter_order, cast(step as integer) as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, cast(sum(removed) over (partition by part, x) as bigint) as shapley
from count
""",
}
