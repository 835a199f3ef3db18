"""DuckDB SQL of the longer contracts, stated plainly: term by term, distance by distance."""

from __future__ import annotations

SOURCE_DIVERGENCE = r"""
with docs as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
), used as (
  select d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), kept as (
  select lang, term from used group by lang, term having count(distinct d) >= 10
), counts as (
  select lang, source, term, count(*) as n from used join kept using (lang, term) group by lang, source, term
), vs as (
  select lang, count(*) as v from kept group by lang
), groups as (
  select lang, source, coalesce(v, 0) as v, coalesce(total, 0) as total
  from (select distinct lang, source from docs) left join vs using (lang)
       left join (select lang, source, sum(n) as total from counts group by lang, source) using (lang, source)
), p as (
  select lang, source, term, coalesce(n, 0) as n,
         (1 + (1000000000::hugeint * (coalesce(n, 0) + 2)) // (total + 2 * v))::bigint as p
  from groups join kept using (lang) left join counts using (lang, source, term)
), q as (
  select lang, term, (1 + (1000000000::hugeint * (sum(n) + 2)) // (any_value(all_n) + 2 * any_value(v)))::bigint as q
  from counts join vs using (lang) join (select lang, sum(n) as all_n from counts group by lang) using (lang)
  group by lang, term
), summed as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
       left join summed s on s.lang = a.lang and s.source = a.source and s.item = b.source
), terms as (
  select lang, source, term as item, ((p - q) * (p - q) // (p + q))::bigint as value
  from p join q using (lang, term) where n > 0 and p > q
), ranked as (
  select *, 'pair' as part, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
  union all by name
  select * from (select *, 'term' as part, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms)
  where rank <= 10
)
select lang, source, part, item, value, rank from ranked"""

#: Bytes as pairs of hexadecimal digits; strings of 200 bytes by a 64-bit hash, cut from blocks as a cut counts from the start.
SUFFIX_DEDUP = r"""
with docs as (
  select row_number() over () as d, doc_id, hex(encode(coalesce(text, ''))) as h from documents
), sized as (
  select d, doc_id, h, length(h) // 2 as n from docs
), blocks as (
  select d, b, least(512, n - 199 - b) as m, h[2 * b + 1 : 2 * b + 1422] as part from (select d, n, h, unnest(range(0, n - 199, 512)) as b from sized where n >= 200)
), starts as (
  select d, b + j as i, hash(part[2 * j + 1 : 2 * j + 400]) as w from (select d, b, part, unnest(range(0, m)) as j from blocks)
), again as (
  select d, i from starts where w in (select w from starts group by w having count(*) > 1)
), marked as (
  select d, i, case when i > lag(i) over (partition by d order by i) + 200 then 1 else 0 end as new from again
), runs as (
  select d, r, min(i) as s, max(i) + 200 as e from (select d, i, sum(new) over (partition by d order by i) as r from marked) group by d, r
), gaps as (
  select d, coalesce(lag(e) over (partition by d order by s), 0) as a, s as b from runs
  union all select d, max(e), null from runs group by d
), kept as (
  select d, string_agg(h[2 * a + 1 : 2 * coalesce(b, n)], '' order by a) as k from gaps join sized using (d) group by d
), totals as (
  select d, sum(e - s)::bigint as n_removed, count(*) as n_spans from runs group by d
)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from sized left join totals using (d) left join kept using (d)"""

_ASSIGN = """
far{0} as (
  select p.rid, p.m, b.k, sum((p.x - b.x) * (p.x - b.x))::bigint as far
  from parts p join book{0} b on p.m = b.m and p.j = b.j group by p.rid, p.m, b.k
), near{0} as (
  select rid, m, min(far * 64 + k) % 64 as k, min(far * 64 + k) // 64 as far from far{0} group by rid, m
)"""

_UPDATE = """
sums{0} as (
  select n.m, n.k, p.j, sum(p.x)::bigint as s, count(*)::bigint as c
  from near{0} n join parts p on n.rid = p.rid and n.m = p.m group by n.m, n.k, p.j
), book{1} as (
  select b.m, b.k, b.j, coalesce((s - ((s % c) + c) % c) // c, b.x)::bigint as x
  from book{0} b left join sums{0} t on b.m = t.m and b.k = t.k and b.j = t.j
)"""

VECTOR_CODES = f"""
with kept as (
  select row_number() over (order by vec_id nulls last, embedding) - 1 as rid, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
), spots as (
  select rid, len(v) // 16 as dims, unnest(v) as x, unnest(range(0, len(v))) as i from kept
), parts as (
  select rid, i // dims as m, i % dims as j, x from spots
), book0 as (
  select m, rid as k, j, x from parts where rid < 64
), {_ASSIGN.format(0)}, {_UPDATE.format(0, 1)}, {_ASSIGN.format(1)}, {_UPDATE.format(1, 2)}, {_ASSIGN.format(2)},
coded as (
  select rid, string_agg(printf('%02x', k::int), '' order by m) as code, sum(far)::bigint as error from near2 group by rid
), books as (
  select sha256(string_agg(x::varchar, ',' order by m, k, j)) as codebooks_sha256 from book2
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from kept join coded using (rid), books"""
