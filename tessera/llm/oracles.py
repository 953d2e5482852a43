"""SQL that gives the rows of those text queries that SQL can express."""

from __future__ import annotations

from tessera.llm.chat import CONTROL
from tessera.llm.decontaminate import TERM
from tessera.llm.text import LOWER, UPPER, WORD

MIX = rf"""with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as size, md5('17:' || coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, ''))) as h from documents),
 s as (select source, sum(size) as n, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from d group by source),
 o as (select *, sum(n) over () as total, coalesce(sum(n) over (order by n / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as full_n, sum(w) over (order by n / w, source nulls last rows between current row and unbounded following) as open_w, row_number() over (order by n / w, source nulls last) as k from s),
 f as (select min(k) as k from o where (150 * total - 200 * full_n) * w <= 200 * n * open_w),
 t as (select o.source, n, case when o.k < f.k or f.k is null then cast(2 * n as double) else cast(c.rest * w as double) / cast(100 * c.open_w as double) end as target from o, f left join (select k, 150 * total - 200 * full_n as rest, open_w from o) c on c.k = f.k),
 q as (select *, cast(round_even(target, 0) as bigint) as got from t),
 p as (select source, n, target, case when n > 0 then got // n else 0 end as whole, case when n > 0 then got % n else 0 end as rest from q),
 c as (select d.*, p.n, p.target, p.whole, p.rest, sum(d.size) over (partition by d.source order by h, d.size rows between unbounded preceding and current row) <= p.rest as more from d join p on d.source is not distinct from p.source),
 g as (select source, min(rest) - sum(case when more then size else 0 end) as gap from c group by source),
 r as (select *, row_number() over (partition by source, h, size, more order by h) as rn from c),
 e as (select c.source, min(struct_pack(dist := abs(gap - size), h := h, size := size)) as best from c join g on c.source is not distinct from g.source where not more and gap > 0 and abs(gap - size) < gap group by c.source)
select doc_id, c.size, cast(n as bigint) as source_size, target, cast(c.size * (whole + case when more or (best is not null and not more and rn = 1 and c.h = best.h and c.size = best.size) then 1 else 0 end) as bigint) as taken from r c left join e on c.source is not distinct from e.source"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
DECONTAMINATE = f"""with b as (select cast(item_id as varchar) as item, {_TERMS} as w from benchmark),
 g as (select distinct item, least(len(w), 10) as n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda p: list_slice(w, p, p + least(len(w), 10) - 1))) as gram from b where len(w) > 0),
 d as (select doc_id, {_TERMS} as w from documents), ns as (select distinct n from g),
 x as (select doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: struct_pack(p := p, gram := list_slice(w, p, p + n - 1)))) as s from d, ns),
 hit as (select distinct doc_id, s.p as p, x.n as n, item from x join g on g.n = x.n and g.gram = s.gram),
 hw as (select doc_id, count(distinct p + k) as n_hit from (select doc_id, p, unnest(range(n)) as k from (select distinct doc_id, p, n from hit)) group by doc_id),
 hi as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
 from d left join hw on hw.doc_id = d.doc_id left join hi on hi.doc_id = d.doc_id"""

_ESCAPED = rf"regexp_replace({{}}, '([<\[])(\\*(?:{CONTROL}))', '\1\\\2', 'g')"
CHAT = f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 r as (select *, sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 9) over (partition by conv_id order by turn, role, text rows between unbounded preceding and current row) as upto, row_number() over (partition by conv_id order by turn desc, role desc, text desc) = 1 as last from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars, sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
 cast(sum(case when role = 'assistant' or last then upto else 0 end) as bigint) as formatted_chars from r group by conv_id"""

#: DuckDB has no CRC-32: its bits, one after another, over the digits of the id.
_CRC = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(c::varchar) + 1), lambda i: ascii(substr(c::varchar, i::int, 1))::bigint)), lambda x, y: list_reduce(list_concat([xor(x, y)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda u, z: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295::bigint)"
TRIE = rf"""with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as k, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
 cs as (select c, {_CRC} % 4 as h from (select distinct c from t)),
 r as (select t.c, k, role, text from t join cs on cs.c = t.c where k >= h union all select cs.c, k, role, text from cs join t on t.c = cs.c - cs.c % 20 where k < h),
 w as (select cs.c, coalesce(list(struct_pack(role := role, text := text) order by k) filter (where k is not null), []) as turns from cs left join r on r.c = cs.c group by cs.c),
 p as (select c, d, turns[1:d] as pre, d = len(turns) as last from (select c, turns, unnest(range(0, len(turns) + 1)) as d from w)),
 n as (select pre, d, min(c) as conv_id, count(*) as n_convs, coalesce(string_agg(c::varchar, ',' order by c) filter (where last), '') as ends, case when d > 0 then (count(*) - 1) * len(regexp_extract_all(pre[d].text, '{WORD}')) else 0 end as own from p group by pre, d),
 k as (select pre[1:d - 1] as pre, count(*) as n_children from n where d > 0 group by 1),
 m as (select n.*, coalesce(n_children, 0) as n_children, u.conv_id as parent_conv_id from n left join k on k.pre = n.pre left join n u on n.d > 0 and u.pre = n.pre[1:n.d - 1]),
 s as (select a.conv_id, a.d, sum(case when m.n_children = 0 then 1 else 0 end) as n_leaves, sum(m.own) as saved from (select m.*, unnest(range(0, d + 1)) as up from m) m join n a on a.d = up and a.pre = m.pre[1:up] group by a.conv_id, a.d)
select m.conv_id, m.d as depth, parent_conv_id, n_convs, n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(ends) as ends_sha256 from m join s on s.conv_id = m.conv_id and s.d = m.d"""

#: A checksum of every byte makes SQL for the shards too slow over whole tables; they are tested against plain Python.
ORACLES = {"op2_mix_sources": MIX, "op3_decontaminate": DECONTAMINATE, "op6_chat_examples": CHAT, "op13_prefix_trie": TRIE}
