"""SQL (DuckDB) with the results of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
n as (select doc_id, h, (length(h) // 2)::bigint as n_bytes from b),
p as (select doc_id, k, md5(substr(h, 2 * k + 1, 400)) as s from (select doc_id, h, unnest(range(0, n_bytes - 199)) as k from n where n_bytes >= 200)),
d as (select doc_id, k from p where s in (select s from p group by s having count(*) > 1)),
g as (select doc_id, k, lag(k) over (partition by doc_id order by k) as before from d),
i as (select doc_id, k, sum(case when before is null or k > before + 200 then 1 else 0 end) over (partition by doc_id order by k) as run from g),
r as (select doc_id, run, min(k) as lo, max(k) + 200 as hi from i group by doc_id, run),
c as (select doc_id, count(*) as n_spans, sum(hi - lo)::bigint as n_removed from r group by doc_id),
e as (select doc_id, hi as lo, lead(lo) over (partition by doc_id order by lo) as hi from r union all select doc_id, 0, min(lo) from r group by doc_id),
q as (select e.doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, n_bytes) - lo)), '' order by lo) as kept from e join n using (doc_id) group by e.doc_id)
select n.doc_id, n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from n left join c on n.doc_id = c.doc_id left join q on n.doc_id = q.doc_id
"""

OP8 = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as win from (select item_id, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n)),
hit as (select dw.doc_id, dw.k, dw.n, bw.item_id from dw join bw using (n, win)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as names from (select distinct doc_id, item_id::varchar as i from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, n_hit is not null as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

OP10 = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[k:k + 4], ' ') end as sh from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from d where len(w) > 0)),
n as (select doc_id, count(*) as n_shingles from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n_shingles + y.n_shingles - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as r from documents union select reach.doc_id, both_ways.b from reach join both_ways on reach.r = both_ways.a),
low as (select doc_id, min(r) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n_shingles, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept from d left join n using (doc_id) join low using (doc_id)
"""

_WHOLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

OP11 = f"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings where label is not null and {_WHOLE}),
s as (select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.q, r.q)::bigint as score from e a join e r on a.vec_id % 50 = 0 and a.vec_id <> r.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank, vec_id as negative_id, positive_score, score as negative_score
      from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""

_ROUND = """,
a{r} as materialized (select part, vec_id, min(struct_pack(d := (xx + bb - 2 * list_inner_product(x.v, b.v))::bigint, entry := b.entry)) as near
      from (select *, list_inner_product(v, v) as xx from x) x join (select *, list_inner_product(v, v) as bb from b{r}) b using (part) group by part, vec_id)"""
_MEANS = """,
b{s} as materialized (select b.part, b.entry, coalesce(m.v, b.v) as v from b{r} b left join
      (select part, entry, list(floor(s / n) order by pos) as v from (select a.part, a.near.entry as entry, pos, sum(x.v[pos]) as s, count(*) as n
       from a{r} a join x using (part, vec_id), range(1, 1 + (select max(len(v)) from x)) g(pos) group by all) group by part, entry) m on m.part = b.part and m.entry = b.entry)"""

OP12 = (
    f"""
with e as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as q from embeddings where {_WHOLE}),
x as materialized (select vec_id, label, part, q[part * (len(q) // 4) + 1:(part + 1) * (len(q) // 4)] as v from e, range(4) g(part)),
b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, v from x qualify row_number() over (partition by part order by vec_id) <= 256)"""
    + "".join(_ROUND.format(r=r) + _MEANS.format(r=r, s=r + 1) for r in range(4))
    + _ROUND.format(r=4)
    + """,
c as (select vec_id, string_agg(printf('%02x', near.entry), '' order by part) as code, sum(near.d)::bigint as error from a4 group by vec_id),
h as (select sha256(string_agg(c::bigint::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from (select part, entry, pos, v[pos] as c from b4, range(1, 1 + (select max(len(v)) from x)) g(pos)))
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from c join e using (vec_id), h
"""
)
