"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, k, k + 4), ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as k from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 75 * (x.n + y.n - c)),
r(node, seen) as (select distinct a, a from e union select e.b, r.seen from r join e on e.a = r.node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.least_, d.doc_id)) as component_id
from documents d left join n on n.doc_id = d.doc_id left join (select node, min(seen) as least_ from r group by node) m on m.node = d.doc_id
"""

OP5 = r"""
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select doc_id, unnest(l) as raw, generate_subscripts(l, 1) as line from l),
f as (select *, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) as words from x),
s as (select *, row_number() over (partition by doc_id order by line) as place_ from f where words > 0),
c as (select a.doc_id, a.place_, b.place_ as stop, sum(b.words) over (partition by a.doc_id, a.place_ order by b.place_) as total from s a join s b on a.doc_id = b.doc_id and b.place_ between a.place_ and a.place_ + 7),
r as (select doc_id, place_, min(stop) as stop from c where total >= 8 group by doc_id, place_),
k as (select r.doc_id, r.place_, r.stop, string_agg(s.raw, chr(10) order by s.place_) as key from r join s on s.doc_id = r.doc_id and s.place_ between r.place_ and r.stop group by all),
o as (select *, row_number() over (partition by key order by doc_id, place_) as nth from k),
g as (select distinct s.doc_id, s.line from o join s on s.doc_id = o.doc_id and s.place_ between o.place_ and o.stop where nth > 1)
select x.doc_id, count(*) filter (regexp_matches(x.raw, '[^\x20\x09-\x0D]')) as n_lines, count(g.line) as n_removed,
  sha256(coalesce(string_agg(x.raw, chr(10) order by x.line) filter (g.line is null), '')) as kept_sha256
from x left join g on g.doc_id = x.doc_id and g.line = x.line group by x.doc_id
"""

OP7 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
k as (select doc_id, k, md5(array_to_string(list_slice(w, k, k + 49), ' ')) as key from (select doc_id, w, unnest(range(1, len(w) - 48)) as k from w where len(w) >= 50)),
m as (select doc_id, k, doc_id > min(doc_id) over (partition by key) as later from k),
p as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from w),
c as (select p.doc_id, p.word, p.p, coalesce(bool_or(m.later) over (partition by p.doc_id order by p.p rows between 49 preceding and current row), false) as gone from p left join m on m.doc_id = p.doc_id and m.k = p.p)
select d.doc_id, count(c.p) as n_words, count(*) filter (c.gone) as n_removed, sha256(coalesce(string_agg(c.word, ' ' order by c.p) filter (not c.gone), '')) as kept_sha256
from documents d left join c on c.doc_id = d.doc_id group by d.doc_id
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = rf"""
with b as (select item_id::varchar as item_id, {_WORDS} as w from benchmark),
bw as (select distinct item_id, list_slice(w, k, k + 9) as win from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) as k from b where len(w) > 0)),
d as (select doc_id, {_WORDS} as w from documents),
n as (select distinct len(win) as n from bw),
dw as (select doc_id, k, n, list_slice(w, k, k + n - 1) as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, n where len(w) >= n)),
o as (select dw.doc_id, dw.k, dw.n, bw.item_id from dw join bw on dw.win = bw.win),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from o) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from o) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join h on h.doc_id = d.doc_id left join i on i.doc_id = d.doc_id
"""

OP11 = r"""
with x as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) as raw from documents),
r as (select doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as k from x where length(raw) >= 5 group by all),
b as (select *, hex(encode(concat(doc_id, ':', run))) as b from r),
s as (select *, list_transform(range(0, 4 * len(b)), lambda p: case when p % 8 = 0 then (strpos('0123456789ABCDEF', b[p // 4 + 1]) - 1) * 16 + strpos('0123456789ABCDEF', b[p // 4 + 2]) - 1 else 0 end) as bits from b),
h as (select *, xor(list_reduce(list_prepend(4294967295::bigint, bits), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295) as h from s),
d as (select case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from h),
w as materialized (select word, sum(k)::bigint as n from d where length(word) >= 5 group by word having sum(k) >= 3),
c as materialized (select word, n, i, left(word, i - 1) || substr(word, i + 1) as cut from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
p as (select a.word, b.word as other, b.n as m from c a join c b on a.i = b.i and a.cut = b.cut and a.word <> b.word
  union select c.word, w.word, w.n from c join w on c.cut = w.word union select w.word, c.word, c.n from c join w on c.cut = w.word),
f as materialized (select word, count(*) as n_near, max(m) as m, arg_min(other, (-m, other)) as best from p group by word),
g as materialized (select w.word, w.n, coalesce(f.n_near, 0) as n_near, case when f.m >= 2 * w.n then f.best end as form, case when f.m >= 2 * w.n then f.m end as form_n from w left join f on f.word = w.word),
t as (with recursive t(word, at_) as (select word, form from g where form is not null union all select t.word, g.form from t join g on g.word = t.at_ where g.form is not null) select t.word, t.at_ from t join g on g.word = t.at_ where g.form is null)
select g.word, g.form, coalesce(t.at_, g.word) as root, g.n, g.n_near, g.form_n from g left join t on t.word = g.word
"""


def exact_clusters(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """All rounds of integer k-means written out one after another."""
    fit = f"len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size}"
    parts = [
        f"v as materialized (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings where {fit})",
        f"c0 as materialized (select row_number() over (order by sha256(concat('3:', vec_id))) - 1 as k, v from v qualify k < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} as materialized (select vec_id, any_value(v) as v, arg_min(k, (d, k)) as k, min(d) as d from (select v.vec_id, v.v, c.k, list_sum(list_transform(range(1, {size + 1}), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))) as d from v, c{r} c) group by vec_id)")
        if r < rounds:
            parts.append(f"m{r} as materialized (select k, list((s - ((s % n) + n) % n) // n order by i)::bigint[] as v from (select k, i, sum(x) as s, count(*) as n from (select k, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by k, i) group by k)")
            parts.append(f"c{r + 1} as materialized (select c.k, coalesce(m.v, c.v) as v from c{r} c left join m{r} m on m.k = c.k)")
    return "with " + ",\n".join(parts) + f"""
select vec_id, a.k::int as cluster, d::bigint as distance, (sum(d) over (partition by a.k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on c.k = a.k"""


OP12 = exact_clusters()

OP13 = r"""
with recursive v as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
e as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.98),
n as (select a, count(*) as n from e group by a),
s(node, seen) as (select distinct a, a from e union select e.b, s.seen from s join e on e.a = s.node),
r as (select node, min(seen) as least_ from s group by node)
select d.vec_id, coalesce(n.n, 0) as n_links, least(d.vec_id, coalesce(r.least_, d.vec_id)) as component_id, d.vec_id = component_id as kept
from embeddings d left join n on n.a = d.vec_id left join r on r.node = d.vec_id
"""

ORACLES = {
    "op2_signature_tree_join": OP2,
    "op5_suffix_array_line_dedup": OP5,
    "op7_super_kmer_dedup": OP7,
    "op9_positional_index": OP9,
    "op11_pigeonhole_spelling": OP11,
    "op12_exponion_clusters": OP12,
    "op13_quantised_near_vectors": OP13,
}
