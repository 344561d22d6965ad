"""DuckDB SQL for the corpus queries that SQL can express; tables of some thousand rows, as it compares all with all."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
 win as (select doc_id, i, array_to_string(ws[i:i+19], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws)-18)) as i from w where len(ws) >= 20) t),
 again as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from win) t where k > 1),
 gone as (select distinct doc_id, i + k as p from (select doc_id, i, unnest(range(20)) as k from again) t),
 kept as (select a.doc_id, string_agg(a.word, ' ' order by a.p) as text, count(*) as n from
  (select doc_id, p, ws[p] as word from (select doc_id, ws, unnest(range(1, len(ws)+1)) as p from w) t) a left join gone g on g.doc_id = a.doc_id and g.p = a.p where g.p is null group by a.doc_id)
 select w.doc_id, len(w.ws) as n_words, len(w.ws) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (doc_id)"""

#: From links(a, b) and nodes(id): the smallest id that each can reach.
REACH = """reach(id, other) as (select id, id from nodes union select r.id, l.b from reach r join both_ways l on l.a = r.other),
 lowest as (select id, min(other) as component_id from reach group by id)"""

OP6 = f"""with recursive w as (select doc_id, regexp_extract_all(coalesce({LOWER}, ''), '{WORD}') as ws from documents),
 sh as (select distinct doc_id, array_to_string(ws[i:i+4], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(len(ws)-4, 1)+1)) as i from w where len(ws) > 0) t),
 n as (select doc_id, count(*) as n from sh group by doc_id),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
 links as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100*p.c >= 75*(x.n + y.n - p.c)),
 both_ways as (select a, b from links union all select b, a from links), nodes as (select doc_id as id from documents), {REACH}
 select d.doc_id, coalesce(n.n, 0) as n_shingles, l.component_id, d.doc_id = l.component_id as kept from documents d left join n using (doc_id) join lowest l on l.id = d.doc_id"""

VALID = "embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"

OP8 = f"""with v as (select vec_id, list_transform(embedding, lambda x: floor(256*cast(x as double))) as q from embeddings where {VALID}),
 s as (select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
 select query_id, cast(r as int) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s) t where r <= 5"""

OP10 = f"""with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings where {VALID} and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 u as (select vec_id, e, sqrt(list_inner_product(e, e)) as size from v),
 both_ways as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_inner_product(a.e, b.e)/(a.size*b.size) >= 0.9),
 nodes as (select vec_id as id from embeddings), {REACH}, c as (select a as id, count(*) as n from both_ways group by a)
 select l.id as vec_id, coalesce(c.n, 0) as n_links, l.component_id, l.id = l.component_id as kept from lowest l left join c using (id)"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP11 = f"""with d as (select row_number() over () as r, doc_id, regexp_extract_all({LOWER}, '{TERM}') as ws from documents where text is not null),
 size as (select r, doc_id, len(ws) as n from d where len(ws) > 0), total as (select count(*) as docs, sum(n) as terms from size),
 tf as (select r, term, count(*) as tf from (select r, unnest(ws) as term from d) t group by r, term),
 asked as (select distinct item_id, unnest(regexp_extract_all({LOWER}, '{TERM}')) as term from benchmark where item_id is not null),
 df as (select term, count(*) as df from tf group by term),
 w as (select a.item_id, a.term, cast(floor(1000*ln((2.0*docs+2)/(2*df+1))) as bigint) as w from asked a join df using (term), total),
 s as (select w.item_id, s.doc_id, s.r, cast(sum(w.w*((1000000000*tf.tf)//(1000*tf.tf+20*(50+(50*s.n*docs)//terms)))) as bigint) as score
  from w join tf using (term) join size s using (r), total group by w.item_id, s.doc_id, s.r)
 select item_id, cast(rank as int) as rank, doc_id, score from
  (select *, row_number() over (partition by item_id order by score desc, doc_id nulls first) as rank from s where score > 0) t where rank <= 50"""

OP12 = f"""with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
 firsts as (select t, min(doc_id) as first from w group by t),
 l as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id),
 f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [len(ws) < 200, 100*len(list_distinct(ws)) < 50*len(ws), 100*len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2*length(t),
  regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] as fails from w join firsts using (t) left join l using (doc_id)),
 m as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails),
 letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
 orders as (select a.c||b.c||c.c||d.c||e.c as o from letters a, letters b, letters c, letters d, letters e where a.c not in (b.c, c.c, d.c, e.c) and b.c not in (c.c, d.c, e.c) and c.c not in (d.c, e.c) and d.c <> e.c),
 gone_at as (select part, n, good, toxic, fails, o, list_min([case when fails[i] then instr(o, substr('ABCDE', i, 1)) else 6 end for i in range(1, 6)]) as gone from m, orders),
 s as (select part, o, step, ascii(substr(o, step, 1)) - 64 as f, n, good, toxic, fails, gone from gone_at, (select unnest(range(1, 6)) as step) t),
 g as (select part, o as filter_order, step, f, sum(case when gone > step then n else 0 end) as kept, sum(case when gone = step then n else 0 end) as removed,
  sum(case when fails[f] and gone < step then n else 0 end) as redundant, sum(case when fails[f] and len(list_filter(fails, lambda x: x)) = 1 then n else 0 end) as unique_fails,
  sum(case when gone = step then good else 0 end) as good_lost, sum(case when gone = step then toxic else 0 end) as toxic_lost from s group by part, o, step, f)
 select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from g"""

ORACLES = {"op2_substring_dedup": OP2, "op6_near_duplicates": OP6, "op8_top_k": OP8, "op10_embedding_duplicates": OP10, "op11_lexical_search": OP11, "op12_filter_audit": OP12}
