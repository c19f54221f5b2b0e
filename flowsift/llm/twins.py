"""SQL twins of corpus queries that SQL can express; they take ids as unique and not null."""

EMBEDDING_LINKS = """
with recursive
usable as (
  select vec_id, embedding::double[] as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b
  on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
reached as (
  select vec_id as node, vec_id as other from embeddings
  union
  select node, b from reached join links on a = other)
select v.vec_id, coalesce(n.n_links, 0)::bigint as n_links, r.component_id, v.vec_id = r.component_id as kept
from embeddings v join (select node, min(other) as component_id from reached group by node) r on r.node = v.vec_id
left join (select a, count(*) as n_links from links group by a) n on n.a = v.vec_id
"""

MERKLE_MANIFEST = """
with recursive
marked as (
  select *, list_reduce(
    list_prepend(4294967295::ubigint, flatten(list_transform(
      string_split(doc_id::varchar, ''), lambda c: list_prepend(ascii(c)::ubigint, list_transform(range(8), lambda x: 256::ubigint))))),
    lambda crc, b: case when b < 256 then xor(crc, b) else xor(crc >> 1, 3988292384::ubigint * (crc & 1)) end) as reg
  from documents),
texts as (
  select doc_id, source, lang, n_chars, text,
    case when xor(reg, 4294967295::ubigint) % 2 = 0 then replace(text, chr(10), '') else text end as found
  from marked),
parts as (
  select doc_id, coalesce('s' || source, '') as tree, found,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as own, coalesce(strlen(found) || ':' || found, '-') as other
  from texts),
leaves as (
  select doc_id, tree, sha256(head || own) as digest, sha256(head || other) as found_leaf from parts),
ranked as (
  select *, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 as rank,
    count(*) over (partition by tree) as n from leaves),
up as (
  select tree, 0 as level, rank as idx, digest, n from ranked
  union all
  select tree, level + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), (max(n) + 2) // 3
  from up where n > 1 group by tree, level, idx // 3),
tops as (
  select tree, digest, row_number() over (order by tree) - 1 as rank, count(*) over () as n from up where n = 1),
above as (
  select 0 as level, rank as idx, digest, n from tops
  union all
  select level + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), (max(n) + 2) // 3
  from above where n > 1 group by level, idx // 3),
nodes as (
  select 't' || tree as tree, level, idx, digest from up where n > 1
  union all select '', level, idx, digest from above where n > 1),
steps as (
  select a.tree, a.level, a.idx,
    coalesce(string_agg(b.digest, '' order by b.idx) filter (where b.idx < a.idx), '') as earlier,
    coalesce(string_agg(b.digest, '' order by b.idx) filter (where b.idx > a.idx), '') as later
  from nodes a join nodes b on a.tree = b.tree and a.level = b.level and a.idx // 3 = b.idx // 3
  group by a.tree, a.level, a.idx),
low as (
  select tree as t, rank as r, 0 as level, rank as idx, found_leaf as reached, '' as proof from ranked
  union all
  select t, r, low.level + 1, low.idx // 3, sha256(earlier || reached || later), proof || earlier || later
  from low join steps s on s.tree = 't' || low.t and s.level = low.level and s.idx = low.idx),
low_end as (select t, r, arg_max(reached, level) as reached, arg_max(proof, level) as proof from low group by t, r),
high as (
  select t, r, 0 as level, p.rank as idx, reached, proof from low_end join tops p on p.tree = t
  union all
  select t, r, high.level + 1, high.idx // 3, sha256(earlier || reached || later), proof || earlier || later
  from high join steps s on s.tree = '' and s.level = high.level and s.idx = high.idx),
high_end as (select t, r, arg_max(reached, level) as reached, arg_max(proof, level) as proof from high group by t, r)
select l.doc_id, l.digest as leaf, p.digest as subroot, o.digest as root, sha256(e.proof) as proof_sha256,
  e.reached as folded_root, e.reached = o.digest as verified
from ranked l join tops p using (tree) join high_end e on e.t = l.tree and e.r = l.rank
cross join (select digest from above where n = 1) o
"""
