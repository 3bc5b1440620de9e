"""DuckDB SQL for the results of the operators that SQL can express."""

_WORD_LIST = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATE = f"""
with item as (select item_id, {_WORD_LIST} as w from benchmark),
win as (
  select distinct item_id, least(10, len(w)) as size,
    array_to_string(w[p:p + least(10, len(w)) - 1], ' ') as words
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p
        from item where len(w) > 0)),
doc as (select row_number() over () as r, doc_id, {_WORD_LIST} as w from documents),
size as (select distinct size from win),
hit as (
  select r, p, s.size, w.item_id
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as p
        from doc, size where len(w) >= size) s
  join win w on w.size = s.size and w.words = array_to_string(s.w[p:p + s.size - 1], ' ')),
covered as (
  select r, count(distinct k) as n_hit
  from (select r, unnest(range(p, p + size)) as k from (select distinct r, p, size from hit))
  group by r),
items as (
  select r, count(*) as n_items, string_agg(i, ',' order by i) as ids
  from (select distinct r, cast(item_id as varchar) as i from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
  coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from doc left join covered using (r) left join items using (r)
"""

MIX = r"""
with doc as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))
    as bigint) as size, md5('17|' || coalesce(cast(doc_id as varchar), '')) as tie
  from documents),
src as (
  select source, cast(sum(size) as bigint) as source_size,
    case (row_number() over (order by source is null, source) - 1) % 3
      when 0 then 5 when 1 then 2 else 1 end as weight
  from doc group by source),
total as (select cast(sum(source_size) as bigint) as size, sum(weight) as weight from src),
step as (
  select 3.0::double * source_size / weight as full_at,
    sum(source_size) over w as sizes, sum(weight) over w as weights
  from src window w as (order by 3.0::double * source_size / weight, source
    rows between unbounded preceding and current row)),
level as (
  select lvl from (
    select weights, (t.size - 3.0::double * sizes) / (t.weight - weights) as lvl,
      (select min(n.full_at) from step n where n.weights > step.weights) as nxt
    from step, total t where t.weight > weights
    union all
    select 0, cast(t.size as double) / t.weight, (select min(full_at) from step) from total t)
  where nxt > lvl order by weights limit 1),
goal as (
  select source, source_size, least(3.0::double * source_size, lvl * weight) as target,
    cast(('0x' || substr(md5('17|' || coalesce(source, '')), 1, 5)) as bigint) / 1048576.0::double
      as shift
  from src, level),
placed as (
  select doc_id, size, source_size, target, shift,
    case when source_size > 0 then target / source_size else 0 end as each,
    row_number() over (partition by d.source order by size desc, tie, doc_id nulls first) - 1 as k
  from doc d join goal g on d.source is not distinct from g.source),
taken as (
  select *, least(cast(floor((k + 1) * each + shift) - floor(k * each + shift) as bigint),
    cast(ceil(each) as bigint)) as copies
  from placed)
select doc_id, size, source_size, target, copies * size as taken, copies from taken
"""

ARCHIVES = """
with page as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes,
    sha1(coalesce(html, '')) as sha from pages),
named as (
  select page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((cast('0x' ||
        substr(sha, cast(i // 4 * 5 + 1 as int), 5) as bigint) >> cast(15 - i % 4 * 5 as int)) & 31) + 1 as int), 1)),
      'string_agg', '') as payload_digest,
    min(page_id) over (partition by sha) as first_page
  from page)
select page_id, payload_bytes, payload_digest,
  case when page_id = first_page then 'response' else 'revisit' end as record_type,
  case when page_id <> first_page then first_page end as refers_to, 'ok' as status
from named
"""

LINKED_VECTORS = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as x from embeddings),
link as (
  select a.vec_id as a, b.vec_id as b from v a join v b
  on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.x, b.x) >= 0.93),
reach(a, b) as (
  select vec_id, vec_id from v
  union
  select reach.a, link.b from reach join link on reach.b = link.a),
part as (select a as vec_id, min(b) as component_id from reach group by a),
degree as (select a as vec_id, count(*) as n_links from link group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from part left join degree using (vec_id)
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

RANKED_SEARCH = f"""
with doc as (select row_number() over () as r, doc_id, {_TERMS} as w from documents),
size as (select r, doc_id, len(w) as n from doc where len(w) > 0),
total as (select count(*) as docs, cast(sum(n) as bigint) as terms from size),
asked as (
  select distinct i, item_id, unnest(w) as term
  from (select row_number() over () as i, item_id, {_TERMS} as w from benchmark)),
post as (
  select r, term, count(*) as tf from (select r, unnest(w) as term from doc)
  where term in (select term from asked) group by r, term),
weight as (
  select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * count(*) + 1))) as bigint) as w
  from post, total group by term, docs),
scored as (
  select i, item_id, r, doc_id, cast(sum(
    w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) as bigint) as score
  from asked join post using (term) join weight using (term) join size using (r), total
  group by i, item_id, r, doc_id)
select item_id, cast(place as integer) as rank, doc_id, score
from (select *, row_number() over (partition by i order by score desc, doc_id nulls last) as place
      from scored where score > 0)
where place <= 50
"""

# crc32 of an ASCII text, a bit at a time: each byte is followed by seven zeros
_CRC = """xor(list_reduce(list_concat([cast(4294967295 as bigint)], flatten(list_transform(
    string_split(cast(conv_id as varchar), ''), lambda c: [cast(ascii(c) as bigint), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"""

PREFIX_TRIE = f"""
with own as (
  select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
    order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
  from conversations where conv_id is not null group by conv_id),
head as (select conv_id, turns, cast({_CRC} % 9 as bigint) as h from own),
conv as (
  select c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) as turns
  from head c left join own b on b.conv_id = c.conv_id - c.conv_id % 5),
prefix as (
  select conv_id, d, turns[1:d] as node, len(turns) = d as ends
  from (select conv_id, turns, unnest(range(0, len(turns) + 1)) as d from conv)),
node as (
  select node, d, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256
  from prefix group by node, d),
kids as (select node[1:d - 1] as node, count(*) as n_children from node where d > 0 group by 1),
sums as (
  select above as node, cast(sum(leaf) as bigint) as n_leaves, cast(sum(saved) as bigint) as saved_tokens
  from (
    select unnest(list_transform(range(0, d + 1), lambda k: n.node[1:k])) as above,
      case when n_children is null then 1 else 0 end as leaf,
      case when d > 0 then (n_convs - 1) * octet_length(encode(n.node[d].text)) else 0 end as saved
    from node n left join kids k on n.node = k.node)
  group by above)
select n.conv_id, cast(n.d as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs,
  coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, n.ends_sha256
from node n left join node p on n.d > 0 and p.d = n.d - 1 and p.node = n.node[1:n.d - 1]
left join kids k on k.node = n.node join sums s on s.node = n.node
"""

ORACLES = {
    "op1_linked_vectors": LINKED_VECTORS,
    "op3_decontaminate": DECONTAMINATE,
    "op4_mix_sources": MIX,
    "op10_archives": ARCHIVES,
    "op11_ranked_search": RANKED_SEARCH,
    "op13_prefix_trie": PREFIX_TRIE,
}
