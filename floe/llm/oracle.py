"""DuckDB SQL of the training-data queries that SQL can express."""

WORDS = (r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
         r" 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")

OP5 = f"""
with item as (select cast(item_id as varchar) item_id, {WORDS} w from benchmark where item_id is not null),
win as (
  select distinct item_id, least(len(w), 10) size,
         array_to_string(w[i:i + least(len(w), 10) - 1], ' ') g
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from item where len(w) > 0)),
doc as (select doc_id, {WORDS} w from documents),
place as (
  select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') g
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) i
        from doc, (select distinct size from win) where len(w) >= size)),
hit as (select p.doc_id, p.i, p.size, win.item_id from place p join win using (g, size)),
covered as (
  select doc_id, count(distinct x) n_hit
  from (select doc_id, unnest(range(i, i + size)) x from (select distinct doc_id, i, size from hit)) group by 1),
named as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) items
          from (select distinct doc_id, item_id from hit) group by 1)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit,
       cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(items, '')) items_sha256,
       coalesce(n_hit, 0) > 0 contaminated
from doc d left join covered using (doc_id) left join named using (doc_id)
"""

OP1 = """
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
last as (select conv_id, turn, role, text from t
         qualify row_number() over (partition by conv_id order by turn desc, role desc, text desc) = 1),
side as (
  select conv_id, 'chosen' side, turn, role, text from t
  union all select t.conv_id, 'rejected', t.turn, t.role, t.text from t join last l using (conv_id)
            where not (t.turn = l.turn and t.role is not distinct from l.role and t.text is not distinct from l.text)
  union all select a.conv_id, 'rejected', a.turn, b.role, b.text from last a join last b on b.conv_id = xor(a.conv_id, 1)),
placed as (
  select *, row_number() over (partition by conv_id, side order by turn, role, text) i,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) s from side),
differ as (
  select coalesce(a.conv_id, b.conv_id) conv_id, min(coalesce(a.i, b.i)) i
  from (from placed where side = 'chosen') a full join (from placed where side = 'rejected') b
    on a.conv_id = b.conv_id and a.i = b.i
  where a.i is null or b.i is null or a.role is distinct from b.role or a.text is distinct from b.text group by 1),
cut as (
  select p.*, coalesce(d.i, 1000000000) d,
         sum(length(s)) over (partition by p.conv_id, side, p.i >= coalesce(d.i, 1000000000) order by p.i) stop
  from placed p left join differ d using (conv_id))
select conv_id pair_id,
  cast(count(*) filter (side = 'chosen' and i < d) as integer) n_prefix,
  coalesce(string_agg(s, '' order by i) filter (side = 'chosen' and i < d), '') prompt,
  coalesce(string_agg(s, '' order by i) filter (side = 'chosen' and i >= d), '') chosen,
  coalesce(string_agg(s, '' order by i) filter (side = 'rejected' and i >= d), '') rejected,
  coalesce(string_agg((stop - length(s) + 4 + length(role) + 1) || '-' || stop, ',' order by i)
           filter (side = 'chosen' and i >= d and role = 'assistant'), '') chosen_spans,
  coalesce(string_agg((stop - length(s) + 4 + length(role) + 1) || '-' || stop, ',' order by i)
           filter (side = 'rejected' and i >= d and role = 'assistant'), '') rejected_spans
from cut group by 1
"""

OP3 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) e
  from embeddings where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1),
         lambda i: q.e[i] * c.e[i])) as bigint) score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e))
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) "rank",
       vec_id, score
from s qualify "rank" <= 5
"""

# The table of CRC-32 by its rule (polynomial 0xEDB88320, lowest bit first).
CRC_TABLE = """crc_table as (
  select list(c order by i) t
  from (select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                              lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) c from range(256) r(i)))"""


def crc32(text: str) -> str:
    """CRC-32 of a text of code points below 256, given ``t`` of crc_table."""
    octets = (f"flatten(list_transform(string_split({text}, ''), lambda x: case when unicode(x) < 128"
              " then [unicode(x)::bigint] else [(192 + unicode(x) // 64)::bigint, (128 + unicode(x) % 64)::bigint] end))")
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}),"
            " lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


OP11 = f"""
with {CRC_TABLE},
placed as (
  select conv_id, coalesce(role, '') "role", coalesce(text, '') "text",
         row_number() over (partition by conv_id order by turn nulls first,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) i
  from conversations where conv_id is not null),
plan as (
  select conv_id, n, h, least(h, coalesce(base_n, 0)) m, base
  from (select conv_id, n, {crc32("conv_id::varchar")} % 6 h, conv_id - conv_id % 100 base
        from (select conv_id, count(*) n from placed group by 1), crc_table)
  left join (select conv_id base, count(*) base_n from placed group by 1) using (base)),
built as (
  select p.conv_id, i - h + m d, "role", "text" from placed p join plan using (conv_id) where i > h
  union all select plan.conv_id, i, "role", "text" from plan join placed b on b.conv_id = base and i <= m),
path as (
  select conv_id, d, length("text") chars, md5(string_agg(length("role") || ':' || "role" || length("text") || ':' || "text", ''
         order by d) over w) k from built window w as (partition by conv_id order by d)
  union all select conv_id, 0, 0, '' from plan),
above as (select a.conv_id, a.d, a.k, coalesce(b.k, '') parent from path a left join path b on a.conv_id = b.conv_id and b.d = a.d - 1),
last as (select conv_id, k from path qualify d = max(d) over (partition by conv_id)),
ends as (select k, string_agg(conv_id::varchar, ',' order by conv_id) l from last group by 1),
node as (select k, d depth, min(conv_id) conv_id, count(*) n_convs, min(chars) chars from path group by 1, 2),
kid as (select parent k, count(distinct k) n_children from above where d > 0 group by 1),
own as (select node.*, min(parent) parent, coalesce(min(n_children), 0) n_children
        from node join above using (k) left join kid using (k) group by all),
below as (select distinct a.k top, b.k from path a join path b on a.conv_id = b.conv_id and b.d >= a.d),
subtree as (select top k, count(*) filter (n_children = 0) n_leaves, sum((n_convs - 1) * chars) saved
            from below join own using (k) group by 1)
select o.conv_id, cast(o.depth as bigint) depth, case when o.depth > 0 then p.conv_id end parent_conv_id, o.n_convs,
       o.n_children, n_leaves, cast(saved as bigint) saved_tokens, sha256(coalesce(l, '')) ends_sha256
from own o join own p on p.k = o.parent join subtree on subtree.k = o.k left join ends on ends.k = o.k
"""

OP12 = f"""
with recursive {CRC_TABLE},
run as (
  select doc_id, w, count(*) k
  from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) w from documents) group by 1, 2),
hashed as (select w, k, {crc32("coalesce(doc_id::varchar, '') || ':' || w")} h from run, crc_table),
word as (
  select case when h % 199 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end word,
         cast(sum(k) as bigint) n
  from hashed group by 1 having sum(k) >= 5 and length(word) >= 6),
cut as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) rest
        from (select word, n, unnest(range(1, length(word) + 1)) i from word)),
pair as (
  select a.word, b.word other, b.n from cut a join cut b using (i, rest) where a.word <> b.word
  union select a.word, b.word, b.n from cut a join word b on a.rest = b.word
  union select b.word, a.word, a.n from cut a join word b on a.rest = b.word),
best as (select word, count(*) over (partition by word) n_near, other, n other_n from pair
         qualify row_number() over (partition by word order by n desc, other) = 1),
formed as (
  select word, n, coalesce(n_near, 0) n_near, case when other_n >= 5 * n then other end form,
         case when other_n >= 5 * n then other_n end form_n from word left join best using (word)),
chain as (
  select word, word root, 0 steps from formed
  union all select c.word, f.form, steps + 1 from chain c join formed f on f.word = c.root where f.form is not null)
select word, form, root, n, n_near, form_n
from formed join (select word, arg_max(root, steps) root from chain group by 1) using (word)
"""

OP13 = """
with recursive v as (
  select vec_id, cast(embedding as double[]) e, coalesce(len(embedding) > 0 and len(list_filter(
         embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0,
         false) ok
  from embeddings),
link as (select a.vec_id, b.vec_id other from v a join v b on a.ok and b.ok and a.vec_id <> b.vec_id
         and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (
  select vec_id, vec_id root from v
  union select reach.vec_id, other from reach join link on link.vec_id = reach.root)
select vec_id, (select count(*) from link where link.vec_id = v.vec_id) n_links, component_id, vec_id = component_id kept
from v join (select vec_id, min(root) component_id from reach group by 1) using (vec_id)
"""

SQL = {"op1_preference_formatting": OP1, "op3_mtree_top5": OP3, "op5_prefix_filter_decontamination": OP5,
       "op11_prefix_trie_collapse": OP11, "op12_permuterm_variants": OP12, "op13_itq_near_vectors": OP13}
