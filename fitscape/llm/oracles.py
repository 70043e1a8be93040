"""DuckDB SQL of the queries that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_OP2 = f"""with d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, {_ALNUM}), []) as w from documents),
b as (select item_id::varchar as item, regexp_extract_all({_LOWER}, {_ALNUM}) as w from benchmark where text is not null),
phrases as (select distinct item, least(13, len(w)) as k, array_to_string(w[i : i + 12], ' ') as g from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
windows as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from phrases))),
found as (select doc_id, i, k, item from windows join phrases using (k, g)),
hits as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + k)) as p from (select distinct doc_id, i, k from found)) group by 1),
items as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from found where item is not null) group by 1)
select d.doc_id, len(w) as n_words, coalesce(h.n, 0) as n_hit, coalesce(t.n, 0) as n_items, sha256(coalesce(t.ids, '')) as items_sha256, coalesce(h.n, 0) > 0 and 20 * coalesce(h.n, 0) >= len(w) as contaminated
from d left join hits h using (doc_id) left join items t using (doc_id)"""

_OP6 = f"""with d as (select doc_id, coalesce(regexp_extract_all(text, {_WORD}), []) as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
late as (select doc_id, i from windows qualify min(doc_id) over (partition by g) < doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from late),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from d),
kept as (select w.doc_id, string_agg(w.word, ' ' order by w.p) as t from words w left join gone g on g.doc_id = w.doc_id and g.p = w.p where g.p is null group by 1)
select d.doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join (select doc_id, count(*) as n from gone group by 1) using (doc_id) left join kept using (doc_id)"""

_OP7 = f"""with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text, coalesce(regexp_extract_all(text, {_WORD}), []) as w from documents),
eights as (select doc_id, i, array_to_string(w[i : i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)),
twice as (select doc_id, i from eights qualify count(*) over (partition by doc_id, g) > 1),
repeated as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(i, i + 8)) as p from twice) group by 1),
lines as (select doc_id, host, text, unnest(string_split(text, chr(10))) as line from d),
own as (select *, translate(trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g')), '123456789', '000000000') as tidy, len(regexp_extract_all(line, {_WORD})) as lw from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
texts as (select host, count(distinct text) as n from d group by 1),
hot as (select host, tidy from own join texts using (host) group by host, tidy, n having count(distinct text) > 20 and count(distinct text) > 0.02 * n),
hotwords as (select doc_id, sum(lw)::bigint as n from own join hot using (host, tidy) group by 1),
x as (select d.doc_id, len(w) as n_words, len(array_to_string(w, '')) as word_chars, len(regexp_extract_all(d.text, '[#*$%&|<>]')) as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, coalesce(h.n, 0) as n_hot_words
from d left join (select doc_id, count(*) - count(distinct line) as n from own group by 1) l using (doc_id) left join repeated r using (doc_id) left join hotwords h using (doc_id))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_words - n_hot_words >= 0.3 * n_words as kept from x"""

_OP9 = f"""with recursive d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, {_WORD}), []) as w from documents),
sh as (select distinct doc_id, md5(array_to_string(w[i : i + 4], ' ')) as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by 1),
links as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as o from sh x join sh y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2) join n p on p.doc_id = a join n q on q.doc_id = b where 100 * o >= 80 * (p.n + q.n - o)),
both_ways as (select a, b from links union select b, a from links),
reach as (select a as doc_id, a as r from both_ways union select reach.doc_id, b from reach join both_ways on a = r)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.r, d.doc_id)) as component_id from d left join n using (doc_id) left join (select doc_id, min(r) as r from reach group by 1) m using (doc_id)"""

_OP11 = """with d as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
tops as (select payload_digest, max(page_id) as top from d where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, payload_digest, case when top is not null and page_id is distinct from top then 'revisit' else 'response' end as record_type, case when page_id is distinct from top then top end as refers_to
from d left join tops using (payload_digest)"""


def _vectors(scale: int, keep: str = "true") -> str:
    """rid, vec_id, label and v, the integer components of whole vectors."""
    return f"""select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: floor(x::double * {scale})::bigint) as v from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and {keep}"""


_FLOOR_MEAN = "((s - ((s % n) + n) % n) // n)::bigint"


def _op12(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    found = f"select rid, p, min(d * {entries} + e) as m from (select x.rid, x.p, e, sum((x.y - b.y) * (x.y - b.y)) as d from x join {{book}} b using (p, j) group by 1, 2, 3) group by 1, 2"
    ctes = [
        f"kept as materialized ({_vectors(scale)})", f"x as materialized (select rid, (i - 1) // (len(v) // {parts}) as p, (i - 1) % (len(v) // {parts}) as j, v[i] as y from (select rid, v, unnest(range(1, len(v) + 1)) as i from kept))",
        f"b0 as materialized (select p, e, j, y from x join (select rid, row_number() over (order by vec_id) - 1 as e from kept) using (rid) where e < {entries})",
    ]
    for k in range(rounds):
        ctes.append(f"a{k} as materialized ({found.format(book=f'b{k}')})")
        ctes.append(f"""b{k + 1} as materialized (select b.p, b.e, b.j, case when n > 0 then {_FLOOR_MEAN} else b.y end as y from b{k} b
 left join (select p, m % {entries} as e, j, count(*) as n, sum(y) as s from a{k} join x using (rid, p) group by 1, 2, 3) using (p, e, j))""")
    ctes.append(f"a{rounds} as materialized ({found.format(book=f'b{rounds}')})")
    ctes.append(f"coded as (select vec_id, label, code, error from kept join (select rid, string_agg(printf('%02x', (m % {entries})::int), '' order by p) as code, sum(m // {entries})::bigint as error from a{rounds} group by 1) using (rid))")
    return f"""with {', '.join(ctes)} select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select sha256(string_agg(y::varchar, ',' order by p, e, j)) from b{rounds}) as codebooks_sha256 from coded"""


def _op13(clusters: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> str:
    found = f"select rid, min(d * {clusters} + e) as m from (select x.rid, e, sum((x.y - b.y) * (x.y - b.y)) as d from x join {{book}} b using (j) group by 1, 2) group by 1"
    ctes = [
        f"kept as materialized ({_vectors(scale, 'len(embedding) = 64')})", "x as materialized (select rid, unnest(range(1, 65)) as j, unnest(v) as y from kept)",
        f"b0 as materialized (select e, j, y from x join (select rid, row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as e from kept) using (rid) where e < {clusters})",
    ]
    for k in range(rounds):
        ctes.append(f"a{k} as materialized ({found.format(book=f'b{k}')})")
        ctes.append(f"b{k + 1} as materialized (select b.e, b.j, case when n > 0 then {_FLOOR_MEAN} else b.y end as y from b{k} b left join (select m % {clusters} as e, j, count(*) as n, sum(y) as s from a{k} join x using (rid) group by 1, 2) using (e, j))")
    ctes.append(f"a{rounds} as materialized ({found.format(book=f'b{rounds}')})")
    return f"""with {', '.join(ctes)}, digests as (select e, sha256(string_agg(y::varchar, ',' order by j)) as h from b{rounds} group by 1)
select vec_id, (m % {clusters})::int as cluster, (m // {clusters})::bigint as distance, (sum(m // {clusters}) over (partition by m % {clusters}))::bigint as cluster_inertia, (sum(m // {clusters}) over ())::bigint as inertia, h as centroid_sha256
from kept join a{rounds} using (rid) join digests on e = m % {clusters}"""


ORACLES = {
    "op2_decontaminate": _OP2, "op6_substring_dedup": _OP6, "op7_line_quality": _OP7, "op9_prefix_join": _OP9, "op11_warc_captures": _OP11, "op12_vector_codes": _op12(), "op13_simplex_clusters": _op13(),
}
