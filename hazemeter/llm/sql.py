"""The corpus queries as DuckDB SQL, where SQL can say them. They are written from the definitions, not from the operators."""

# Words of ASCII letters and digits and any other characters, ASCII letters in lower case.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = rf"""
with doc as (select doc_id, {_WORDS} as w from documents),
item as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
item_size as (select *, least(10, len(w)) as n from item where len(w) > 0),
item_window as (
  select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select *, unnest(range(1, len(w) - n + 2)) as i from item_size)
),
sizes as (select distinct n from item_window),
doc_window as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, sizes where len(w) >= n)
),
met as (select doc_id, i, n, item from doc_window join item_window using (n, win)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from met) group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item from met) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit using (doc_id) left join named using (doc_id)
"""

EXACT = r"""
with doc as (
  select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents
),
best as (
  select t, first(doc_id order by points desc, doc_id) as keep_id, count(*) as group_size from doc group by t
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from doc join best using (t)
"""

LINES = r"""
with raw as (
  select doc_id, unnest(string_split(text, e'\n')) as l, generate_subscripts(string_split(text, e'\n'), 1) - 1 as pos
  from documents where text is not null
),
mark as (select doc_id, pos, trim(l, e'\t\r\x0b\x0c ') as t from raw where trim(l, e'\t\r\x0b\x0c ') <> ''),
win as (
  select doc_id, pos, lead(pos, 1) over w as pos2, lead(pos, 2) over w as pos3, t, lead(t, 1) over w as t2, lead(t, 2) over w as t3
  from mark window w as (partition by doc_id order by pos)
),
ranked as (select *, row_number() over (partition by t, t2, t3 order by doc_id, pos) as nth from win where pos3 is not null),
alone as (
  select doc_id, pos, row_number() over (partition by t order by doc_id, pos) as nth
  from mark where length(t) - length(replace(t, ' ', '')) >= 19
),
gone as (
  select doc_id, unnest([pos, pos2, pos3]) as pos, true as gone from ranked where nth > 1
  union
  select doc_id, pos, true from alone where nth > 1
),
kept as (
  select doc_id, string_agg(l, e'\n' order by pos) filter (where gone is null) as text, count(*) as n_lines, count(gone) as n_deleted
  from raw left join gone using (doc_id, pos) group by doc_id
)
select doc_id, case when d.text is null then null else coalesce(k.text, '') end as text,
  coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted
from documents d left join kept k using (doc_id)
"""

URLS = r"""
with capture as (
  select page_id, url, date '2024-01-01' + cast(('0x' || substr(md5(url), 1, 4))::int % 366 as int) as day,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) as section
  from pages
),
host as (select distinct rtrim(host, '.') as host from capture where host <> ''),
name as (select distinct unnest([host, regexp_replace(host, '^[^.]*\.([^.]+\.)', '\1')]) as pattern from host),
numbered as (select pattern, ('0x' || substr(md5(pattern), 1, 4))::int as n from name),
started as (select *, date '2023-11-01' + cast(n % 300 as int) as day from numbered where n % 5 < 2),
entry as (
  select 'hosts' as list, pattern, day, true as listed from started
  union all select 'hosts', pattern, day + 90, false from started
  union all select 'hosts', pattern, day + 200, true from started where n % 3 = 0
  union all
  select 'paths', pattern, date '2024-01-01' + cast(n % 300 as int), true
  from (select pattern, ('0x' || substr(md5(pattern), 1, 4))::int as n
        from (select distinct rtrim(host, '.') || '/' || section as pattern from capture where host <> '' and section <> ''))
  where n % 7 = 0
),
valid as (
  select list, pattern, day as since, listed, coalesce(lead(day) over (partition by list, pattern order by day), date '9999-12-31') as until from entry
),
label as (select distinct url, string_split(rtrim(host, '.'), '.') as l, section from capture where host <> ''),
domain as (
  select url, section, array_to_string(l[i:], '.') as d
  from (select *, unnest(range(1, greatest(len(l) - 1, 1) + 1)) as i from label)
),
pattern as (select url, d as pattern from domain union select url, d || '/' || section from domain where section <> ''),
met as (
  select c.page_id, v.list, v.pattern, v.since
  from capture c join pattern p using (url) join valid v on v.pattern = p.pattern and v.listed and c.day >= v.since and c.day < v.until
),
best as (
  select page_id, count(*) as n_entries, string_agg(distinct list, ',' order by list) as lists,
    first(pattern order by length(pattern) desc, pattern desc, since desc) as pattern,
    first(since order by length(pattern) desc, pattern desc, since desc) as since
  from met group by page_id
)
select c.page_id, c.url, c.day, coalesce(n_entries, 0) as n_entries, coalesce(lists, '') as lists, pattern, since, n_entries is not null as blocked
from capture c left join best using (page_id)
"""

_CLUSTERS, _ROUNDS = 16, 3


def _assign(n: int) -> str:
    """Every vector with the nearest of the centroids of round ``n``, the smaller number of equals."""
    return f"""
nearest{n} as (
  select row, any_value(vec_id) as vec_id, any_value(w) as w, min([d, c]) as best
  from (select row, vec_id, w, c, list_sum(list_transform(list_zip(w, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept, centroids{n})
  group by row
)"""


def _move(n: int) -> str:
    """Centroids of round ``n`` from vectors assigned to those before; empty ones stay."""
    return f"""
sums{n} as (
  select c, i, sum(x)::bigint as s, count(*) as n
  from (select best[2] as c, unnest(w) as x, unnest(range(1, 65)) as i from nearest{n - 1}) group by c, i
),
moved{n} as (select c, list((s - ((s % n) + n) % n) // n order by i) as v from sums{n} group by c),
centroids{n} as (select c, coalesce(m.v, o.v) as v from centroids{n - 1} o left join moved{n} m using (c))"""


CENTROIDS = f"""
with kept as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as w
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64
),
centroids0 as (
  select c::bigint as c, w as v from (select w, row_number() over (order by sha256(concat('1:', vec_id)), w) - 1 as c from kept) where c < {_CLUSTERS}
),{",".join(_assign(n - 1) + "," + _move(n) for n in range(1, _ROUNDS + 1))},{_assign(_ROUNDS)}
select vec_id, best[2]::int as cluster, best[1] as distance, (sum(best[1]) over (partition by best[2]))::bigint as cluster_inertia,
  (sum(best[1]) over ())::bigint as inertia, sha256(array_to_string(v, ',')) as centroid_sha256
from nearest{_ROUNDS} join centroids{_ROUNDS} on c = best[2]
"""

STATEMENTS = {
    "op12_centroid_clustering": CENTROIDS,
    "op2_decontamination": DECONTAMINATION,
    "op5_exact_dedup": EXACT,
    "op6_line_dedup": LINES,
    "op8_url_filters": URLS,
}
