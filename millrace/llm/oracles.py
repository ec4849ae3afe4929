"""DuckDB SQL of those pN queries that SQL can express exactly."""

from __future__ import annotations

_D = "d as (select cast(id as varchar) as id, coalesce(text, '') as text from synth_records where id is not null group by all)"
_STRIP = r"translate(lower(regexp_replace({}, '[^\p{{L}}\p{{Nd}}]+', '', 'g')), 'ς', 'σ')"
_LABEL = r"^[^\p{L}\p{N}]*\p{L}+([\s\x0b\x1c-\x1f\x85\p{Z}\p{Cf}]+\p{L}+){0,2}[\s\x0b\x1c-\x1f\x85\p{Z}\p{Cf}]*[:=]"
_CONTENT = rf"""{_D},
  p as (select id, text, list_filter(regexp_split_to_array(text, '[\n;|]'), lambda x: regexp_matches(x, '[\p{{L}}\p{{Nd}}]')) as ps from d),
  c as (select id, {_STRIP.format("text")} as plain,
          case when len(ps) >= 3 and len(list_filter(ps, lambda x: not regexp_matches(x, '{_LABEL}'))) = 0
               then '|' || array_to_string(list_sort(list_transform(ps, lambda x: {_STRIP.format("x")})), '|') else {_STRIP.format("text")} end as content from p),
  sets as (select content, min(id) as keep_id, count(distinct id) as n from c where length(plain) >= 20 group by content)"""
_LINKS = """l as (select id_a as a, id_b as b from match_pairs where similarity >= 0.5 and id_a <> id_b
           union all select m[1], unnest(m) from (select list_filter(unnest(clusters), lambda x: x is not null) as m from duplicates) where len(m) > 1),
  e as (select a, b from l where a <> b union select b, a from l where a <> b)"""

_RUNS = f"""{_CONTENT}, t as (select id, content, regexp_extract_all(lower(text), '[a-z0-9]+') as w from c join d using (id)),
  u as (select distinct id, content, md5(array_to_string(w, ' ')) as words, w from t where len(w) >= 20),
  g as (select row_number() over () as g, content, words, any_value(w) as w from u group by content, words),
  sh as (select g, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) as s from g),
  n as (select g, count(*) as n from sh group by g),
  k as (select x.g as a, y.g as b, count(*) as k from sh x join sh y on x.s = y.s and x.g < y.g group by all),
  sim as (select a, b from k join n na on na.g = a join n nb on nb.g = b join g ga on ga.g = a join g gb on gb.g = b where ga.content <> gb.content and k >= 0.5 * (na.n + nb.n - k)),
  m as (select distinct g.g, u.id from u join g using (content, words))"""

ORACLES = {
    "p2_found": f"with {_RUNS} select distinct least(x.id, y.id) as id_a, greatest(x.id, y.id) as id_b from sim join m x on x.g = a join m y on y.g = b where x.id <> y.id",
    "p2_groups": f"""with recursive {_RUNS}, e as (select a, b from sim union select b, a from sim),
        r as (select distinct a as g, a as other from e union select r.g, e.b from r join e on e.a = r.other),
        heads as (select other, min(m.id) as head from (select g, min(other) as other from r group by g) h join m using (g) group by other),
        links as (select a as g, count(*) as n_links from e group by a)
        select m.id, heads.head as group_id, n_links from m join links using (g) join (select g, min(other) as other from r group by g) h using (g) join heads using (other)""",
    "p6_checked": "select spec_name, (select count(distinct doc_id) from documents) as documents, cast(0 as bigint) as over_full, cast(0 as bigint) as split from (select distinct spec_name from pack_specs where capacity_tokens > 0)",
    "p7_checked": "select source, count(*) as documents, cast(0 as bigint) as above_cap from (select distinct doc_id, source from documents) group by source",
    "p1_found": f"with {_CONTENT} select distinct keep_id, id as copy_id from c join sets using (content) where length(plain) >= 20 and id > keep_id",
    "p1_collapsed": f"""with {_CONTENT}, copies as (select distinct keep_id, id from c join sets using (content) where length(plain) >= 20 and id > keep_id)
        select id as keep_id, cast(1 + (select count(*) from copies where copies.keep_id = d.id) as bigint) as n_copies from (select distinct id from d) d where id not in (select id from copies)""",
    "p4_found": f"""with recursive {_LINKS}, r as (select distinct a as id, a as other from e union select r.id, e.b from r join e on e.a = r.other)
        select min(other) as group_id, id from r group by id having min(other) <> id""",
}
