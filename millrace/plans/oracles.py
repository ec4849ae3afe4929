"""DuckDB SQL of the core queries."""

from __future__ import annotations

from millrace.functions.text import LENGTH_EDGES
from millrace.operators.rules import BOILERPLATE_MARKERS
from millrace.plans.queries import EVENTS, SQL

_WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
_W = r"\p{L}\p{M}\p{N}_"
_T = "coalesce(text, '')"
_WORDS = f"list_filter(regexp_split_to_array({_T}, '{_WS}+'), lambda w: w <> '')"
_NW = f"len({_WORDS})"
_NORM = f"trim(regexp_replace({_T}, '{_WS}+', ' ', 'g'), ' ')"
_STRIP = f"regexp_replace({_T}, '^{_WS}+|{_WS}+$', '', 'g')"
_MOJI = (
    rf"(regexp_matches({_T}, '\x{{FFFD}}|\x{{C3}}[\x{{A2}}\x{{201A}}\x{{C2}}\x{{A9}}\x{{E2}}]|\x{{E2}}\x{{201A}}\x{{AC}}|\x{{C3}}\x{{A2}}\x{{E2}}')"
    rf" or regexp_matches({_T}, '[\x00-\x09\x0b-\x1f\x7f-\x9f]'))"
)
_HITS = " + ".join(f"cast(contains(lower({_T}), '{m}') as int)" for m in BOILERPLATE_MARKERS)
_PII = (
    rf"(regexp_matches({_T}, '[{_W}][{_W}.+-]*@[{_W}-]+\.[{_W}.-]*[{_W}]')"
    rf" or regexp_matches({_T}, '\(\p{{Nd}}{{3}}\)[\s\p{{Z}}\x0b\x85]*\p{{Nd}}{{2,4}}')"
    rf" or regexp_matches({_T}, '(^|[^{_W}])\p{{Nd}}{{3}}[-.\s\p{{Z}}\x0b\x85]\p{{Nd}}{{3}}[-.\s\p{{Z}}\x0b\x85]\p{{Nd}}{{4}}($|[^{_W}])')"
    rf" or regexp_matches({_T}, '(^|[^{_W}])\p{{Nd}}{{3}}-\p{{Nd}}{{2}}-\p{{Nd}}{{4}}($|[^{_W}])'))"
)
_SENT = rf"list_filter(list_transform(regexp_split_to_array({_T}, '[.!?]+[\s\p{{Z}}\x0b\x85]+|\n+'), lambda s: lower(regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g'))), lambda s: s <> '')"
_REASONS = (
    f"concat_ws('|', case when {_STRIP} = '' then 'non_empty' end, case when {_NW} < 5 then 'min_words' end, case when {_MOJI} then 'no_mojibake' end,"
    f" case when ({_HITS}) >= 2 then 'no_boilerplate_markers' end, case when {_PII} then 'no_pii' end)"
)
_GATED = f"g as (select *, {_REASONS} as reasons from synth_records)"
_PAGES = "pages as (select cast(doc_id as varchar) as id, text, source from documents)"


def _bin(n: str) -> str:
    return "case " + " ".join(f"when {n} >= {e} then {i}" for i, e in reversed(list(enumerate(LENGTH_EDGES)))) + " end"


def _shingled(size: int, source: str, key: str, text: str) -> str:
    words = _WORDS.replace("text", text)
    return f"""
      select {key}, unnest(list_distinct(case when len(w) >= {size} then list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size} - 1], ' '))
             when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as shingle
      from (select {key}, {words} as w from {source})"""


_REPS = f"rows_ as (select id, {_NORM} as norm from %s where id is not null), reps as (select norm, min(id) as rep from rows_ group by norm)"
_PAIRS = f"""{_REPS},
  sh as ({_shingled(5, "reps", "rep", "norm")}),
  n as (select rep, count(*) as n from sh group by rep),
  c as (select x.rep as a, y.rep as b, count(*) as k from sh x join sh y on x.shingle = y.shingle and x.rep < y.rep group by all),
  pairs as (select a, b, k / (na.n + nb.n - k) as similarity from c join n na on na.rep = a join n nb on nb.rep = b where k / (na.n + nb.n - k) >= 0.8)"""
_NEAR = f"{_PAGES}, {_PAIRS % 'pages'}"
_GROUPED = """
  e as (select a, b from pairs union all select b, a from pairs),
  reach as (select rep as node, rep as other from reps union select reach.node, e.b from reach join e on e.a = reach.other),
  roots as (select node as rep, min(other) as survivor from reach group by node),
  named as (select r.id, t.survivor, p.rep = t.survivor as exact from rows_ r join reps p on r.norm = p.norm join roots t on t.rep = p.rep),
  sized as (select survivor from named group by survivor having count(*) > 1),
  clustered as (select id, survivor, case when id = survivor then 'kept' when exact then 'exact' else 'near' end as kind from named where survivor in (select survivor from sized))"""
_CLUSTERS = f"with recursive {_NEAR},{_GROUPED}"
# Bronze without quarantine.
_UNIVERSE = f"{_GATED}, u as (select id, text, gt_kind, gt_dup_of from g where id is null or id not in (select id from g where reasons <> '' and id is not null))"
_SCORED_PAIRS = f"with recursive {_UNIVERSE}, {_PAIRS % 'u'}"
_SCORED = f"{_SCORED_PAIRS},{_GROUPED}"


def _dist(name: str, source: str) -> str:
    return f"{name} as (select coalesce(source, 'None') as source, count(*) as rows, count(*) / sum(count(*)) over () as share from {source} group by 1)"


def _lens(name: str, source: str) -> str:
    return (
        f"{name} as (select b.bin, coalesce(c.rows, 0) as rows, coalesce(c.rows, 0) / (select count(*) from {source}) as share from (select unnest(range(9)) as bin) b"
        f" left join (select {_bin(_NW)} as bin, count(*) as rows from {source} group by 1) c on b.bin = c.bin)"
    )


def _psi(key: str) -> str:
    return (
        f"psi_{key} as (select coalesce(e.{key}, a.{key}) as {key}, coalesce(e.share, 0) as expected, coalesce(a.share, 0) as actual,"
        f" (greatest(coalesce(a.share, 0), 1e-4) - greatest(coalesce(e.share, 0), 1e-4)) * ln(greatest(coalesce(a.share, 0), 1e-4) / greatest(coalesce(e.share, 0), 1e-4)) as psi"
        f" from e_{key} e full join a_{key} a on e.{key} = a.{key})"
    )


_PSI_SOURCE = f"{_PAGES}, {_dist('e_source', 'pages')}, {_dist('a_source', 'synth_records')}, {_psi('source')}"
_PSI_BIN = f"{_lens('e_bin', 'documents')}, {_lens('a_bin', 'synth_records')}, {_psi('bin')}"
_OFFSETS = f"""{_PAGES}, o as (select id, {_T} as text, sha256('0/shards/' || id) as k, strlen({_T}) + 1 as tokens from pages),
  placed as (select id, text, tokens, coalesce(sum(tokens) over (order by k, id, text rows between unbounded preceding and 1 preceding), 0) as start from o)"""
_TOKENS = f"""{_OFFSETS}, h as (select start, unnest(range(0, tokens)) as i, hex(encode(text)) as h, tokens from placed),
  t as (select start + i as pos, case when i = tokens - 1 then '258' else cast(('0x' || substr(h, cast(2 * i + 1 as bigint), 2))::int as varchar) end as token from h),
  seqs as (select pos // 257 as seq, string_agg(token, ',' order by pos) as tokens, count(*) as n from t group by 1 having count(*) = 257)"""
_CONFUSION = """select tp, fp, fn, tn, round(p, 4) as precision, round(r, 4) as recall, round(case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end, 4) as f1 from (
  select *, case when tp + fp = 0 then 1.0 else tp / (tp + fp) end as p, case when tp + fn = 0 then 1.0 else tp / (tp + fn) end as r from (
  select cast(count(*) filter (truth and hit) as bigint) as tp, cast(count(*) filter (not truth and hit) as bigint) as fp, cast(count(*) filter (truth and not hit) as bigint) as fn, cast(count(*) filter (not truth and not hit) as bigint) as tn from flagged))"""
_FLAGGED = f"with {_GATED}, flagged as (select gt_kind, coalesce(gt_kind like 'junk\\_%' escape '\\' or gt_kind = 'pii', false) as truth, id in (select id from g where reasons <> '' and gt_kind is not null and id is not null) as hit from g where gt_kind is not null)"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_EVENTS = "ev(seq, job, inputs, outputs) as (values " + ", ".join(f"({s}, '{j}', {_list(i)}, {_list(o)})" for s, j, i, o in EVENTS) + ")"
_LATEST = f"{_EVENTS}, last as (select * from ev where seq = (select max(seq) from ev x where x.job = ev.job)), ed as (select distinct * from (select unnest(inputs) as src, 'job:' || job as dst from last union all select 'job:' || job, unnest(outputs) from last))"

ORACLES: dict[str, str] = {
    "rule_non_empty": f"select id, {_STRIP} <> '' as passed from synth_records",
    "rule_min_words": f"select id, cast({_NW} as bigint) as n_words, {_NW} >= 5 as passed from synth_records",
    "rule_no_mojibake": f"select id, not {_MOJI} as passed from synth_records",
    "rule_no_boilerplate": f"select id, cast({_HITS} as bigint) as hits, ({_HITS}) < 2 as passed from synth_records",
    "rule_repeated_sentences": f"select id, cast(len(s) as bigint) as n, cast(len(list_distinct(s)) as bigint) as n_distinct, len(s) < 3 or (len(s) - len(list_distinct(s))) / len(s) <= 0.3 as passed from (select id, {_SENT} as s from synth_records)",
    "rule_no_pii": f"select id, not {_PII} as passed from synth_records",
    "gate_reject_reasons": f"with {_GATED} select id, reasons from g",
    "gate_silver": f"with {_GATED} select id, source, timestamp, site from g where reasons = ''",
    "gate_quarantine": f"with {_GATED} select id, source, reasons as reject_reasons from g where reasons <> ''",
    "gate_summary": f"""with {_GATED} select count(*) as input_rows, count(*) filter (reasons = '') as promoted_rows, count(*) filter (reasons <> '') as quarantined_rows,
        round(count(*) filter (reasons <> '') / count(*), 6) as reject_rate, count(*) - count(distinct coalesce(id, '')) as duplicate_id_rows,
        case when count(*) filter (reasons <> '') / count(*) > 0.5 then 'blocked' else 'promoted' end as verdict from g""",
    "gate_reason_histogram": f"with {_GATED} select reason, count(*) as hits from (select unnest(string_split(reasons, '|')) as reason from g where reasons <> '') group by 1",
    "contract_violations": f"""select count(*) filter (id is null) as null_id, count(*) filter (text is null) as null_text, count(*) filter ({_NW} < 5) as short_text,
        count(*) filter (source is null) as null_source, count(*) filter (timestamp is null) as null_timestamp, cast(count(id) - count(distinct id) as bigint) as repeated_ids from synth_records""",
    "pre_dedup_universe": f"with {_GATED} select id, source from g where id not in (select id from g where reasons <> '')",
    "word_count": f"select cast(doc_id as varchar) as id, cast({_NW} as bigint) as n_words from documents",
    "normalize_text": f"select id, {_NORM} as norm, lower({_NORM}) as norm_lower from synth_records",
    "text_sha256": f"select id, sha256({_T}) as sha from synth_records",
    "byte_tokens": f"select cast(doc_id as varchar) as id, cast(strlen({_T}) as bigint) as n_tokens, hex(encode({_T})) as tokens_hex from documents",
    "token_round_trip": "select cast(doc_id as varchar) as id, true as same from documents",
    "content_hash": "select o_orderkey, sha256(concat(o_orderkey, chr(10), o_custkey, chr(10), o_orderstatus, chr(10), o_orderpriority, chr(10))) as sha from orders",
    "exact_dup_groups": f"select sha256({_NORM}) as text_sha, count(*) as rows, min(id) as survivor from synth_records group by 1 having count(*) > 1",
    "shingles": f"with {_PAGES} {_shingled(5, 'pages', 'id', 'text')}",
    "near_dup_pairs": f"with {_NEAR} select a, b, round(similarity, 6) as similarity from pairs",
    "jaccard_pairs": f"""with r as (select id, any_value(text) as text from synth_records where id is not null group by id), sh as ({_shingled(5, "r", "id", "text")}),
        n as (select r.id, count(shingle) as n from r left join sh on r.id = sh.id group by r.id),
        m as (select distinct least(id_a, id_b) as id_a, greatest(id_a, id_b) as id_b from match_pairs where id_a <> id_b and similarity >= 0.5),
        k as (select id_a, id_b, count(*) as k from m join sh x on x.id = id_a join sh y on y.id = id_b and x.shingle = y.shingle group by all)
        select m.id_a, m.id_b, round(case when na.n + nb.n = 0 then 1.0 else coalesce(k, 0) / (na.n + nb.n - coalesce(k, 0)) end, 6) as similarity
        from m join n na on na.id = m.id_a join n nb on nb.id = m.id_b left join k on k.id_a = m.id_a and k.id_b = m.id_b""",
    "dup_clusters": f"{_CLUSTERS} select id, survivor from clustered",
    "dedup_survivors": f"{_CLUSTERS} select distinct survivor from clustered where kind = 'kept'",
    "dedup_removed": f"{_CLUSTERS} select id, survivor, kind from clustered where kind <> 'kept'",
    "dedup_kept": f"{_CLUSTERS} select id, source from pages where id not in (select id from clustered where kind <> 'kept')",
    "dedup_summary": f"""{_CLUSTERS} select (select count(*) from pages) as input_rows, (select count(distinct survivor) from clustered) as clusters,
        coalesce((select max(n) from (select count(*) as n from clustered group by survivor)), 1) as largest_cluster,
        (select count(*) from clustered where kind = 'exact') as removed_exact, (select count(*) from clustered where kind = 'near') as removed_near""",
    "dedup_threshold_sweep": f"""{_SCORED_PAIRS},
        t as (select cast(unnest([0.8, 0.85, 0.9, 0.95]) as double) as t),
        e as (select t, a, b from pairs, t where similarity >= t union all select t, b, a from pairs, t where similarity >= t),
        reach as (select t, rep as node, rep as other from reps, t union select reach.t, reach.node, e.b from reach join e on e.a = reach.other and e.t = reach.t),
        roots as (select t, node as rep, min(other) as survivor from reach group by all),
        named as (select r.t, q.id, r.survivor, p.rep = r.survivor as exact from rows_ q join reps p on q.norm = p.norm join roots r on r.rep = p.rep),
        gone as (select t, id, case when exact then 'exact' else 'near' end as kind from named where id <> survivor),
        flagged as (select t.t, u.gt_kind as kind, u.gt_dup_of is not null as truth, coalesce(u.id in (select id from gone where gone.t = t.t), false) as hit from u, t),
        cells as (select t, count(*) filter (truth and hit) as tp, count(*) filter (not truth and hit) as fp, count(*) filter (truth and not hit) as fn, count(*) filter (not truth and not hit) as tn from flagged group by t),
        pr as (select *, case when tp + fp = 0 then 1.0 else tp / (tp + fp) end as p, case when tp + fn = 0 then 1.0 else tp / (tp + fn) end as r from cells),
        k as (select t, string_agg(s, ',' order by s) as recall_by_kind from (select t, kind || '=' || printf('%.4f', round(count(*) filter (hit) / count(*), 4)) as s from flagged where truth and kind is not null group by t, kind) group by t)
        select t.t as threshold, (select count(*) from pairs where similarity >= t.t) as pairs, (select count(distinct id) from gone where gone.t = t.t) as removed,
            (select count(*) from gone where gone.t = t.t and kind = 'exact') as removed_exact, (select count(*) from gone where gone.t = t.t and kind = 'near') as removed_near,
            tp, fp, fn, tn, round(p, 4) as precision, round(r, 4) as recall, round(case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end, 4) as f1, recall_by_kind
        from t join pr on pr.t = t.t join k on k.t = t.t""",
    "profile_source_dist": f"with {_dist('s', 'synth_records')} select source, rows, round(share, 6) as share from s",
    "profile_length_dist": f"with {_lens('l', 'synth_records')} select cast(bin as int) as bin, cast(rows as bigint) as rows, round(share, 6) as share from l",
    "profile_whole": f"""with {_PAGES}, {_dist('s', 'pages')}, {_lens('l', 'documents')} select (select count(*) from pages) as n_rows,
        (select string_agg(source || '=' || printf('%.4f', share), ',' order by source) from s) as source_dist, (select string_agg(printf('%.4f', share), ',' order by bin) from l) as length_dist""",
    "drift_source_psi": f"with {_PSI_SOURCE} select source, round(expected, 6) as expected, round(actual, 6) as actual, round(psi, 6) as psi from psi_source",
    "drift_length_psi": f"with {_PSI_BIN} select cast(bin as int) as bin, round(expected, 6) as expected, round(actual, 6) as actual, round(psi, 6) as psi from psi_bin",
    "drift_report": f"""with {_PSI_SOURCE}, {_PSI_BIN}, v as (select (select sum(psi) from psi_source) as s, (select sum(psi) from psi_bin) as l)
        select round(s, 4) as source_psi, round(l, 4) as length_psi, case when greatest(s, l) < 0.1 then 'stable' when greatest(s, l) <= 0.25 then 'moderate' else 'major' end as verdict from v""",
    "asof_join": """select e.event_id, e.user_id, cast(v.event_id as varchar) as view_id, v.value as view_value, strftime(v.ts, '%Y-%m-%d %H:%M:%S.%f') as view_ts
        from events e asof left join (select * from events where event_type = 'view') v on e.user_id = v.user_id and e.ts >= v.ts""",
    "asof_join_inclusive": "select event_id, true as same_time from events",
    "feature_latest": "select user_id, event_id, value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts from (select *, row_number() over (partition by user_id order by ts desc, event_id) as n from events) where n = 1",
    "offline_online_parity": "select cast(0 as bigint) as differing",
    "leakage_violations": "select cast(0 as bigint) as violations",
    "source_rollup": f"""select source, timestamp, count(*) over w as docs_so_far, round(avg(n) over w, 3) as mean_words_so_far from (select source, timestamp, {_NW} as n from synth_records)
        window w as (partition by source order by timestamp nulls first, n rows between unbounded preceding and current row)""",
    "seeded_permutation": f"with {_PAGES} select id, sha256('0/shards/' || id) as order_key from pages",
    "shard_offsets": f"with {_OFFSETS} select id, cast(tokens as bigint) as tokens, cast(start as bigint) as start from placed",
    "shard_sequences": f"with {_TOKENS} select cast(seq as bigint) as seq, tokens from seqs",
    "shard_summary": f"""with {_OFFSETS}, s as (select count(*) as d, sum(tokens) as t from placed) select d as n_docs, cast(t as bigint) as n_tokens, cast(t // 257 as bigint) as n_sequences,
        cast(t % 257 as bigint) as dropped_tail, cast(ceil((t // 257) / 512) as bigint) as n_shards from s""",
    "rank_split": f"with {_TOKENS} select cast(seq % 4 as int) as rank, count(*) as n_sequences from seqs group by 1",
    "resume_offset": f"with {_TOKENS} select count(*) as left, cast(min(seq) as bigint) as first_seq from seqs where seq >= 1000",
    "score_gate": f"{_FLAGGED} {_CONFUSION}",
    "score_recall_by_kind": f"{_FLAGGED} select gt_kind as kind, count(*) as rows, count(*) filter (hit) as hits, round(count(*) filter (hit) / count(*), 4) as rate from flagged group by 1",
    "removed_flag": f"with {_GATED} select id, coalesce(id in (select id from g where reasons <> '' and id is not null), false) as removed from g",
    "score_dedup": f"""{_SCORED}, flagged as (select text, gt_dup_of, gt_dup_of is not null as truth, coalesce(id in (select id from clustered where kind <> 'kept'), false) as hit from u)
        select *, (select count(*) from flagged where hit and gt_dup_of is null and coalesce(text, '') in (select coalesce(text, '') from flagged group by 1 having count(*) > 1)) as fp_unlabeled_exact from ({_CONFUSION})""",
    "dangling_labels": "select distinct id, gt_dup_of from synth_records where gt_dup_of is not null and gt_dup_of not in (select id from synth_records where id is not null)",
    "batch_stream_symdiff": """with a as (select id from synth_records where id is not null), b as (select id_a as id from match_pairs where id_a is not null union all select id_b from match_pairs where id_b is not null)
        select count(*) as differing from ((select * from a except select * from b) union all (select * from b except select * from a))""",
    "dense_record_ids": "select doc_id, 'rec-' || lpad(cast(row_number() over (order by source nulls first, doc_id) - 1 as varchar), 8, '0') as record_id from documents",
    "spine_projection": "select distinct id, source from synth_records where id is not null order by id, source nulls first limit 100",
    "scan_parquet": "select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) as o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') as o_orderdate from orders",
    "catalog_row_count": "select count(*) as rows from lineitem",
    "catalog_summary": " union all ".join(f"select '{n}' as dataset, count(*) as rows from {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "synth_records")),
    "corpus_report": "select 'kind' as what, coalesce(gt_kind, 'None') as value, count(*) as rows from synth_records group by 2 union all select 'source', coalesce(source, 'None'), count(*) from synth_records group by 2",
    "land_ledger_antijoin": "select distinct batch_hash, n_rows from ingest_log where batch_hash not in (select batch_hash from ingest_log where code_version = '0.6.0')",
    "lineage_edges": f"with {_LATEST} select src, dst from ed",
    "lineage_latest_jobs": f"with {_LATEST} select job, cast(seq as bigint) as seq, array_to_string(outputs, ',') as outputs from last",
    "lineage_upstream": f"with recursive {_LATEST}, up as (select src from ed where dst = 'gold/shards' union select ed.src from ed join up on ed.dst = up.src) select src as dataset from up where src not like 'job:%'",
    **{k: v for k, v in SQL.items()},
}
