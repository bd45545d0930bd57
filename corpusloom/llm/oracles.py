"""SQL of the pN_ queries that SQL can express."""

from __future__ import annotations

_SPACE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SQ = lambda x: f"lower(regexp_replace({x}, '[\\p{{P}}{_SPACE}]+', '', 'g'))"
_PIECE = "[|;\n]"
_NAME = _SQ("split_part(p, ':', 1)")
_VALUE = _SQ("substr(p, instr(p, ':') + 1)")
_TABLES = "(select 'interim_dataset' as tab, record_id, text as x from interim_dataset union all select 'ood_leakage_precheck', record_id, processed_text from ood_leakage_precheck)"
KEYED = f"""nam as (select list({_SQ('field_name')}) as names from form_fields),
  txt as (select tab, record_id, x, [p for p in regexp_split_to_array(x, '{_PIECE}') if regexp_matches(p, '[^{_SPACE}]')] as pieces
    from {_TABLES} where regexp_matches(x, '[\\p{{L}}\\p{{N}}]')),
  frm as (select tab, record_id, x, pieces, len(pieces) >= 2 and len([p for p in pieces if contains(p, ':') and list_contains(names, {_NAME})]) = len(pieces) as is_form from txt, nam),
  keyd as (select tab, record_id, case when is_form then 'F' || array_to_string(list_sort([{_NAME} || ':' || {_VALUE} for p in pieces]), '|') else 'T' || {_SQ('x')} end as k from frm),
  grp as (select tab, k, min(record_id) as first_id, count(*) as n_copies from keyd group by 1, 2)"""
_WORDS = lambda x: f"list_distinct([lower(w) for w in regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+')])"
_TRIM = rf"lower(regexp_replace(source_id, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'))"
_TRAIN_EVAL = f"""rws as (select 'interim_dataset' as tab, record_id, split_name, source_dataset, null as sid, {_WORDS("coalesce(text, '')")} as s from interim_dataset
    union all select 'ood_leakage_precheck', record_id, split_name, source_dataset, {_TRIM}, {_WORDS("coalesce(processed_text, '')")} from ood_leakage_precheck),
  trn as (select * from rws where split_name = 'train_core'),
  evl as (select * from rws where (tab = 'interim_dataset' and split_name = 'dev_core') or (tab = 'ood_leakage_precheck' and split_name in ('ood_2020_dev', 'ood_2021_dev'))),
  tw as (select tab, record_id as t, len(s) as nt, unnest(s) as w from trn), ew as (select tab, record_id as e, len(s) as ne, unnest(s) as w from evl),
  sim as (select tab, e, t from (select ew.tab, e, t, any_value(ne) as ne, any_value(nt) as nt, count(*) as i from ew join tw on ew.tab = tw.tab and ew.w = tw.w group by 1, 2, 3)
    where i * 5 > (ne + nt - i) * 4),
  prs as (select * from sim union select evl.tab, evl.record_id, trn.record_id from evl join trn on evl.tab = trn.tab and evl.sid = trn.sid and evl.sid <> '')"""
_FILLED = """fil as (select g.first_id, i.record_id, i.loaded_at, coalesce(r.trust, -1) as trust, r.source_dataset,
    (select m.raw_label from label_map m where m.raw_label = regexp_replace(i.raw_label, '^[SPC]+|[SPC]+$', '', 'g')) as raw_label,
    case when i.macro_label in ('Saudi', 'Egyptian', 'Levantine', 'Maghrebi') then i.macro_label end as macro_label
  from keyd k join grp g on g.tab = k.tab and g.k = k.k and g.n_copies > 1 join interim_dataset i on i.record_id = k.record_id
  left join source_registry r on r.source_dataset = i.source_dataset where k.tab = 'interim_dataset')""".replace("SPC", _SPACE)
_BEST = lambda f: (
    f"select first_id, '{f}' as field_name, record_id as from_id, {f} as value from (select *, row_number() over (partition by first_id "
    f"order by trust desc, loaded_at desc nulls last, record_id) as r from fil where {f} is not null) where r = 1"
)
_ELECTED = " union all ".join(map(_BEST, ("source_dataset", "raw_label", "macro_label")))
_COUNTS = """cnt as (select 'macro_label' as field_name, macro_label as category, count(*) as n from interim_dataset group by 1, 2
  union all select 'normalized_raw_label', normalized_raw_label, count(*) from interim_dataset group by 1, 2)"""
_SIMILAR = f"""s as (select record_id, {_WORDS("coalesce(processed_text, '')")} as s from ood_leakage_precheck),
  w as (select record_id, len(s) as n, unnest(s) as w from s),
  m as (select a.record_id as id_a, b.record_id as id_b, any_value(a.n) as x, any_value(b.n) as y, count(*) as i from w a join w b on a.w = b.w and a.record_id < b.record_id group by 1, 2),
  prs as (select id_a, id_b from m where i * 10 > (x + y - i) * 7)"""
ORACLES = {
    "p1_found": f"with {KEYED} select first_id, record_id as copy_id from keyd join grp using (tab, k) where record_id <> first_id",
    "p1_records": f"with {KEYED} select tab as table_name, first_id, n_copies from grp",
    "p2_found": f"with {_TRAIN_EVAL} select least(e, t) as id_a, greatest(e, t) as id_b from prs",
    "p2_overlaps": f"""with {_TRAIN_EVAL} select prs.tab as table_name, evl.split_name, evl.source_dataset, count(*) as n_pairs, count(distinct e) as n_records
      from prs join evl on evl.tab = prs.tab and evl.record_id = prs.e group by 1, 2, 3""",
    "p3_found": f"with {KEYED}, {_FILLED} select first_id, field_name, from_id from ({_ELECTED})",
    "p4_found": f"with {_SIMILAR} select id_a, id_b from prs",
    "p4_groups": f"""with recursive {_SIMILAR}, edg as (select id_a as a, id_b as b from prs union all select id_b, id_a from prs),
      rch as (select distinct record_id as x, record_id as y from w union select x, b from rch join edg on a = y),
      lnk as (select a, count(*) as n from edg group by 1)
      select x as record_id, min(y) as group_id, coalesce(any_value(n), 0) as n_links from rch left join lnk on a = x group by 1""",
    "p5_found": f"""with {_COUNTS} select target_name, category from sample_targets left join cnt using (field_name, category)
      where coalesce(n, 0) < min_rows or coalesce(n, 0) < target_share * sample_fraction * (select count(*) from interim_dataset)""",
}
