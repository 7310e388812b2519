"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
places as (select doc_id, ws, unnest(range(1, len(ws) - 18)) as p from w where len(ws) >= 20),
windows as (select doc_id, p, array_to_string(ws[p:p + 19], ' ') as win from places),
later as (select doc_id, p from (select doc_id, p, row_number() over (partition by win order by doc_id, p) as n from windows) where n > 1),
gone as (select distinct doc_id, unnest(range(p, p + 20)) as i from later)
select w.doc_id, count(words.i) as n_words, count(gone.i) as n_removed, sha256(coalesce(string_agg(words.word, ' ' order by words.i) filter (where gone.i is null), '')) as kept_sha256
from w left join words on w.doc_id = words.doc_id left join gone on gone.doc_id = words.doc_id and gone.i = words.i group by w.doc_id""",
    "op6_decontamination": rf"""
with d as (select doc_id, {_WORDS} as ws from documents), b as (select item_id, {_WORDS} as ws from benchmark),
item_places as (select item_id, ws, least(10, len(ws)) as size, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as p from b where len(ws) > 0),
item_windows as (select distinct item_id, size, array_to_string(ws[p:p + size - 1], ' ') as win from item_places),
doc_places as (select doc_id, ws, s.size, unnest(range(1, len(ws) - s.size + 2)) as p from d, (select distinct size from item_windows) s where len(ws) >= s.size),
hits as (select distinct x.doc_id, x.p, x.size, i.item_id from (select doc_id, p, size, array_to_string(ws[p:p + size - 1], ' ') as win from doc_places) x join item_windows i on i.size = x.size and i.win = x.win),
hit_words as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(p, p + size)) as i from hits) group by doc_id),
hit_items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) group by doc_id)
select d.doc_id, len(d.ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words h on d.doc_id = h.doc_id left join hit_items t on d.doc_id = t.doc_id""",
    "op7_arc_to_warc": """
with p as (select page_id, coalesce(html, '') as html from pages), k as (select *, case when strlen(html) >= 1000 then max(page_id) over (partition by html) end as kept from p)
select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest, case when kept is null or kept = page_id then 'response' else 'revisit' end as record_type,
case when kept <> page_id then kept end as refers_to from k""",
}
