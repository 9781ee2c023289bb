"""The pN_ queries of this subpackage, and their SQL where SQL is an independent check."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tidewire.functions.text import NO_VALUE

_QUERIES = {
    "truncation": ["p1_found", "p1_rates"],
    "history": ["p2_found", "p2_verdicts"],
    "lines": ["p3_found", "p3_cleaned", "p3_by_source"],
    "neardup": ["p4_found", "p4_groups"],
    "survivor": ["p6_found", "p6_records"],
    "encode": ["p7_ids"],
    "mixing": ["p8_mix", "p8_shares"],
    "splitting": ["p9_pieces", "p9_summary"],
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"tidewire.llm.{module}"), name) for module, names in _QUERIES.items() for name in names}


_NO_VALUE = "(" + ", ".join(f"'{x}'" for x in NO_VALUE) + ")"
_BEST = " union all ".join(
    f"""select cluster_id, '{f}' as field_name, arg_min(id, k) as id from (select cluster_id, s.id, row_number() over (partition by cluster_id order by coalesce(trust_tier, 99999), coalesce(importance, -99999) desc, fetched_at desc, s.id) as k
from story s left join news_source n on n.id = s.source_id where {f} is not null and lower(trim({f})) not in {_NO_VALUE} and cluster_id in (select cluster_id from story group by 1 having count(*) > 1)) group by 1"""
    for f in ("author", "dek", "excerpt", "image_url")
)


_LINES = r"""with d as (select 'raw_feed_item' as tbl, source_id, item_id as rec_id, string_split(content, chr(10)) as t from raw_feed_item union all select 'story', source_id, id, string_split(summary, chr(10)) from story),
l as (select tbl, source_id, rec_id, unnest(t) as line, generate_subscripts(t, 1) as line_no from d where t is not null and source_id is not null),
k as (select *, trim(regexp_replace(regexp_replace(lower(replace(replace(replace(regexp_replace(line, '<[^<>]*>', '', 'g'), '&#8230;', '…'), '&nbsp;', ' '), '&amp;', '&')), '[0-9]+', '#', 'g'), '[\s\x{00A0}]+', ' ', 'g')) as k from l),
c as (select tbl, source_id, k, count(distinct rec_id) as n from k where k <> '' group by all having count(distinct rec_id) >= 10)"""

_RECORDS = (
    """with r as (select s.id, cluster_id, author, dek, excerpt, image_url, n.trust_tier as tier, importance, epoch_us(fetched_at) as us, max(epoch_us(fetched_at)) over (partition by cluster_id) as last
from story s left join (select id, min(trust_tier) as trust_tier from news_source group by id) n on n.id = s.source_id where cluster_id is not null),
v as (unpivot r on author, dek, excerpt, image_url into name f value val),
u as (select *, lower(trim(regexp_replace(val, '[\\s\\x{00A0}]+', ' ', 'g'))) as norm, coalesce(tier, 2147483647) as a, -coalesce(importance, -2147483648)::bigint as b, coalesce(-us, 9223372036854775807) as c from v),
w as (select * from u where norm not in """
    + _NO_VALUE
    + """),
g as (select *, round(last / (3.6e9 * 72) + log2(sum(coalesce(pow(2.0::double, (us - last) / (3.6e9 * 72)), 0) / coalesce(greatest(tier, 1), 6)) over (partition by cluster_id, f, norm)), 6) as votes,
 row_number() over (partition by cluster_id, f, norm order by a, b, c, id) as place from w),
x as (select * from g where place = 1 qualify row_number() over (partition by cluster_id, f order by votes desc nulls last, a, b, c, id) = 1),
n as (select cluster_id, count(*) as n_rows from story where cluster_id is not null group by 1)
select n.cluster_id, n_rows, max(val) filter (where f = 'author') as author, max(val) filter (where f = 'dek') as dek, max(val) filter (where f = 'excerpt') as excerpt, max(val) filter (where f = 'image_url') as image_url
from n left join x using (cluster_id) group by all"""
)

#: Row by row in order of arrival: what matches history, then a recursion over the other rows with the list of those accepted.
_HISTORY = """with recursive a as (select id, source_id, batch_no, arrival_no, lower(regexp_replace(trim(url_hash), '^0[xX]', '')) as u, lower(regexp_replace(trim(title_key), '^0[xX]', '')) as t,
 cast(('0x' || lower(regexp_replace(trim(simhash), '^0[xX]', ''))) as ubigint) as h, epoch_ms(fetched_at) as ms from story_batch),
b as (select source_id, lower(url_hash) as u, lower(title_key) as t, cast(('0x' || simhash) as ubigint) as h, epoch_ms(fetched_at) as ms from story),
o as (select distinct id from (select a.id from a join b on a.u = b.u union all select a.id from a join b on a.source_id = b.source_id and a.t = b.t
 union all select a.id from a join b on a.source_id = b.source_id and abs(a.ms - b.ms) <= 259200000 and bit_count(xor(a.h, b.h)) <= 4)),
w as (select *, row_number() over (order by arrival_no) as n from a where id not in (select id from o)),
e as (select x.n, list(y.n) as e from w x join w y on y.n < x.n and (x.u = y.u or (x.source_id = y.source_id and (x.t = y.t or (abs(x.ms - y.ms) <= 259200000 and bit_count(xor(x.h, y.h)) <= 4)))) group by x.n),
s as (select w.n, coalesce(e.e, []::bigint[]) as e from w left join e using (n)),
r as (select 0::bigint as n, []::bigint[] as taken union all select s.n, case when list_has_any(r.taken, s.e) then r.taken else list_append(r.taken, s.n) end from r join s on s.n = r.n + 1),
f as (select unnest(taken) as n from r where n = (select count(*) from w)),
dup as (select id from o union all select id from w where n not in (select n from f))"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL states plainly; the other operators have brute-force tests."""
    return {
        "p2_found": f"{_HISTORY} select id from dup",
        "p2_verdicts": f"{_HISTORY} select batch_no, count(*) as n_rows, count(*) filter (where id in (select id from dup)) as n_duplicates from story_batch group by 1",
        "p6_found": _BEST,
        "p6_records": _RECORDS,
        "p3_found": f"{_LINES} select distinct tbl, rec_id, cast(line_no as integer) as line_no from k join c using (tbl, source_id, k)",
        "p3_cleaned": f"""{_LINES}, m as (select k.*, c.n is not null as gone from k left join c using (tbl, source_id, k))
select tbl, rec_id, cast(count(*) filter (where gone) as integer) as n_removed, coalesce(string_agg(line, chr(10) order by line_no) filter (where not gone), '') as text from m group by 1, 2 having count(*) filter (where gone) > 0""",
        "p3_by_source": f"{_LINES} select tbl, source_id, count(*) as n_lines, max(n) as most_docs from c group by 1, 2",
    }
