"""DuckDB SQL of the text, duplicate and cluster queries. Patterns are spelled for RE2."""

from tidewire.functions.text import FOLD_FROM, FOLD_MANY, FOLD_TO, STOPWORDS


def _words(x: str) -> str:
    """The headline's tokens; headlines hold no markup, so only the accents and signs matter."""
    folded = f"translate(lower({x}), '{FOLD_FROM}', '{FOLD_TO}')"
    for a, b in FOLD_MANY:
        if a in "½¼¾ﬁﬂ™…ĳ":
            folded = f"replace({folded}, '{a}', '{b}')"
    return f"list_filter(string_split_regex(regexp_replace(regexp_replace({folded}, '[̀-ͯ]', '', 'g'), '[''’]', '', 'g'), '[^a-z0-9]+'), lambda t: t <> '')"


_STOP = "[" + ",".join(f"'{w}'" for w in STOPWORDS) + "]"


def _significant(x: str) -> str:
    return f"list_filter({_words(x)}, lambda t: length(t) > 2 and not list_contains({_STOP}, t))"


_B = r"\b"
_OMNI = r"(?i)\b(?:round[- ]?up|as it happened|wrap(?:[- ]up)?|recap|highlights|digest|briefing|in pictures|in photos|explainer|what we know|things to know|five things|quiz)\b|\blive(?:blog)?\s*[:|-]|^live\b|\blive updates?\b"
_RESULT = r"(?i)\b(?:beat|beats|beaten|defeat|defeats|defeated|edge|edges|win|wins|won|thrash|thrashes|stun|stuns|victory|triumph|hold|held|draw with|drew)\b"
_PREVIEW = r"(?i)\b(?:host|hosts|to face|face off|preview|clash with|take on|takes on|set to (?:play|face|meet)|vs\.?|versus)\b"
_NUMS = r"list_distinct(regexp_extract_all(headline, '\b\d[\d,]*\b'))"
_HEX = "lower(regexp_replace(trim({0}), '^0[xX]', ''))"
_BITS = "cast(('0x' || lower(regexp_replace(trim({0}), '^0[xX]', ''))) as ubigint)"
_WORDS = f"w as materialized (select id, epoch_ms(fetched_at) as ms, headline, title_key, list_sort(list_distinct({_significant('headline')})) as words from story)"

SQL = {
    "find_duplicates": f"""with a as (select id, source_id, {_HEX.format('url_hash')} as u, {_HEX.format('title_key')} as t, {_BITS.format('simhash')} as h, epoch_ms(fetched_at) as ms from story_batch),
b as (select id, source_id, url_hash as u, title_key as t, {_BITS.format('simhash')} as h, epoch_ms(fetched_at) as ms from story),
m as (select a.id, b.id as matched_id, 1 as rule, 1 as pass, b.ms from a join b on a.u = b.u
union all select a.id, b.id, case when a.t = b.t then 2 else 3 end, 2, b.ms from a join b on a.source_id = b.source_id and abs(a.ms - b.ms) <= 259200000 and (a.t = b.t or bit_count(xor(a.h, b.h)) <= 4))
select id, matched_id, rule from m qualify row_number() over (partition by id order by pass, ms desc, matched_id, rule) = 1""",
    "idf_weights": f"""with {_WORDS}, d as (select unnest(words) as token from w)
select token, count(*) as df, round(ln(((select count(*) from w) + 1) / (count(*) + 1)) + 1, 9) as weight from d group by token""",
    "cluster_edges": f"""with {_WORDS},
n as (select count(*) as n from w), d as (select unnest(words) as token from w), i as (select token, ln(((select n from n) + 1) / (count(*) + 1)) + 1 as weight from d group by token),
x as (select w.*, regexp_matches(headline, '{_RESULT}') and not regexp_matches(headline, '{_PREVIEW}') as ro, regexp_matches(headline, '{_PREVIEW}') and not regexp_matches(headline, '{_RESULT}') as po, {_NUMS} as nums
  from w where not regexp_matches(headline, '{_OMNI}')),
l as materialized (select x.id, i.token, i.weight from (select id, unnest(words) as token from x) x join i using (token)),
t as (select id, sum(weight) as total from l group by id),
s as materialized (select a.id as a, b.id as b, sum(a.weight) as shared from l a join l b on a.token = b.token and a.id < b.id group by 1, 2),
p as (select a.id as aid, b.id as bid, a.ms as ams, b.ms as bms, a.title_key = b.title_key as same, round(coalesce(shared, 0) / least(ta.total, tb.total), 12) as c, round(coalesce(shared, 0) / (ta.total + tb.total - coalesce(shared, 0)), 12) as j,
  len(a.nums) > 0 and len(b.nums) > 0 and not list_has_any(a.nums, b.nums) as figures
  from x a join x b on a.id < b.id and abs(a.ms - b.ms) <= 259200000 and not ((a.ro and b.po) or (b.ro and a.po)) join t ta on ta.id = a.id join t tb on tb.id = b.id left join s on s.a = a.id and s.b = b.id
  where shared is not null or a.title_key = b.title_key),
r as (select *, case when same then 1.0 when c >= 0.65 then c when c >= 0.45 and j >= 0.34 and not figures then (c + j) / 2 end as score from p)
select case when (ams, aid) < (bms, bid) then bid else aid end as later_id, case when (ams, aid) < (bms, bid) then aid else bid end as earlier_id, round(score, 6) as score from r where score is not null""",
    "format_flags": f"""select item_id, coalesce(regexp_matches(title, '{_OMNI}'), false) as omnibus, coalesce(regexp_matches(title, '{_RESULT}'), false) as result, coalesce(regexp_matches(title, '{_PREVIEW}'), false) as preview,
coalesce(regexp_matches(title, ',\\s*[Bb][Yy]\\s+\\p{{Lu}}[\\p{{L}}''-]+'), false) as opinion, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(title, ''), '\\b\\d[\\d,]*\\b'))), '|') as numbers from raw_feed_item""",
    "pair_evaluation": f"""with s as materialized (select id, cluster_id, source_id, floor(epoch_ms(fetched_at) / 86400000) as day, list_distinct({_significant('headline')}) as w from story),
p as (select len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) as sim, coalesce(a.cluster_id = b.cluster_id, false) as same from s a join s b on a.source_id = b.source_id and a.day = b.day and a.id < b.id),
t as (select unnest([1, 2, 3, 4, 5, 6, 7, 8]) / 10.0 as threshold),
m as (select cast(threshold as double) as threshold, count(*) filter (where sim >= threshold and same) as tp, count(*) filter (where sim >= threshold and not same) as fp, count(*) filter (where not (sim >= threshold) and same) as fn, count(*) filter (where not (sim >= threshold) and not same) as tn from (select coalesce(sim, 0) as sim, same from p), t group by 1),
q as (select *, coalesce(tp / nullif(tp + fp, 0), 1.0) as p, coalesce(tp / nullif(tp + fn, 0), 0.0) as r from m)
select threshold, tp, fp, fn, tn, round(p, 9) as "precision", round(r, 9) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 9) as f1 from q""",
}


def _ws(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"


def _html(x: str) -> str:
    s = f"coalesce({x}, '')"
    for name in ("script", "style", "noscript", "iframe", "svg"):
        s = f"regexp_replace({s}, '(?is)<{name}\\b[^>]*>.*?</{name}\\s*>', ' ', 'g')"
    for pattern, to in (("(?i)</(p|div|li|h[1-6]|blockquote|tr)\\s*>", "\n"), ("(?i)<br\\s*/?>", "\n"), ("<[^>]+>", " ")):
        s = f"regexp_replace({s}, '{pattern}', '{to}', 'g')"
    s = f"replace(replace(replace({s}, '&#8230;', '…'), '&nbsp;', ' '), '&amp;', '&')"
    for pattern, to in (("(?is)\\bContinue reading.{0,80}$", " "), ("(?i)\\bRead more(?: here)?[.:]?\\s*$", " "), ("\\r", ""), ("[ \\t\\x{00A0}]+", " "), ("\\s*\\n\\s*", "\n")):
        s = f"regexp_replace({s}, '{pattern}', '{to}', 'g')"
    return _ws(s)


def _short(x: str, n: int) -> str:
    """Truncation at the last blank of the second half."""
    t = _ws(f"coalesce({x}, '')")
    head = f"substr({t}, 1, {n})"
    last = f"(length({head}) - strpos(reverse({head}), ' '))"
    cut = f"case when strpos(reverse({head}), ' ') > 0 and {last} > {n} * 0.5 then substr({head}, 1, {last}) else {head} end"
    return f"case when length({t}) <= {n} then {t} else regexp_replace({cut}, '[\\s.,;:!?–—-]+$', '') || '…' end"


_SLUG = f"regexp_replace(regexp_replace(array_to_string({_words('headline')}, '-'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_FEATURES = "list_concat(list_transform(w, lambda t: {'f': t, 'n': 1}), list_transform(range(1, len(w)), lambda i: {'f': w[i] || '_' || w[i + 1], 'n': 2}))"

SQL |= {
    "html_texts": f"select item_id, {_html('content')} as text from raw_feed_item",
    "story_fingerprints": "select id, canonical_url, url_hash, title_key from story",
    "headline_tokens": f"select id, array_to_string({_words('headline')}, ' ') as tokens, array_to_string({_significant('headline')}, ' ') as significant from story",
    "simhashes": f"""with l as (select id, simhash, trim(regexp_replace({_html("concat_ws(' ', headline, headline, summary)")}, '\\s+', ' ', 'g')) as line from story), w as (select id, simhash, {_significant('line')} as w from l),
f as (select id, unnest({_FEATURES}) as x from w),
h as (select id, cast(('0x' || substr(md5(x.f), 1, 16)) as ubigint) as h, x.n as n from f),
v as (select id, b, sum(case when (h >> (63 - b)) & 1 = 1 then n else -n end) as s from h, range(0, 64) t(b) group by id, b),
g as (select id, cast(sum(case when s > 0 then cast(power(2::hugeint, 63 - b) as hugeint) else 0 end) as ubigint) as code from v group by id)
select w.id, lpad(lower(printf('%x', coalesce(code, 0))), 16, '0') as new_simhash, bit_count(xor(coalesce(code, 0::ubigint), {_BITS.format('simhash')})) as distance from w left join g using (id)""",
    "slugs": f"""with s as (select id, canonical_url, {_SLUG} as s from story)
select id, case when length(s) <= 40 then s when strpos(reverse(substr(s, 1, 40)), '-') > 0 and 40 - strpos(reverse(substr(s, 1, 40)), '-') > 24 then substr(s, 1, 40 - strpos(reverse(substr(s, 1, 40)), '-')) else regexp_replace(substr(s, 1, 40), '-+$', '') end as slug,
case when s = '' then 'story' when length(s) <= 72 then s when strpos(reverse(substr(s, 1, 72)), '-') > 0 and 72 - strpos(reverse(substr(s, 1, 72)), '-') > 43.2 then substr(s, 1, 72 - strpos(reverse(substr(s, 1, 72)), '-')) else regexp_replace(substr(s, 1, 72), '-+$', '') end || '-' || substr(sha256(canonical_url), 1, 6) as unique_slug from s""",
    "truncated": f"select id, {_short('summary', 160)} as short, cast(greatest(1, floor(len(list_filter(string_split_regex({_ws('coalesce(summary, chr(32))')}, '\\s+'), lambda x: x <> '')) / 220.0 + 0.5)) as integer) as minutes from story",
    "relative_times": """with d as (select id, epoch_ms(fetched_at) - 1764547200000 as d from story),
k as (select id, d, case when d <= -31536000000 then 31536000000 when d <= -2592000000 then 2592000000 when d <= -604800000 then 604800000 when d <= -86400000 then 86400000 when d <= -3600000 then 3600000 when d <= -60000 then 60000 end as u from d),
n as (select id, u, cast(-floor(d / u::double + 0.5) as bigint) as k from k)
select id, case when u is null then 'just now' when k = 1 and u = 86400000 then 'yesterday' when k = 1 and u = 604800000 then 'last week' when k = 1 and u = 2592000000 then 'last month' when k = 1 and u = 31536000000 then 'last year'
else k || case u when 60000 then ' minute' when 3600000 then ' hour' when 86400000 then ' day' when 604800000 then ' week' when 2592000000 then ' month' else ' year' end || case when k = 1 then '' else 's' end || ' ago' end as "when" from n""",
    "counts": """with n as (select o_orderkey, floor(o_totalprice) as n from orders)
select o_orderkey, case when n < 1000 then cast(cast(n as bigint) as varchar) when n < 10000 then printf('%.1fk', floor(n / 100 + 0.5) / 10) when n < 1000000 then printf('%.0fk', floor(n / 1000 + 0.5)) else printf('%.1fm', floor(n / 100000 + 0.5) / 10) end as price from n""",
    "event_props": "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events",
    "category_lists": "select distinct id, category from (select id, lower(trim(unnest(string_split(categories, ',')))) as category from news_source) where category <> ''",
    "image_addresses": r"""select item_id, case when regexp_matches(trim(image_url), '(?i)^https?://[^/?#]+\.[^/?#]+') and not regexp_matches(regexp_extract(trim(image_url), '(?i)^https?://[^/?#]+([^?#]*)', 1), '(?i)logo|favicon|placeholder|avatar|sprite|no[-_]?image|default[-_](?:image|thumb)|/icons?[/.\-_]|blank\.')
then regexp_replace(trim(image_url), '^(?i:http):', 'https:') end as image from raw_feed_item""",
    "normalized_links": r"""with p as (select item_id, trim(coalesce(link, '')) as s, regexp_extract(trim(coalesce(link, '')), '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1) as host, regexp_extract(trim(coalesce(link, '')), '(?i)^https?://[^/?#]+([^?#]*)', 1) as path, regexp_extract(trim(coalesce(link, '')), '\?([^#]*)', 1) as q from raw_feed_item),
n as (select item_id, s, regexp_replace(lower(host), '^www\.', '') as host, regexp_replace(regexp_replace(regexp_replace(path, '(?i)/amp/?$', '/'), '/{2,}', '/', 'g'), '(.)/+$', '\1') as path,
 list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^(?:utm_[^=]*|fbclid|gclid|igshid|mc_[ce]id|ref|ref_src|source|amp|__twitter_impression|spm|cmpid|_ga)(?:=|$)'))) as q from p),
u as (select item_id, s, host, case when host = '' then case when regexp_matches(s, '(?i)^[a-z][a-z0-9+.-]*:') then '' else s end else 'https://' || host || case when path = '' then '/' else path end || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end end as url from n)
select item_id, url, sha256(case when url = '' then s else url end) as url_hash, host from u""",
}
