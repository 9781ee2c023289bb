"""DuckDB SQL of classification, scoring and item normalisation. The vocabularies are data and shared with the engine; the
rules are stated anew."""

from tidewire.functions import vocabulary as V
from tidewire.plans.text_sql import SQL as TEXT_SQL
from tidewire.plans.text_sql import _html, _short, _words

_CATS = ["nigeria", "politics", "business", "technology", "sports", "entertainment", "world"]
_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_COUNT = lambda x, xs: "(" + " + ".join(f"cast(contains({x}, '{p.replace(chr(39), chr(39) * 2)}') as integer)" for p in xs) + ")"
_LINE = lambda x: f"trim(regexp_replace({_html(x)}, '\\s+', ' ', 'g'))"
_PATH = lambda x: f"coalesce(nullif(regexp_extract(lower(coalesce({x}, '')), '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), case when regexp_matches(lower(coalesce({x}, '')), '^[a-z][a-z0-9+.-]*://[^/?#]') then '/' else lower(coalesce({x}, '')) end)"

_SCORES = ", ".join(f"2 * len(list_intersect(w, {_LIST(getattr(V, c.upper()))})) + 5 * {_COUNT('t', getattr(V, c.upper() + '_PHRASES'))} + 6 * {_COUNT('p', getattr(V, c.upper() + '_PATHS'))} as {c}" for c in _CATS)
_DAMPED = "case when greatest(politics, business, technology, sports, entertainment) >= 6 then cast(floor(nigeria * 0.35 + 0.5) as integer) else nigeria end"
_PRIORS = ", ".join(f"{c} + case when len(d) = 1 and d[1] = '{c}' then 4 when len(d) > 1 then len(list_filter(d[2:], lambda x: x = '{c}')) + case when d[1] = '{c}' then 2 else 0 end else 0 end as {c}" for c in _CATS)
_ALL = ", ".join(_CATS)
_TIES = ["sports", "entertainment", "technology", "business", "politics", "world", "nigeria"]

CLASSIFIED = f"""with l as (select s.id, {_LINE('headline')} as h, {_LINE('summary')} as m, {_PATH('canonical_url')} as p, source_type, coalesce(country, '') as country,
 list_filter(list_transform(string_split(coalesce(categories, ''), ','), lambda x: lower(trim(x))), lambda x: list_contains({_LIST(_CATS)}, x)) as d from story s left join news_source n on n.id = s.source_id),
t as (select *, lower(h || ' ' || h || ' ' || m || ' ') as t from l), k as (select *, list_distinct({_words('t')}) as w from t),
a as (select id, d, source_type, country, list_has_any(w, {_LIST(V.NIGERIA)}) as home, {_SCORES} from k),
b as (select * replace ({_DAMPED} as nigeria, world + case when source_type = 'INTERNATIONAL_MEDIA' and not home then 7 else 0 end as world) from a),
c as (select id, d, source_type, country, home, greatest({_ALL}) as found, {_PRIORS} from b),
e as (select *, case when found <= 0 then coalesce(d[1], case when source_type = 'INTERNATIONAL_MEDIA' then 'world' else 'nigeria' end) {' '.join(f"when {c} = greatest({_ALL}) then '{c}'" for c in _TIES)} end as category from c)
select id, category, case when home then 'ng' when category = 'world' then 'world' when country <> '' and upper(country) <> 'NG' then case when source_type = 'INTERNATIONAL_MEDIA' then 'world' else 'africa' end else 'ng' end as region,
coalesce(round(least(1.0, greatest(0.0, (case category {' '.join(f"when '{c}' then {c}" for c in _CATS)} end) / nullif(({' + '.join(f'greatest({c}, 0)' for c in _CATS)})::double, 0))), 3), 0.0) as confidence, {_ALL} from e"""

_TEXT = "lower(coalesce(headline, '') || ' ' || coalesce(summary, ''))"
SCORED = f"""with c as (select cluster_id, count(distinct source_id) as n from story where cluster_id is not null group by 1),
a as (select s.id, headline, summary, trust_tier, weight, source_type, s.region, n, image_url, (1764547200000 - epoch_ms(fetched_at)) / 3600000.0 as age, regexp_replace(coalesce(headline, ''), '[^A-Za-z]', '', 'g') as l, {_PATH('canonical_url')} as p
 from story s left join c using (cluster_id) left join news_source o on o.id = s.source_id)
select id, cast(greatest(0, least(100, floor(30.0 + (4 - least(4, greatest(0, coalesce(trust_tier, 5) - 1))) * 3.75 - case when source_type is null or source_type in ('EXPERT', 'CREATOR', 'SOCIAL_SIGNAL', 'UNVERIFIED') then 20 else 0 end
+ (least(100, greatest(0, coalesce(weight, 50))) - 50) / 6.25 + case region when 'ng' then 10 when 'africa' then 4 else 0 end + case when n >= 2 then least(14, (n - 1) * 5) else 0 end
+ case when age < 1 then 12 when age < 3 then 9 when age < 8 then 6 when age < 24 then 2 when age < 72 then -6 else -16 end + least(10.0, {_COUNT(_TEXT, V.IMPACT)} * 3.5) + case when image_url is not null then 3 else 0 end
- case when {_COUNT(_TEXT, V.ROUTINE)} > 0 then 8 else 0 end - case when regexp_matches(coalesce(headline, ''), ',\\s*[Bb][Yy]\\s+\\p{{Lu}}[\\p{{L}}''-]+') or {_COUNT('p', V.OPINION_PATHS)} > 0 then 16 else 0 end
- case when length(l) > 12 and length(regexp_replace(l, '[^A-Z]', '', 'g')) > 0.7 * length(l) then 8 else 0 end + 0.5))) as integer) as importance from a"""

NORMALIZED = f"""with i as (select r.item_id, {_LINE('title')} as h0, u.url, {_html('description')} as d, {_html('content')} as c, g.image from raw_feed_item r join ({TEXT_SQL['normalized_links']}) u using (item_id) join ({TEXT_SQL['image_addresses']}) g using (item_id)),
j as (select item_id, {_short('h0', 240)} as headline, url, case when length(c) > length(d) then c else d end as b0, image from i),
k as (select item_id, headline, url, {_LINE('b0')} as b, image from j where length(headline) >= 12 and regexp_matches(url, '^(?i:https)://')),
l as (select *, b <> '' and lower(b) <> lower(headline) as usable, {_short('b', 320)} as s, {_short('b', 600)} as e from k)
select item_id, headline, url, case when usable then s else headline || '. Full report at the source.' end as summary, case when usable then e end as excerpt, image as image_url from l"""

EDITORIAL_SQL = {
    "classified_stories": CLASSIFIED,
    "scored_stories": SCORED,
    "rescored": f"""select s.id, s.importance as old_importance, s.category as old_category, s.region as old_region, x.importance, c.category, c.region from story s join ({SCORED}) x using (id) join ({CLASSIFIED}) c using (id)
where s.importance is distinct from x.importance or s.category is distinct from c.category or s.region is distinct from c.region""",
    "normalized_items": NORMALIZED,
}
