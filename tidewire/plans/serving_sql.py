"""DuckDB SQL of the reading queries."""

from tidewire.plans.text_sql import _html as html_sql
from tidewire.plans.text_sql import _short as short_sql

PUB = "(select * from story where status = 'PUBLISHED')"
IMP = "importance desc nulls last, fetched_at desc nulls last, id"
NEW = "fetched_at desc nulls last, id"
NEW_OF_S = "fetched_at desc nulls last, s.id"
GRP = "coalesce('c' || cluster_id, 's' || id)"
TOP = f"""
recent as (select id, headline, cluster_id, source_id, importance, fetched_at, row_number() over (order by {IMP}) as o from {PUB} where fetched_at >= timestamptz '2025-10-26 00:00:00+00' qualify o <= 60),
latest as (select id, headline, cluster_id, source_id, importance, fetched_at, row_number() over (order by {NEW}) as o from {PUB} qualify o <= 40),
pool as (select * from recent union all select * from latest where not exists (select 1 from recent)),
heads as (select * from pool qualify row_number() over (partition by {GRP} order by o) = 1),
top13 as (select *, row_number() over (order by o) as position from heads order by o limit 13)"""
CATS = "['nigeria','politics','business','technology','sports','entertainment','world']"
ROLL = """
roll as (select cluster_id, count(*) as story_count, count(distinct source_id) as source_count, min(epoch_ms(fetched_at)) as first_ms, max(epoch_ms(fetched_at)) as last_ms,
  arg_min(headline, (fetched_at, id)) as title, arg_min(category, (fetched_at, id)) as category from story where cluster_id is not null group by cluster_id)"""

_LINE = lambda x: f"trim(regexp_replace({html_sql(x)}, '\\s+', ' ', 'g'))"
_XML = lambda x: f"replace(replace(replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_RSS = f"""r as (select s.*, source_name, row_number() over (order by {NEW_OF_S}) as position from {PUB} s left join news_source n on n.id = s.source_id order by {NEW_OF_S} limit 60),
l as (select *, 'https://site.example/story/' || coalesce(slug, '') as link, {_LINE('summary')} as line from r),
rss as (select position, id, '<item><title>' || {_XML('headline')} || '</title><link>' || {_XML('link')} || '</link><guid isPermaLink="true">' || {_XML('link')} || '</guid><pubDate>' || strftime(fetched_at, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate><category>'
|| {_XML('category')} || '</category><source url="' || {_XML('canonical_url')} || '">' || {_XML('source_name')} || '</source><description>' || {_XML("(" + short_sql('line', 400) + ") || ' (Reported by ' || coalesce(source_name, '') || ')'")} || '</description></item>' as item from l)"""


def _search(cond: str, words: list[str], page: int, size: int) -> str:
    held = " and ".join(f"contains(t, '{w}')" for w in words)
    return f"""with t as (select s.id, headline, fetched_at, lower(concat_ws(' ', {_LINE('headline')}, {_LINE('summary')}, source_name, category)) as t from {PUB} s left join news_source n on n.id = s.source_id where {cond}),
h as (select * from t where {held}), p as (select id, headline, row_number() over (order by {NEW}) as position from h)
select position, id, headline, (select count(*) from h) as n_hits, cast((select greatest(1, ceil(count(*) / {size}.0)) from h) as integer) as total_pages from p where position > {(page - 1) * size} and position <= {page * size}"""


SQL = {
    "homepage_top": f"with {TOP} select position, case when position = 1 then 'lead' else 'top' end as slot, t.id, headline, source_name, importance from top13 t left join news_source s on s.id = t.source_id where position <= 7",
    "latest_rail": f"""with {TOP}, rail as (select id, headline, cluster_id, fetched_at from {PUB} order by {NEW} limit 40),
free as (select * from rail where id not in (select id from top13) and (cluster_id is null or cluster_id not in (select cluster_id from top13 where cluster_id is not null))),
one as (select * from free qualify row_number() over (partition by {GRP} order by {NEW}) = 1)
select row_number() over (order by {NEW}) as position, id, headline from one order by {NEW} limit 8""",
    "category_sections": f"""with r as (select *, row_number() over (partition by category order by {NEW}) as r from {PUB} where list_contains({CATS}, category)),
f as (select * from r where r <= 20 qualify row_number() over (partition by category, {GRP} order by r) = 1),
p as (select *, row_number() over (partition by category order by r) as position from f)
select list_position({CATS}, category) as section, category, position, id, headline from p where position <= 5""",
    "category_page": f"""with r as (select *, row_number() over (partition by category order by {NEW}) as r, count(*) over (partition by category) as n from {PUB} where category is not null)
select category, r as rank, id, cast(greatest(1, ceil(n / 18.0)) as integer) as total_pages from r where r between 19 and 36 qualify row_number() over (partition by category, {GRP} order by r) = 1""",
    "same_event": f"""with s as (select id, cluster_id, fetched_at from {PUB} where cluster_id is not null)
select a.id, row_number() over (partition by a.id order by b.fetched_at desc nulls last, b.id) as position, b.id as related_id from s a join s b on a.cluster_id = b.cluster_id and a.id <> b.id
qualify row_number() over (partition by a.id order by b.fetched_at desc nulls last, b.id) <= 6""",
    "more_like_this": f"""with s as (select id, category, cluster_id, fetched_at from {PUB} where category is not null)
select a.id, row_number() over (partition by a.id order by b.fetched_at desc nulls last, b.id) as position, b.id as related_id from s a join s b on a.category = b.category and a.id <> b.id and (a.cluster_id is null or b.cluster_id is null or a.cluster_id <> b.cluster_id)
qualify row_number() over (partition by a.id order by b.fetched_at desc nulls last, b.id) <= 6""",
    "search": _search("true", ["the", "panel"], 1, 15),
    "search_category": _search("category = 'sports'", ["said", "the"], 2, 5),
    "source_directory": f"""select s.id, source_name, source_type, trust_tier, weight, coalesce(n, 0) as n_stories, row_number() over (order by trust_tier asc nulls last, weight desc nulls last, source_name asc nulls last, s.id) as position
from news_source s left join (select source_id, count(*) as n from {PUB} group by 1) c on c.source_id = s.id""",
    "sources_by_type": f"""select source_type, count(*) as n_sources, count(c.source_id) as n_contributing, string_agg(source_name, '|' order by source_name) as names
from news_source s left join (select distinct source_id from {PUB}) c on c.source_id = s.id group by source_type""",
    "stories_by_category": f"select category, count(*) as n_stories from {PUB} group by category",
    "stories_by_source": f"select c.source_id, coalesce(source_name, '?') as source_name, n as n_stories from (select source_id, count(*) as n from {PUB} group by 1) c left join news_source s on s.id = c.source_id",
    "importance_by_source": f"select source_id, count(*) as n_stories, round(avg(importance), 6) as mean_importance from {PUB} group by 1 order by 2 desc, 1 limit 12",
    "platform_health": """with s as (select count(*) as n_stories, count(*) filter (where status = 'PUBLISHED') as n_published, count(image_url) as n_with_image, count(distinct cluster_id) as n_clusters, max(epoch_ms(fetched_at)) as newest_ms from story),
n as (select count(*) as n_sources, count(*) filter (where status = 'ACTIVE') as n_active, count(rss_url) as n_with_feed from news_source),
a as (select *, greatest(0.0, (epoch_ms(timestamp '2025-12-01 00:00:00') - newest_ms) / 3600000.0) as h from s, n)
select * exclude (h), round(h, 6) as age_hours, case when n_sources = 0 then 'misconfigured' when n_stories = 0 then 'empty' when h >= 6 then 'stale' else 'ok' end as state from a""",
    "cluster_rollup": f"with {ROLL} select * from roll",
    "counter_drift": f"""with {ROLL} select c.id as cluster_id, c.story_count as stored_stories, c.source_count as stored_sources, coalesce(r.story_count, 0) as story_count, coalesce(r.source_count, 0) as source_count
from story_cluster c left join roll r on r.cluster_id = c.id where c.story_count is distinct from coalesce(r.story_count, 0) or c.source_count is distinct from coalesce(r.source_count, 0)""",
    "widely_covered": f"with {ROLL} select cluster_id, source_count, story_count, title from roll where source_count > 1",
    "cluster_headlines": f"""select cluster_id, cast(to_json(list(headline order by r)) as varchar) as headlines from (select cluster_id, headline, row_number() over (partition by cluster_id order by {NEW}) as r from story where cluster_id is not null) where r <= 6 group by 1""",
    "vocabulary_coverage": f"""with k as (select 'category' as vocabulary, unnest({CATS}) as value union all select 'source_type', unnest(['PRIMARY_OFFICIAL', 'PROFESSIONAL_MEDIA', 'SPECIALIST_MEDIA', 'DIGITAL_PUBLISHER', 'INTERNATIONAL_MEDIA', 'BROADCAST', 'RADIO', 'HISTORICAL', 'EXPERT', 'CREATOR', 'SOCIAL_SIGNAL', 'UNVERIFIED'])),
c as (select category as value, count(*) as n from story group by 1), t as (select source_type as value, count(*) as n from news_source group by 1)
select k.vocabulary, k.value, coalesce(case k.vocabulary when 'category' then c.n else t.n end, 0) as n_rows, coalesce(case k.vocabulary when 'category' then c.n else t.n end, 0) = 0 as is_unused from k left join c on c.value = k.value left join t on t.value = k.value""",
    "site_map": f"""select unnest(['/', '/about', '/sources', '/search']) as path, 'page' as kind union all select '/category/' || unnest({CATS}), 'category'
union all select * from (select '/story/' || slug, 'story' from {PUB} order by {NEW} limit 1500)""",
    "feed_statistics": """select source_id, count(*) as n_items, count(*) filter (where length(trim(coalesce(title, ''), ' ')) >= 12 and starts_with(link, 'http')) as n_usable, count(image_url) as n_with_image, count(author) as n_with_author,
count(published_at) as n_with_date, count(distinct guid) as n_guids from raw_feed_item group by source_id""",
    "capped_items": """select source_id, count(*) filter (where r <= 25) as n_taken, count(*) filter (where r > 25) as n_beyond, max(item_id) filter (where r = least(25, n)) as last_taken
from (select source_id, item_id, row_number() over (partition by source_id order by fetched_at, item_id) as r, count(*) over (partition by source_id) as n from raw_feed_item) group by source_id""",
    "run_summary": """with i as (select source_id, count(*) as n, count(*) filter (where exists (select 1 from story s where s.source_id = r.source_id and s.headline = r.title)) as m from raw_feed_item r group by 1),
s as (select source_id, count(*) as n from story group by 1) select source_id, coalesce(i.n, 0) as n_items, coalesce(s.n, 0) as n_stories, coalesce(i.m, 0) as n_matched from i full join s using (source_id)""",
    "upserted_sources": """with inc as (select slug, upper(source_name) as source_name, weight + 1 as weight, 'PENDING' as status from news_source where trust_tier <= 2
union all select 'new-' || lower(country), country, cast(count(*) as integer), 'PENDING' from news_source group by country)
select slug, coalesce(i.source_name, s.source_name) as source_name, coalesce(i.weight, s.weight) as weight, coalesce(s.status, i.status) as status from news_source s full join inc i using (slug)""",
    "after_deletes": """with one as (select cluster_id from story where cluster_id is not null group by 1 having count(distinct source_id) = 1)
select id, case when cluster_id in (select cluster_id from one) then null else cluster_id end as cluster_id from story where source_id is null or source_id not in (select id from news_source where trust_tier >= 5)""",
    "rss_items": f"with {_RSS} select position, id, item from rss",
    "rss_channel": f"""with {_RSS} select '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>Tidewire</title><link>https://site.example</link><lastBuildDate>Tue, 28 Oct 2025 00:00:00 GMT</lastBuildDate><atom:link href="https://site.example/rss.xml" rel="self" type="application/rss+xml" />'
|| string_agg(item, '' order by position) || '</channel></rss>' as document from rss""",
    "story_json_ld": f"""select s.id, replace(replace(replace('{{"@context":"https://schema.org","@type":"NewsArticle"' || case when headline is null then '' else ',"headline":' || cast(to_json(headline) as varchar) end || case when s.slug is null then '' else ',"url":' || cast(to_json('https://site.example/story/' || s.slug) as varchar) end
|| case when fetched_at is null then '' else ',"datePublished":"' || strftime(fetched_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"' end || case when category is null then '' else ',"articleSection":' || cast(to_json(category) as varchar) end || case when s.lang is null then '' else ',"inLanguage":' || cast(to_json(s.lang) as varchar) end
|| ',"author":{{"@type":"Organization"' || case when source_name is null then '' else ',"name":' || cast(to_json(source_name) as varchar) end || '}}}}', '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') as json from {PUB} s left join news_source n on n.id = s.source_id""",
}
