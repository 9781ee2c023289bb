"""Feed documents (RSS 2.0, RSS 1.0/RDF, Atom) to typed items, with from_xml; and items back to feed documents.

Records that are no feed, or that the XML reader cannot take, give no items; an item without a title or a link is dropped.
Named HTML entities, which XML does not know, are written as their characters first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import NAMED_ENTITIES, trim_ws
from tidewire.functions.urls import resolve_url
from tidewire.operators.serving import xml_escape
from tidewire.session import step, table

_TEXT = "struct<_VALUE:string>"
_LINK = "array<struct<_VALUE:string,_href:string,_rel:string,_type:string>>"
_MEDIA = "array<struct<_url:string,_type:string,_medium:string>>"
ITEM = (
    f"struct<title:array<{_TEXT}>,link:{_LINK},guid:array<struct<_VALUE:string,_isPermaLink:string>>,id:string,description:string,summary:string,subtitle:string,`content:encoded`:string,"
    f"content:array<struct<_VALUE:string,_type:string>>,pubDate:string,published:string,`dc:date`:string,updated:string,date:string,author:array<struct<_VALUE:string,name:string>>,`dc:creator`:string,creator:string,"
    f"category:array<struct<_VALUE:string,_term:string>>,categories:array<struct<_VALUE:string,_term:string>>,`dc:subject`:array<string>,`media:content`:{_MEDIA},`media:thumbnail`:{_MEDIA},enclosure:{_MEDIA},"
    f"`media:group`:array<struct<`media:content`:{_MEDIA},`media:thumbnail`:{_MEDIA}>>,image:array<struct<_VALUE:string,url:string>>,body:string,`itunes:summary`:string,lastBuildDate:string,`feedburner:origLink`:string,origLink:string>"
)
FEED = f"channel struct<title:string,item:array<{ITEM}>>, item array<{ITEM}>, title string, entry array<{ITEM}>"
PARSED = "title link description content author image_url guid published_at categories".split()


def _xml(x: Column) -> Column:
    for name, ch in NAMED_ENTITIES.items():
        if name not in ("amp", "lt", "gt", "quot", "apos"):
            x = F.replace(x, F.lit(f"&{name};"), F.lit(ch))
    return x


def _first(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(trim_ws(c), F.lit("")) for c in cols])


def _link(i: str) -> Column:
    """Of an item: an alternate HTML href, the element's text, any href, a guid that is a link, the link before a redirect."""
    links = F.col(f"{i}.link")
    good = F.filter(links, lambda x: x["_href"].isNotNull() & F.coalesce(x["_rel"] == "alternate", F.lit(True)) & F.coalesce(x["_type"].contains("html"), F.lit(True)))
    text = F.filter(links, lambda x: trim_ws(x["_VALUE"]) != "")
    href = F.filter(links, lambda x: x["_href"].isNotNull())
    guid = F.filter(F.col(f"{i}.guid"), lambda x: F.coalesce(F.lower(x["_isPermaLink"]) != "false", F.lit(True)) & trim_ws(x["_VALUE"]).rlike("(?i)^https?://"))
    return _first(F.get(good, 0)["_href"], F.get(text, 0)["_VALUE"], F.get(href, 0)["_href"], F.get(guid, 0)["_VALUE"], F.col(f"{i}.`feedburner:origLink`"), F.col(f"{i}.origLink"))


def _image(i: str, base: Column | None) -> Column:
    """Of an item: a media element (its own, then a group's), an enclosure or an image element that is a picture, or the first
    picture of its HTML that is no tracking pixel."""
    ext = r"(?i)\.(?:jpe?g|png|webp|avif|gif)(?:\?|#|\z)"
    some = lambda x: F.coalesce(x, F.array().cast(_MEDIA))
    group = F.coalesce(F.col(f"{i}.`media:group`"), F.array().cast(f"array<struct<`media:content`:{_MEDIA},`media:thumbnail`:{_MEDIA}>>"))
    nested = F.flatten(F.transform(group, lambda g: F.concat(some(g["media:content"]), some(g["media:thumbnail"]))))
    media = F.concat(some(F.col(f"{i}.`media:content`")), some(F.col(f"{i}.`media:thumbnail`")), nested, some(F.transform(F.col(f"{i}.enclosure"), lambda x: F.struct(x["_url"], x["_type"], F.lit(None).cast("string").alias("_medium")))))
    picture = lambda x: F.coalesce(x["_medium"] == "image", F.lit(False)) | F.coalesce(x["_type"].startswith("image/"), F.lit(False)) | F.coalesce(x["_url"].rlike(ext), F.lit(False))
    urls = F.transform(F.filter(media, picture), lambda x: x["_url"])
    own = F.transform(F.coalesce(F.col(f"{i}.image"), F.array().cast("array<struct<_VALUE:string,url:string>>")), lambda x: F.coalesce(x["url"], x["_VALUE"]))
    html = F.coalesce(*[F.nullif(x, F.lit("")) for x in (F.col(f"{i}.`content:encoded`"), F.get(F.col(f"{i}.content"), 0)["_VALUE"], F.col(f"{i}.body"), F.col(f"{i}.description"), F.col(f"{i}.summary"))], F.lit(""))
    in_html = F.filter(F.slice(F.regexp_extract_all(html, F.lit("(?i)<img[^>]+src=[\"']([^\"']+)"), F.lit(1)), 1, 1), lambda u: ~u.rlike(r"(?i)/(?:pixel|spacer|1x1|blank)\."))
    found = F.concat(urls, F.filter(own, lambda u: u.rlike(ext)), in_html)
    resolved = found if base is None else F.transform(found, lambda u: resolve_url(u, base))
    return F.get(F.filter(resolved, lambda u: u != ""), 0)


def _author(i: str) -> Column:
    a = F.get(F.col(f"{i}.author"), 0)
    raw = _first(F.col(f"{i}.`dc:creator`"), a["name"], a["_VALUE"], F.col(f"{i}.creator"))
    name = F.regexp_replace(F.regexp_replace(raw, r"^\S+@\S+\s*\((.*)\)\z", "$1"), r"(?i)^by\s+", "")
    return F.when((F.length(name).between(1, 120)) & ~name.rlike("(?i)^https?://"), name)


def parse_feeds(feeds: DataFrame, xml: str, base: str | None = None) -> DataFrame:
    """feeds with one row per item: the other columns of feeds, and title ... categories. base: column of the feed's address."""
    kept = [c for c in feeds.columns if c != xml]
    df = step(feeds, _f=F.from_xml(_xml(F.col(xml)), FEED, {"ignoreNamespace": "false"}))
    items = F.coalesce("_f.channel.item", "_f.item", "_f.entry")
    df = df.select(*kept, F.explode(items).alias("_i"))
    none = F.array().cast("array<string>")
    named = lambda x: F.coalesce(F.transform(x, lambda c: F.coalesce(c["_term"], c["_VALUE"])), none)
    cats = F.concat(named("_i.category"), F.coalesce("_i.`dc:subject`", none), named("_i.categories"))
    cats = F.slice(F.array_distinct(F.filter(F.transform(cats, trim_ws), lambda c: F.length(c).between(1, 60))), 1, 12)
    link = _link("_i") if base is None else resolve_url(_link("_i"), base)
    out = df.select(
        *kept, _first(F.get("_i.title", 0)["_VALUE"]).alias("title"), link.alias("link"), F.coalesce("_i.description", "_i.summary", "_i.subtitle", "_i.`itunes:summary`").alias("description"),
        F.coalesce(F.col("_i.`content:encoded`"), F.get("_i.content", 0)["_VALUE"], F.col("_i.body")).alias("content"), _author("_i").alias("author"), _image("_i", None if base is None else F.col(base)).alias("image_url"),
        _first(F.get("_i.guid", 0)["_VALUE"], F.col("_i.id")).alias("guid"), _first(*[F.col(f"_i.{c}") for c in ("pubDate", "published", "`dc:date`", "updated", "date", "lastBuildDate")]).alias("published_at"), cats.alias("categories"),
    )
    return out.where(F.col("title").isNotNull() & (F.col("link") != ""))


def feed_document(title: Column, link: Column, author: Column, guid: Column, published: Column, description: Column) -> Column:
    """One item as an RSS 2.0 document."""
    tag = lambda name, x: F.when(x.isNotNull(), F.concat(F.lit(f"<{name}>"), xml_escape(x), F.lit(f"</{name}>"))).otherwise("")
    return F.concat(
        F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>t</title><item>'), tag("title", title), tag("link", link), tag("dc:creator", author), tag("guid", guid), tag("pubDate", published), tag("description", description),
        F.lit("</item></channel></rss>"),
    )


def feed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feed item written as a feed document and read back."""
    rows = table(spark, sf_dir, "raw_feed_item")
    docs = rows.select("item_id", feed_document(*[F.col(c) for c in ("title", "link", "author", "guid", "published_at", "description")]).alias("xml"))
    return parse_feeds(docs, "xml").select("item_id", "title", "link", "guid", "published_at", F.nullif(F.trim("description"), F.lit("")).alias("description"))


FEED_SQL = {
    "feed_round_trip": r"""with t as (select item_id, trim(title) as title, trim(link) as link, nullif(trim(guid), '') as guid, nullif(trim(published_at), '') as published_at, nullif(trim(description), '') as description from raw_feed_item)
select item_id, title, coalesce(nullif(link, ''), case when regexp_matches(guid, '^(?i:https?)://') then guid end) as link, guid, published_at, description from t where title <> '' and coalesce(nullif(link, ''), case when regexp_matches(guid, '^(?i:https?)://') then guid end) <> ''""",
}
