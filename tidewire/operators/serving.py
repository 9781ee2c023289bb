"""Reading queries over stories, sources and clusters: front page, sections, related stories, search, directory, roll-ups.

Every order ends with the id, so ties have one result. Times are fetched_at. Nulls: a story without a cluster stands for
itself when lists are collapsed; missing counts are 0. Empty tables give empty results (one row for platform_health).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.formats import truncate
from tidewire.functions.text import single_line
from tidewire.session import step, table

# Categories in their order of display, and source types.
CATEGORIES = ("nigeria", "politics", "business", "technology", "sports", "entertainment", "world")
SOURCE_TYPES = (
    "PRIMARY_OFFICIAL", "PROFESSIONAL_MEDIA", "SPECIALIST_MEDIA", "DIGITAL_PUBLISHER", "INTERNATIONAL_MEDIA", "BROADCAST",
    "RADIO", "HISTORICAL", "EXPERT", "CREATOR", "SOCIAL_SIGNAL", "UNVERIFIED",
)


#: The time at which the queries look at the front page.
NOW = "2025-10-28 00:00:00"


def by_importance() -> list[Column]:
    return [F.desc_nulls_last("importance"), F.desc_nulls_last("fetched_at"), F.asc("id")]


def newest() -> list[Column]:
    return [F.desc_nulls_last("fetched_at"), F.asc("id")]


def group_of() -> Column:
    """What a list is collapsed by: the cluster, or the story itself where it has none."""
    return F.coalesce(F.concat(F.lit("c"), F.col("cluster_id")), F.concat(F.lit("s"), F.col("id")))


def collapsed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each cluster in the given order; rows without a cluster all stay."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group_of()).orderBy(*order))).where("_n = 1").drop("_n")


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "story").where(F.col("status") == "PUBLISHED")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "news_source")


def _positioned(rows: DataFrame, order: list[Column]) -> DataFrame:
    """A short list (already limited) with its positions from 1."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def _top_block(stories: DataFrame, now: str) -> DataFrame:
    """The 13 rows of the front page's top with their position: of the last 48 hours the 60 most important, collapsed, cut; where
    these hours have no story, the newest 40 instead, in their order."""
    cols = ["id", "headline", "cluster_id", "source_id", "importance", "fetched_at"]
    since = F.lit(now).cast("timestamp") - F.expr("interval 48 hours")
    recent = stories.where(F.col("fetched_at") >= since).select(*cols).orderBy(*by_importance()).limit(60)
    recent = recent.withColumn("_o", F.row_number().over(Window.orderBy(*by_importance())))
    quiet = recent.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    latest = stories.select(*cols).orderBy(*newest()).limit(40).withColumn("_o", F.row_number().over(Window.orderBy(*newest())))
    pool = recent.unionByName(latest.join(F.broadcast(quiet)).drop("_n"))  # one row or none
    return _positioned(collapsed(pool, [F.col("_o")]).orderBy("_o").limit(13), [F.col("_o")])


def homepage_top(spark: SparkSession, sf_dir: str, now: str = NOW) -> DataFrame:
    """Lead and top rows of the front page with their sources."""
    top = _top_block(_stories(spark, sf_dir), now).where("position <= 7")
    names = _sources(spark, sf_dir).select(F.col("id").alias("source_id"), "source_name")
    slot = F.when(F.col("position") == 1, "lead").otherwise("top")
    return top.join(names, "source_id", "left").select("position", slot.alias("slot"), "id", "headline", "source_name", "importance")


def latest_rail(spark: SparkSession, sf_dir: str, now: str = NOW) -> DataFrame:
    """The newest 40 without what the top block shows (all 13 rows, by id and by cluster), collapsed, first 8."""
    stories = _stories(spark, sf_dir)
    shown = _top_block(stories, now)
    rail = stories.select("id", "headline", "cluster_id", "fetched_at").orderBy(*newest()).limit(40)
    rail = rail.join(shown.select("id"), "id", "left_anti").join(shown.where("cluster_id is not null").select("cluster_id"), "cluster_id", "left_anti")
    return _positioned(collapsed(rail, newest()).orderBy(*newest()).limit(8), newest()).select("position", "id", "headline")


def category_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each category its newest 20, collapsed within the category, first 5; one window query for all categories."""
    ranked = _stories(spark, sf_dir).where(F.col("category").isin(*CATEGORIES)).withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy(*newest()))).where("_r <= 20")
    first = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("category", group_of()).orderBy("_r"))).where("_n = 1")
    placed = first.withColumn("position", F.row_number().over(Window.partitionBy("category").orderBy("_r"))).where("position <= 5")
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")).cast("int")
    return placed.select(order.alias("section"), "category", "position", "id", "headline")


def category_page(spark: SparkSession, sf_dir: str, page: int = 2, size: int = 18) -> DataFrame:
    """One page of every category: paged first, then collapsed, with the number of pages."""
    page = min(max(page, 1), 500)
    ranked = _stories(spark, sf_dir).where(F.col("category").isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy(*newest())))
    pages = _stories(spark, sf_dir).where(F.col("category").isNotNull()).groupBy("category").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias("total_pages"))
    rows = ranked.where(F.col("_r").between((page - 1) * size + 1, page * size))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("category", group_of()).orderBy("_r"))).where("_n = 1")
    return first.join(pages, "category").select("category", F.col("_r").alias("rank"), "id", "total_pages")


def same_event(spark: SparkSession, sf_dir: str, k: int = 6) -> DataFrame:
    """For every story the newest k others of its cluster. Only a cluster's newest k + 1 can be among them, so a large
    cluster is ranked once and never paired with itself."""
    stories = _stories(spark, sf_dir).where(F.col("cluster_id").isNotNull()).select("id", "cluster_id", "fetched_at")
    best = stories.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*newest()))).where(F.col("_r") <= k + 1)
    best = best.select("cluster_id", F.col("id").alias("related_id"), "_r")
    pairs = stories.select("id", "cluster_id").join(best, "cluster_id").where("id <> related_id")
    return pairs.withColumn("position", F.row_number().over(Window.partitionBy("id").orderBy("_r"))).where(F.col("position") <= k).select("id", "position", "related_id")


def more_like_this(spark: SparkSession, sf_dir: str, k: int = 6) -> DataFrame:
    """For every story the newest k of its category outside its cluster. Of a category the newest 2k + 1 rows, with at most k of
    any one cluster, are enough: leaving out one cluster and one story leaves k."""
    stories = _stories(spark, sf_dir).where(F.col("category").isNotNull()).select("id", "category", "cluster_id", "fetched_at")
    few = stories.withColumn("_c", F.row_number().over(Window.partitionBy("category", group_of()).orderBy(*newest()))).where(F.col("_c") <= k)
    best = few.withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy(*newest()))).where(F.col("_r") <= 2 * k + 1)
    best = best.select("category", F.col("id").alias("related_id"), F.col("cluster_id").alias("related_cluster"), "_r")
    pairs = stories.join(best, "category").where((F.col("id") != F.col("related_id")) & ~F.coalesce(F.col("cluster_id") == F.col("related_cluster"), F.lit(False)))
    return pairs.withColumn("position", F.row_number().over(Window.partitionBy("id").orderBy("_r"))).where(F.col("position") <= k).select("id", "position", "related_id")


def search_terms(raw: str) -> list[str]:
    """The words of a search box text: cleaned, lower case, at most six."""
    import re

    kept = re.sub(r"[^\w\s'-]|_", " ", re.sub(r"[%_\\]", " ", raw.strip()[:120]))
    return kept.lower().split()[:6]


def search_text() -> Column:
    """What search looks in: headline, summary, source and category as one lower-case line."""
    return F.lower(F.concat_ws(" ", single_line("headline"), single_line("summary"), "source_name", "category"))


def search(spark: SparkSession, sf_dir: str, query: str = "the panel", page: int = 1, size: int = 15, category: str | None = None) -> DataFrame:
    """A page of the stories whose search text holds all words, newest first, with the number of hits and of pages."""
    words = search_terms(query) if len(query.strip()) >= 2 else []
    page = min(max(page, 1), 100)
    hits = _stories(spark, sf_dir).where(F.lit(bool(words)))
    if category in CATEGORIES:
        hits = hits.where(F.col("category") == category)
    hits = hits.join(_sources(spark, sf_dir).select(F.col("id").alias("source_id"), "source_name"), "source_id", "left")
    hits = step(hits.select("id", "headline", "summary", "source_name", "category", "fetched_at"), _text=search_text())
    for w in words:
        hits = hits.where(F.col("_text").contains(w))
    total = hits.agg(F.count(F.lit(1)).alias("n_hits")).select("n_hits", F.greatest(F.lit(1), F.ceil(F.col("n_hits") / size)).cast("int").alias("total_pages"))
    rows = hits.select("id", "headline", "fetched_at").orderBy(*newest()).limit(page * size)
    placed = _positioned(rows, newest()).where(F.col("position") > (page - 1) * size)
    return placed.join(F.broadcast(total)).select("position", "id", "headline", "n_hits", "total_pages")  # one row


def search_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a search within one category."""
    return search(spark, sf_dir, "said the", 2, 5, "sports")


def source_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with the number of its published stories, best trusted first."""
    n = _stories(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_stories"))
    order = Window.orderBy(F.asc_nulls_last("trust_tier"), F.desc_nulls_last("weight"), F.asc_nulls_last("source_name"), "id")
    rows = _sources(spark, sf_dir).join(n, F.col("id") == F.col("source_id"), "left")
    return rows.select("id", "source_name", "source_type", "trust_tier", "weight", F.coalesce("n_stories", F.lit(0)).alias("n_stories"), F.row_number().over(order).alias("position"))


def sources_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-empty source types with their sources' names and how many of them contribute."""
    n = _stories(spark, sf_dir).select("source_id").distinct().withColumn("contributes", F.lit(1))
    rows = _sources(spark, sf_dir).join(n, F.col("id") == F.col("source_id"), "left")
    return rows.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("n_sources"), F.count("contributes").alias("n_contributing"), F.array_join(F.array_sort(F.collect_list("source_name")), "|").alias("names")
    )


def stories_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stories(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n_stories"))


def stories_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _stories(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_stories"))
    names = _sources(spark, sf_dir).select(F.col("id").alias("source_id"), "source_name")
    return n.join(names, "source_id", "left").select("source_id", F.coalesce("source_name", F.lit("?")).alias("source_name"), "n_stories")


def importance_by_source(spark: SparkSession, sf_dir: str, k: int = 12) -> DataFrame:
    """The k sources with most stories, and their mean importance."""
    n = _stories(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_stories"), F.round(F.avg("importance"), 6).alias("mean_importance"))
    return n.orderBy(F.desc("n_stories"), "source_id").limit(k)


def platform_health(spark: SparkSession, sf_dir: str, now: str = "2025-12-01 00:00:00", stale_hours: int = 6) -> DataFrame:
    """One row: counts of stories and sources, age of the newest story, and the state that follows from it."""
    at = F.lit(now).cast("timestamp_ntz")
    s = table(spark, sf_dir, "story").agg(
        F.count(F.lit(1)).alias("n_stories"), F.count_if(F.col("status") == "PUBLISHED").alias("n_published"), F.count("image_url").alias("n_with_image"), F.count_distinct("cluster_id").alias("n_clusters"),
        F.max(F.unix_millis("fetched_at")).alias("newest_ms"),
    )
    n = _sources(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_sources"), F.count_if(F.col("status") == "ACTIVE").alias("n_active"), F.count("rss_url").alias("n_with_feed"))
    now_ms = F.unix_millis(F.make_timestamp(F.year(at), F.month(at), F.day(at), F.hour(at), F.minute(at), F.second(at).cast("decimal(8,6)"), F.lit("UTC")))
    age = F.greatest(F.lit(0.0), (now_ms - F.col("newest_ms")) / 3_600_000.0)
    state = F.when(F.col("n_sources") == 0, "misconfigured").when(F.col("n_stories") == 0, "empty").when(age >= stale_hours, "stale").otherwise("ok")
    return s.join(F.broadcast(n)).withColumn("age_hours", F.round(age, 6)).withColumn("state", state)  # one row each


def cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters derived from their stories: counts, span, and title and category of the earliest story."""
    first = F.struct("fetched_at", "id")
    return table(spark, sf_dir, "story").where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("story_count"), F.count_distinct("source_id").alias("source_count"), F.min(F.unix_millis("fetched_at")).alias("first_ms"), F.max(F.unix_millis("fetched_at")).alias("last_ms"),
        F.min_by("headline", first).alias("title"), F.min_by("category", first).alias("category"),
    )


def counter_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored clusters whose counters are not what their stories say."""
    stored = table(spark, sf_dir, "story_cluster").select(F.col("id").alias("cluster_id"), F.col("story_count").alias("stored_stories"), F.col("source_count").alias("stored_sources"))
    real = cluster_rollup(spark, sf_dir).select("cluster_id", "story_count", "source_count")
    both = stored.join(real, "cluster_id", "left").na.fill(0, ["story_count", "source_count"])
    return both.where(~F.col("stored_stories").eqNullSafe(F.col("story_count")) | ~F.col("stored_sources").eqNullSafe(F.col("source_count")))


def widely_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that more than one source covers."""
    return cluster_rollup(spark, sf_dir).where("source_count > 1").select("cluster_id", "source_count", "story_count", "title")


def cluster_headlines(spark: SparkSession, sf_dir: str, k: int = 6) -> DataFrame:
    """Each cluster with its first k headlines as nested JSON."""
    ranked = table(spark, sf_dir, "story").where(F.col("cluster_id").isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*newest()))).where(F.col("_r") <= k)
    return ranked.groupBy("cluster_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_r", "headline"))), lambda x: x["headline"])).alias("headlines"))


def vocabulary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the vocabularies, how many rows have it, and whether none has."""
    known = spark.createDataFrame([("category", c) for c in CATEGORIES] + [("source_type", t) for t in SOURCE_TYPES], "vocabulary string, value string")
    used = table(spark, sf_dir, "story").select(F.lit("category").alias("vocabulary"), F.col("category").alias("value")).unionByName(_sources(spark, sf_dir).select(F.lit("source_type").alias("vocabulary"), F.col("source_type").alias("value")))
    n = used.groupBy("vocabulary", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    return known.join(n, ["vocabulary", "value"], "left").select("vocabulary", "value", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.col("n_rows").isNull().alias("is_unused"))


def site_map(spark: SparkSession, sf_dir: str, most: int = 1500) -> DataFrame:
    """Paths of the site: fixed pages, one per category, the newest stories."""
    fixed = spark.createDataFrame([(p, "page") for p in ("/", "/about", "/sources", "/search")], "path string, kind string")
    sections = spark.createDataFrame([(f"/category/{c}", "category") for c in CATEGORIES], "path string, kind string")
    stories = _stories(spark, sf_dir).select("id", "slug", "fetched_at").orderBy(*newest()).limit(most)
    return fixed.unionByName(sections).unionByName(stories.select(F.concat(F.lit("/story/"), "slug").alias("path"), F.lit("story").alias("kind")))


def feed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source's feed items: how many there are, are usable, and have an image, an author, a date."""
    usable = (F.length(F.trim(F.coalesce("title", F.lit("")))) >= 12) & F.col("link").startswith("http")
    return table(spark, sf_dir, "raw_feed_item").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(usable).alias("n_usable"), F.count("image_url").alias("n_with_image"), F.count("author").alias("n_with_author"),
        F.count("published_at").alias("n_with_date"), F.count_distinct("guid").alias("n_guids"),
    )


def capped_items(spark: SparkSession, sf_dir: str, cap: int = 25) -> DataFrame:
    """Of each source: the items that a run takes (the cap is the feature), those beyond it, the last one taken. Only the first
    ones of every partition are ranked; the others are counted."""
    items = table(spark, sf_dir, "raw_feed_item").select("source_id", "item_id", "fetched_at")
    ranked = items.withColumn("_r", F.row_number().over(Window.partitionBy("source_id").orderBy("fetched_at", "item_id"))).where(F.col("_r") <= cap)
    taken = ranked.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_taken"), F.max_by("item_id", "_r").alias("last_taken"))
    seen = items.groupBy(F.col("source_id").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return taken.join(seen, F.col("source_id").eqNullSafe(F.col("s"))).select("source_id", "n_taken", (F.col("n") - F.col("n_taken")).alias("n_beyond"), "last_taken")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: items seen, items whose title a stored story of the source has, stories stored."""
    items = table(spark, sf_dir, "raw_feed_item").select("source_id", "title")
    stories = table(spark, sf_dir, "story").select("source_id", F.col("headline").alias("title"))
    stored = items.join(stories.distinct(), ["source_id", "title"], "left_semi").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_matched"))
    seen = items.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_items"))
    made = stories.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_stories"))
    all_ = seen.join(made, "source_id", "full_outer").join(stored, "source_id", "left")
    return all_.select("source_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_items", "n_stories", "n_matched")])


def upserted_sources(spark: SparkSession, sf_dir: str, incoming: DataFrame | None = None) -> DataFrame:
    """The registry after an upsert by slug: incoming names, URLs and weights win, the stored status is never overwritten."""
    stored = _sources(spark, sf_dir).select("slug", "source_name", "weight", "status")
    if incoming is None:
        # a seed list: every other source anew with a changed weight, and one that is not stored yet per country
        seeds = _sources(spark, sf_dir)
        changed = seeds.where(F.col("trust_tier") <= 2).select("slug", F.upper("source_name").alias("source_name"), (F.col("weight") + 1).alias("weight"), F.lit("PENDING").alias("status"))
        new = seeds.groupBy("country").agg(F.count(F.lit(1)).cast("int").alias("weight")).select(F.concat(F.lit("new-"), F.lower("country")).alias("slug"), F.col("country").alias("source_name"), "weight", F.lit("PENDING").alias("status"))
        incoming = changed.unionByName(new)
    other = incoming.select("slug", *[F.col(c).alias(f"new_{c}") for c in ("source_name", "weight", "status")])
    both = stored.join(other, "slug", "full_outer")
    return both.select("slug", F.coalesce("new_source_name", "source_name").alias("source_name"), F.coalesce("new_weight", "weight").alias("weight"), F.coalesce("status", "new_status").alias("status"))


def after_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories after sources of the lowest trust and clusters of one source are deleted: the sources' stories go with them, the
    clusters' stories stay without a cluster."""
    gone = _sources(spark, sf_dir).where("trust_tier >= 5").select(F.col("id").alias("source_id"))
    single = cluster_rollup(spark, sf_dir).where("source_count = 1").select("cluster_id").withColumn("dropped", F.lit(True))
    left = table(spark, sf_dir, "story").join(gone, "source_id", "left_anti").join(single, "cluster_id", "left")
    return left.select("id", F.when(F.col("dropped").isNull(), F.col("cluster_id")).alias("cluster_id"))


def xml_escape(x: Column | str) -> Column:
    s = F.regexp_replace(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def _utc_text(ts: Column | str) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def rss_items(spark: SparkSession, sf_dir: str, k: int = 60, site: str = "https://site.example") -> DataFrame:
    """The newest k stories as RSS 2.0 items."""
    rows = _positioned(_stories(spark, sf_dir).select("id", "headline", "slug", "summary", "canonical_url", "category", "source_id", "fetched_at").orderBy(*newest()).limit(k), newest())
    rows = rows.join(_sources(spark, sf_dir).select(F.col("id").alias("source_id"), "source_name"), "source_id", "left")
    link = F.concat(F.lit(f"{site}/story/"), F.coalesce("slug", F.lit("")))
    name = F.coalesce("source_name", F.lit(""))
    rows = step(rows, _l=xml_escape(link), _d=xml_escape(F.concat(truncate(single_line("summary"), 400), F.lit(" (Reported by "), name, F.lit(")"))))
    tag = lambda n, x: F.concat(F.lit(f"<{n}>"), x, F.lit(f"</{n.split(' ')[0]}>"))
    item = F.concat(
        F.lit("<item>"), tag("title", xml_escape("headline")), tag("link", F.col("_l")), tag('guid isPermaLink="true"', F.col("_l")), tag("pubDate", F.coalesce(_utc_text("fetched_at"), F.lit(""))),
        tag("category", xml_escape("category")), F.lit('<source url="'), xml_escape("canonical_url"), F.lit('">'), xml_escape(name), F.lit("</source>"), tag("description", F.col("_d")), F.lit("</item>"),
    )
    return rows.select("position", "id", item.alias("item"))


def rss_channel(spark: SparkSession, sf_dir: str, now: str = NOW, title: str = "Tidewire", site: str = "https://site.example") -> DataFrame:
    """One row: the newest stories as an RSS 2.0 document."""
    items = rss_items(spark, sf_dir, site=site).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "item"))), lambda x: x["item"]), "").alias("items"))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel>'), F.lit(f"<title>{title}</title><link>{site}</link><lastBuildDate>"),
        _utc_text(F.lit(now).cast("timestamp")), F.lit(f'</lastBuildDate><atom:link href="{site}/rss.xml" rel="self" type="application/rss+xml" />'),
    )
    return items.select(F.concat(head, "items", F.lit("</channel></rss>")).alias("document"))


def json_ld_escape(x: Column | str) -> Column:
    """JSON for a script element: no sign that could end it."""
    s = F.col(x) if isinstance(x, str) else x
    for sign in "<>&\u2028\u2029":
        s = F.replace(s, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return s


def story_json_ld(spark: SparkSession, sf_dir: str, site: str = "https://site.example") -> DataFrame:
    """Every published story as a schema.org NewsArticle in JSON-LD."""
    names = _sources(spark, sf_dir).select(F.col("id").alias("source_id"), "source_name")
    rows = _stories(spark, sf_dir).join(names, "source_id", "left")
    at = F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    article = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("NewsArticle").alias("@type"), "headline", F.concat(F.lit(f"{site}/story/"), "slug").alias("url"), at.alias("datePublished"),
        F.col("category").alias("articleSection"), F.col("lang").alias("inLanguage"), F.struct(F.lit("Organization").alias("@type"), F.col("source_name").alias("name")).alias("author"),
    )
    return rows.select("id", json_ld_escape(F.to_json(article)).alias("json"))
