"""From feed items to stored stories: normalised or rejected items, those not yet stored in order of arrival, their category, region,
importance and keys, and the ledger of a run.

Defined results: an item without a usable title or https address is rejected; one without a source or time is taken, but
matches by its address only; a missing description and content give a summary that only points to the source. Repeated
item ids are items of their own with one verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.formats import truncate, unique_slug
from tidewire.functions.text import hex_code, hex_to_long, html_to_text, simhash_hex, single_line, title_key
from tidewire.functions.urls import image_url, normalize_url
from tidewire.operators import arrival
from tidewire.operators.editorial import NOW_MS, classify, importance
from tidewire.operators.timestamps import normalise_times
from tidewire.session import step, table, written

# Longest headline, summary and excerpt, shortest headline; hours and bits of the duplicate rules; cap of items
# that a run takes from a source; hours of future and earliest time that a published time may have.
MOST_HEADLINE, MOST_SUMMARY, MOST_EXCERPT, LEAST_HEADLINE = 240, 320, 600, 12
HOURS, BITS, CAP = 72, 4, 25
FUTURE_HOURS, EARLIEST_MS = 36, 788_918_400_000


def sane_time(ms: str, now_ms: str) -> Column:
    """A published time (milliseconds), or null where it lies over 36 hours ahead or before 1995."""
    return F.when((F.col(ms) <= F.col(now_ms) + FUTURE_HOURS * 3_600_000) & (F.col(ms) >= EARLIEST_MS), F.col(ms))


def normalized(items: DataFrame) -> DataFrame:
    """items (item_id, source_id, title, link, description, content, author, image_url, categories, published_ms, now_ms) -> the
    usable ones: item_id, source_id, headline, url, summary, excerpt, author, image_url, categories, ms, now_ms, time_inferred."""
    used = items.select("item_id", "source_id", "title", "link", "description", "content", "author", "image_url", "categories", "published_ms", "now_ms")
    df = step(used, _h=truncate(single_line("title"), MOST_HEADLINE), _u=normalize_url("link"), _d=html_to_text("description"), _c=html_to_text("content"))
    df = df.where((F.length("_h") >= LEAST_HEADLINE) & F.col("_u").rlike("(?i)^https://"))
    longer = F.when(F.length("_c") > F.length("_d"), F.col("_c")).otherwise(F.col("_d"))
    # the texts are plain by now: what is left of single_line is the blanks
    df = step(df, _b=F.trim(F.regexp_replace(single_line(longer), r"\s+", " ")), _t=sane_time("published_ms", "now_ms"))
    usable = (F.col("_b") != "") & (F.lower("_b") != F.lower("_h"))
    return df.select(
        "item_id", "source_id", F.col("_h").alias("headline"), F.col("_u").alias("url"),
        F.when(usable, truncate("_b", MOST_SUMMARY)).otherwise(F.concat("_h", F.lit(". Full report at the source."))).alias("summary"),
        F.when(usable, truncate("_b", MOST_EXCERPT)).alias("excerpt"), "author", image_url("image_url").alias("image_url"), "categories",
        F.when(F.col("_t") <= F.col("now_ms"), F.col("_t")).otherwise(F.col("now_ms")).alias("ms"), "now_ms", F.col("_t").isNull().alias("time_inferred"),
    )


def fingerprinted(items: DataFrame) -> DataFrame:
    """normalized items with url_hash, title_key and simhash (headline twice and summary)."""
    return items.withColumns({"url_hash": F.sha2("url", 256), "title_key": title_key("headline"), "simhash": simhash_hex(F.concat_ws(" ", "headline", "headline", "summary"))})


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (source_id, url_hash, title_key, simhash, ms) with slot, code and the keys of the three rules."""
    slot = F.floor(F.col("ms") / (HOURS * 3_600_000))
    df = rows.withColumns({"slot": slot, "code": hex_to_long(hex_code("simhash"))})
    url = arrival.digest("u", hex_code("url_hash"))
    title = lambda n: arrival.digest("t", hex_code("title_key"), F.col("source_id"), F.col("slot") + n)
    return df.withColumns({"url": url, "title": title(0), "titles": F.array_compact(F.array(title(-1), title(0), title(1)))})


def new_items(items: DataFrame, stored: DataFrame) -> DataFrame:
    """fingerprinted items (with arrival_no) and a verdict: item_id, arrival_no, status (created or duplicate). An item is a
    duplicate if a stored story, or an item accepted before it, has its address, or within 72 hours and its source its title
    key or a fingerprint at most 4 bits off."""
    span = HOURS * 3_600_000
    mine, old = written(_keyed(items), "items"), _keyed(stored)
    same_url = mine.join(old.select("url"), "url").select("arrival_no", "item_id")
    by_title = mine.select("arrival_no", "item_id", F.col("ms").alias("at"), F.explode("titles").alias("title")).join(old.select("title", "ms"), "title")
    same_title = by_title.where(F.abs(F.col("at") - F.col("ms")) <= span).select("arrival_no", "item_id")
    own, theirs = arrival.cells(mine, BITS), arrival.cells(old, BITS)
    met = arrival.near(own, theirs.withColumn("new", F.lit(False)).unionByName(own.withColumn("new", F.lit(True))), BITS)
    stale = ~F.col("new")
    met = met.groupBy("a_source_id", "a_slot", "a_code").agg(
        F.collect_set(F.when(F.col("new"), arrival.code_key())).alias("codes"), F.max(stale & (F.col("slot") == F.col("a_slot"))).alias("same_slot"),
        F.max(F.when(stale & (F.col("slot") < F.col("a_slot")), F.col("last_ms"))).alias("before"), F.min(F.when(stale & (F.col("slot") > F.col("a_slot")), F.col("first_ms"))).alias("after"),
    )
    fits = F.coalesce(F.col("same_slot") | (F.col("before") >= F.col("ms") - span) | (F.col("after") <= F.col("ms") + span), F.lit(False))
    at = (F.col("source_id") == F.col("a_source_id")) & (F.col("slot") == F.col("a_slot")) & (F.col("code") == F.col("a_code"))
    by_key = same_url.unionByName(same_title).distinct().withColumn("known", F.lit(True))
    rows = mine.join(by_key, ["arrival_no", "item_id"], "left").join(met, at, "left")
    none = F.array().cast("array<binary>")
    rows = written(
        rows.select(
            F.struct("arrival_no", F.col("item_id").alias("id")).alias("a"), "ms", (F.col("known").isNotNull() | fits).alias("old"), F.array_compact(F.array("url")).alias("plain"),
            F.array_compact(F.array(F.when(F.col("codes").isNotNull(), arrival.code_key()), "title")).alias("timed"), F.concat(F.coalesce("codes", none), "titles").alias("close"),
        ),
        "probed",
    )
    fresh = arrival.first_come(rows.where("not old"), rows.count(), span)
    verdicts = rows.where("old").select("a", F.lit(False).alias("accepted")).unionByName(fresh).groupBy("a").agg(F.min("accepted").alias("accepted"))
    return verdicts.select(F.col("a.id").alias("item_id"), "a.arrival_no", F.when(F.col("accepted"), "created").otherwise("duplicate").alias("status"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "raw_feed_item").select("item_id", "source_id", "title", "link", "description", "content", "author", "image_url", "categories", "published_at", F.unix_millis("fetched_at").alias("now_ms"))
    return normalise_times(rows, "published_at", "source_id", table(spark, sf_dir, "news_source"), out="published_ms")


def normalized_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable feed item in the form it would be stored in."""
    return normalized(_items(spark, sf_dir)).select("item_id", "headline", "url", "summary", "excerpt", "image_url")


def _arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable items in order of arrival (time of fetch); their published time is the time of fetch too."""
    items = normalized(_items(spark, sf_dir)).withColumn("ms", F.col("now_ms")).withColumn("arrival_no", F.col("now_ms"))
    return written(fingerprinted(items.where("item_id is not null")), "fingerprinted")


def _outcomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprinted items, and the verdict on each against an empty store: what a first run over all feeds takes in."""
    items = _arrived(spark, sf_dir)
    nothing = spark.createDataFrame([], "source_id string, url_hash string, title_key string, simhash string, ms bigint")
    return items, new_items(items, nothing)


def item_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir)[1].select("item_id", "status")


def ingested_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The created stories as rows for the store: keys, slug, category, region, importance and the text that search looks in."""
    items, verdicts = _outcomes(spark, sf_dir)
    created = items.join(verdicts.where("status = 'created'").select("item_id", "arrival_no").distinct(), ["item_id", "arrival_no"])
    sources = table(spark, sf_dir, "news_source").select(
        F.col("id").alias("source_id"), "source_name", F.split("categories", ",").alias("declared"), "source_type", "country", "trust_tier", "weight", "lang"
    )
    rows = created.withColumnRenamed("item_id", "id").withColumnRenamed("categories", "sections").join(sources, "source_id", "left")
    rows = written(rows, "created")
    classes = classify(rows).select("id", "category", "region")
    rows = rows.join(classes, "id")
    scores = importance(rows.withColumn("n_sources", F.lit(1)), NOW_MS)
    rows = rows.join(scores, "id")
    search = F.substring(F.lower(F.concat_ws(" ", "headline", "summary", "source_name", "category")), 1, 2000)
    return rows.select(
        "id", "source_id", "headline", unique_slug("headline", "url_hash").alias("slug"), "summary", "excerpt", F.col("url").alias("canonical_url"), "author", "category", "region", F.coalesce("lang", F.lit("en")).alias("lang"),
        "image_url", "url_hash", "title_key", "simhash", "importance", search.alias("search_text"),
    )


def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source, and of all together (source_id null, is_total): items seen, rejected, duplicate and created."""
    seen = table(spark, sf_dir, "raw_feed_item").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_seen"))
    items, verdicts = _outcomes(spark, sf_dir)
    found = items.select("item_id", "arrival_no", "source_id").join(verdicts, ["item_id", "arrival_no"]).groupBy("source_id").agg(F.count_if(F.col("status") == "created").alias("n_created"), F.count_if(F.col("status") == "duplicate").alias("n_duplicate"))
    found = found.withColumnRenamed("source_id", "s")
    rows = seen.join(found, F.col("source_id").eqNullSafe(F.col("s")), "left").select("source_id", "n_seen", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_created", "n_duplicate")])
    rows = rows.withColumn("n_rejected", F.col("n_seen") - F.col("n_created") - F.col("n_duplicate")).withColumn("is_total", F.lit(False))
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_seen", "n_created", "n_duplicate", "n_rejected")])
    return rows.unionByName(total.select(F.lit(None).cast("string").alias("source_id"), "n_seen", "n_created", "n_duplicate", "n_rejected", F.lit(True).alias("is_total")))
