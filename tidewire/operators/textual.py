"""Queries over the text, URL and format functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import formats, urls
from tidewire.functions.text import hamming_hex, html_to_text, significant_tokens, simhash_hex, title_key, tokens
from tidewire.session import step, table

NOW_MS = 1_764_547_200_000  # 2025-12-01 00:00 UTC: queries take their 'now' as a value


def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed contents as plain text."""
    return table(spark, sf_dir, "raw_feed_item").select("item_id", html_to_text("content").alias("text"))


def normalized_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed links as canonical addresses, with their hash."""
    rows = step(table(spark, sf_dir, "raw_feed_item").select("item_id", "link"), url=urls.normalize_url("link"))
    return rows.select("item_id", "url", F.sha2(F.coalesce(F.nullif("url", F.lit("")), F.trim(F.coalesce("link", F.lit("")))), 256).alias("url_hash"), urls.display_host("link").alias("host"))


def story_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical address, its hash, and title key of every story, computed anew."""
    return table(spark, sf_dir, "story").select("id", urls.normalize_url("canonical_url").alias("canonical_url"), urls.url_hash("canonical_url").alias("url_hash"), title_key("headline").alias("title_key"))


def simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every story (headline twice and summary, by which the headline weighs more), and its distance to the stored one."""
    rows = table(spark, sf_dir, "story").select("id", "simhash", simhash_hex(F.concat_ws(" ", "headline", "headline", "summary")).alias("own"))
    return rows.select("id", F.col("own").alias("new_simhash"), hamming_hex(F.col("own"), F.col("simhash")).alias("distance"))


def headline_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "story").select("id", F.array_join(tokens("headline"), " ").alias("tokens"), F.array_join(significant_tokens("headline"), " ").alias("significant"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "story").select("id", formats.slugify("headline", 40).alias("slug"), formats.unique_slug("headline", "canonical_url").alias("unique_slug"))


def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "story").select("id", formats.truncate("summary", 160).alias("short"), formats.reading_minutes("summary").alias("minutes"))


def extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", formats.extractive_summary("text", 320).alias("summary"))


def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "story").select("id", formats.relative_time(F.unix_millis("fetched_at"), NOW_MS).alias("when"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.format_count(F.floor("o_totalprice").cast("bigint")).alias("price"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of the events decoded; what is no JSON is null."""
    props = F.from_json("props", "map<string,bigint>")
    return table(spark, sf_dir, "events").select("event_id", F.element_at(props, "k").alias("k"))


def category_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma lists of the registry as rows."""
    return table(spark, sf_dir, "news_source").select("id", F.explode(F.split("categories", ",")).alias("c")).select("id", F.lower(F.trim("c")).alias("category")).where("category <> ''").distinct()


def image_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_feed_item").select("item_id", urls.image_url("image_url").alias("image"))
