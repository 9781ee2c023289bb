"""Every query of the core library, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.operators import editorial, pipeline, serving, similarity, textual, timestamps
from tidewire.plans.editorial_sql import EDITORIAL_SQL
from tidewire.plans.serving_sql import SQL as SERVING_SQL
from tidewire.plans.text_sql import SQL as TEXT_SQL
from tidewire.sources import feeds
from tidewire.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {name: getattr(serving, name) for name in SERVING_SQL}
    found |= {name: getattr(similarity, f"q_{name}") for name in ("find_duplicates", "idf_weights", "cluster_edges", "cluster_assign", "format_flags", "pair_evaluation", "cluster_evaluation")}
    found |= {name: getattr(textual, name) for name in ("html_texts", "normalized_links", "story_fingerprints", "simhashes", "headline_tokens", "slugs", "truncated", "extractive", "relative_times", "counts", "event_props", "category_lists", "image_addresses")}
    found |= {name: getattr(editorial, name) for name in ("classified_stories", "scored_stories", "rescored", "grounding")}
    found |= {name: getattr(pipeline, name) for name in ("normalized_items", "item_outcomes", "ingested_stories", "run_ledger")}
    found |= {"feed_round_trip": feeds.feed_round_trip}
    found |= {name: getattr(ingest, name) for name in ("stream_counts", "stream_first_events", "stream_first_items")}
    return found | {"p5_found": timestamps.p5_found, "p5_formats": timestamps.p5_formats}


def oracle_sql() -> dict[str, str]:
    return SERVING_SQL | TEXT_SQL | EDITORIAL_SQL | feeds.FEED_SQL | ingest.stream_sql(TEXT_SQL["normalized_links"])
