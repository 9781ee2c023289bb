"""Short forms of texts, numbers and times as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import c, fold_accents, let, single_line, trim_ws


def truncate(x: Column | str, n: int) -> Column:
    """At most n signs, cut at the last blank of the second half if there is one, without trailing punctuation, with an ellipsis."""

    def cut(s: Column) -> Column:
        head = F.substring(s, 1, n)
        blank = F.length(head) - F.locate(" ", F.reverse(head))  # place of the last blank from 0
        kept = F.when((F.locate(" ", F.reverse(head)) > 0) & (blank > n * 0.5), F.substring(head, F.lit(1), blank)).otherwise(head)
        return F.when(F.length(s) <= n, s).otherwise(F.concat(F.regexp_replace(kept, r"[\s.,;:!?–—-]+\z", ""), F.lit("…")))

    return let(trim_ws(F.coalesce(c(x), F.lit(""))), cut)


def extractive_summary(x: Column | str, n: int = 320) -> Column:
    """Whole sentences from the start until one does not fit; the truncated text where they would be too short."""
    return let(single_line(x), lambda s: _summary(s, n))


def _summary(s: Column, n: int) -> Column:
    found = F.regexp_extract_all(s, F.lit(r"[^.!?]+[.!?]+(?:\s|\z)"), F.lit(0))
    joined = lambda a, x: F.trim(F.concat(a["t"], F.lit(" "), F.trim(x)))
    fold = F.aggregate(
        found,
        F.struct(F.lit("").alias("t"), F.lit(False).alias("full")),
        lambda a, x: F.struct(
            F.when(a["full"] | (F.length(joined(a, x)) > n), a["t"]).otherwise(joined(a, x)).alias("t"), (a["full"] | (F.length(joined(a, x)) > n)).alias("full")
        ),
    )
    return let(fold["t"], lambda t: F.when(F.length(s) <= n, s).when(F.length(t) >= min(80, 0.35 * n), t).otherwise(truncate(s, n)))


def slugify(x: Column | str, n: int = 80) -> Column:
    """Lower-case ASCII words joined by dashes, cut at the last dash of the last two fifths if too long."""
    s = F.regexp_replace(F.lower(fold_accents(single_line(x))), "['’]", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")

    def cut(s: Column) -> Column:
        head = F.substring(s, 1, n)
        dash = F.length(head) - F.locate("-", F.reverse(head))
        kept = F.when((F.locate("-", F.reverse(head)) > 0) & (dash > n * 0.6), F.substring(head, F.lit(1), dash)).otherwise(head)
        return F.when(F.length(s) <= n, s).otherwise(F.regexp_replace(kept, r"-+\z", ""))

    return let(s, cut)


def unique_slug(x: Column | str, seed: Column | str) -> Column:
    return F.concat_ws("-", F.coalesce(F.nullif(slugify(x, 72), F.lit("")), F.lit("story")), F.substring(F.sha2(c(seed), 256), 1, 6))


def reading_minutes(x: Column | str) -> Column:
    words = F.size(F.filter(F.split(trim_ws(F.coalesce(c(x), F.lit(""))), r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(words / 220 + 0.5).cast("int"))


def relative_time(ms: Column | str, now_ms: Column | int) -> Column:
    """'just now', or the largest whole unit since then ('yesterday', '3 hours ago')."""
    diff = (c(ms) - (F.lit(now_ms) if isinstance(now_ms, int) else now_ms)).cast("double")
    out = F.lit("just now")
    units = [("minute", 60_000), ("hour", 3_600_000), ("day", 86_400_000), ("week", 604_800_000), ("month", 2_592_000_000), ("year", 31_536_000_000)]
    special = {"day": "yesterday", "week": "last week", "month": "last month", "year": "last year"}
    for name, size in units:
        k = -F.floor(diff / size + 0.5)  # rounds half towards the later time
        one = F.lit(special.get(name, f"1 {name} ago"))
        text = F.when(k == 1, one).otherwise(F.concat(k.cast("string"), F.lit(f" {name}s ago")))
        out = F.when(diff <= -size, text).otherwise(out)
    return F.when(c(ms).isNotNull(), out)


def format_count(n: Column | str) -> Column:
    """1234 as 1.2k, 12345 as 12k, 1234567 as 1.2m."""
    x = c(n).cast("double")
    return (
        F.when(x < 1000, c(n).cast("string")).when(x < 10_000, F.format_string("%.1fk", x / 1000))
        .when(x < 1_000_000, F.format_string("%.0fk", x / 1000)).otherwise(F.format_string("%.1fm", x / 1_000_000))
    )


def local_date(ts: Column | str, zone: str = "Africa/Lagos") -> Column:
    return F.date_format(F.from_utc_timestamp(c(ts), zone), "d MMMM yyyy")


def json_strings(x: Column | str) -> Column:
    """The non-blank strings of a JSON list; an empty list for what is none."""
    return F.coalesce(F.filter(F.from_json(c(x), "array<string>"), lambda v: trim_ws(v) != ""), F.array().cast("array<string>"))
