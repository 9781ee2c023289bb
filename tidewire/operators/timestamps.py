"""Mixed time texts to one UTC instant (problem 5).

An ordered cascade of anchored patterns rewrites each text to the fields of a wall time and a zone; the first pattern that
matches decides, and its fields are read strictly (30 February is no date). A text without a zone is read in the default
zone of its source, looked up by key. Everything is a Column expression.

Policies for wall times of zone changes: ambiguous ("earlier" or "later" of the two instants) and nonexistent
("shift": moved forward by the gap, or "null").

Defined results: a null, blank or unknown text, a text whose fields are no date, and a zoneless text whose source has no
known zone give null. Repeated rows give repeated rows; an empty table an empty one. Other columns are kept, whatever
their names (helper columns begin with _tw_).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import plain_ws
from tidewire.session import step, table, union_all

# Month names, and minutes east of UTC of the zone names of mail and feed dates.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "aout": 8,
    "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12,
}
ZONES = {
    "z": 0, "gmt": 0, "utc": 0, "ut": 0, "wet": 0, "wat": 60, "cet": 60, "bst": 60, "west": 60, "cat": 120, "sast": 120, "cest": 120, "eet": 120,
    "eat": 180, "eest": 180, "msk": 180, "ist": 330, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\z"

_DAY = r"(?:(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)[a-z]*,? +)?"
_NAME = r"([\p{L}]+)\.?"
_ZONE = r"(z|[a-z]{2,5}|[+-]\d{2}:?\d{2}|[+-]\d{2})"
#: (anchored pattern, rewritten form "year|month|day|hour|minute|second|fraction|half of day|zone|region"), tried in this order.
PATTERNS = [
    (r"^(\d{4})-(\d{2})-(\d{2})\z", "$1|$2|$3|0|0|0||||"),
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[t ](\d{{2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,9}}))?)? ?{_ZONE}?(?:\[([a-z]+(?:[/_+-][a-z0-9_+-]+)*)\])?\z", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(\d{{2}})?{_ZONE}?\z", "$1|$2|$3|$4|$5|$6|||$7|"),
    (rf"^{_DAY}(\d{{1,2}}) {_NAME} (\d{{4}}|\d{{2}}) (\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?(?: {_ZONE})?\z", "$3|$2|$1|$4|$5|$6|||$7|"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?:,? (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ?([ap])\.?m\.?)?)?\z", "$3|/$1|$2|$4|$5|$6||$7||"),
    (rf"^{_DAY}{_NAME} (\d{{1,2}}),? (\d{{4}}),? (?:at )?(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?(?: ?([ap])\.?m\.?)?(?: {_ZONE})?\z", "$3|$1|$2|$4|$5|$6||$7|$8|"),
    (rf"^(\d{{1,2}})(?:er)? {_NAME} (\d{{4}})(?:,? [àa])? (\d{{1,2}})[h:](\d{{2}})\z", "$3|$2|$1|$4|$5|0||||"),
]


def _lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def known_zone(tz: Column) -> Column:
    """tz where the JVM knows it as a zone, else null."""
    return F.when(F.try_to_timestamp(F.concat(F.lit("2001-01-01 00:00:00 "), tz), F.lit("yyyy-MM-dd HH:mm:ss VV")).isNotNull(), tz)


def _fields(s: Column) -> Column:
    shape = F.lit(None).cast("string")
    for pattern, to in reversed(PATTERNS):
        shape = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, to)).otherwise(shape)
    return F.split(shape, r"\|", -1)


def _region(raw: Column) -> Column:
    """The zone id in square brackets at the end of a text, where the JVM knows it."""
    return F.when(F.contains(raw, F.lit("[")), known_zone(F.nullif(F.regexp_extract(raw, r"\[([A-Za-z0-9_/+-]+)\]\s*\z", 1), F.lit(""))))


def _with_instant(df: DataFrame, raw: Column, out: str, ambiguous: str, nonexistent: str) -> DataFrame:
    """df, which has _tw_tz and _tw_us, with the column out. Each step is a column of its own, so that nothing is computed twice."""
    g = lambda i: F.nullif(F.get("_tw_f", F.lit(i)), F.lit(""))
    num = lambda i: g(i).try_cast("int")
    us, slash = F.coalesce("_tw_us", F.lit(False)), g(1).startswith("/")
    first = F.substring(g(1), 2, 2).try_cast("int")
    hour0, half = F.coalesce(num(3), F.lit(0)), g(7)
    sign = F.when(g(8).startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(g(8), "[+:-]", "")
    minutes = F.when(g(8).rlike("^[+-]"), sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)))).otherwise(_lookup(ZONES, g(8)))
    second = F.coalesce(num(5), F.lit(0))
    args = ("_tw_y", "_tw_m", "_tw_d", "_tw_h", "_tw_mi", F.when(F.col("_tw_s") < 60, F.col("_tw_s")).cast("decimal(8,6)"))
    at = lambda t: F.unix_millis(F.from_utc_timestamp(t, F.col("_tw_zone")))
    df = step(df, _tw_t=F.lower(F.trim(F.regexp_replace(plain_ws(raw), r"\s+", " "))))
    df = step(df, _tw_f=_fields(F.col("_tw_t")), _tw_r=_region(raw))
    df = step(
        df,
        _tw_y=F.when(F.length(g(0)) == 2, num(0) + 2000).otherwise(num(0)),
        _tw_m=F.when(slash, F.when(us, first).otherwise(num(2))).when(g(1).rlike("^[0-9]"), num(1)).otherwise(_lookup(MONTHS, g(1))),
        _tw_d=F.when(slash & ~us, first).otherwise(num(2)),
        _tw_h=F.when(half.isNull(), hour0).when(hour0.between(1, 12), hour0 % 12 + F.when(half == "p", 12).otherwise(0)),
        _tw_mi=F.coalesce(num(4), F.lit(0)),
        _tw_s=second,
        _tw_ms=F.coalesce(F.substring(F.rpad(g(6), 9, "0"), 1, 3).try_cast("int"), F.lit(0)),
        _tw_z=g(8),
        _tw_off=minutes,
        _tw_zone=F.coalesce(F.col("_tw_r"), F.col("_tw_tz")),
    )
    df = step(df, _tw_utc=F.try_make_timestamp(*[F.col(x) if isinstance(x, str) else x for x in args], F.lit("UTC")))
    # a wall time in its zone: java.time takes the earlier offset of an overlap and moves a time in a gap forward by the gap
    df = step(df, _tw_l=F.when(F.col("_tw_z").isNull() & F.col("_tw_zone").isNotNull(), F.to_utc_timestamp("_tw_utc", F.col("_tw_zone"))))
    local = F.col("_tw_l")
    if ambiguous == "later":
        for minutes_on in (30, 60):
            moved = F.timestamp_millis(F.unix_millis("_tw_l") + minutes_on * 60_000)
            local = F.when((at(moved) == F.unix_millis("_tw_utc")) & (at(F.col("_tw_l")) == F.unix_millis("_tw_utc")), moved).otherwise(local)
    if nonexistent == "null":
        local = F.when(at(F.col("_tw_l")) == F.unix_millis("_tw_utc"), local)
    text = F.col("_tw_t")
    value = F.coalesce(F.unix_millis("_tw_utc") - F.when(F.abs("_tw_off") <= 18 * 60, F.col("_tw_off")) * 60_000, F.unix_millis(local)) + F.col("_tw_ms")
    value = F.when(F.col("_tw_f").isNotNull(), value).when(text.rlike(r"^\d{10}\z"), text.try_cast("bigint") * 1000).when(text.rlike(r"^\d{13}\z"), text.try_cast("bigint"))
    return df.withColumn(out, value).drop(*[x for x in ("t", "f", "r", "y", "m", "d", "h", "mi", "s", "ms", "z", "off", "zone", "utc", "l", "tz", "us") for x in ["_tw_" + x]])


def normalise_times(
    rows: DataFrame, raw: str, source: str, sources: DataFrame, source_key: str = "id", out: str = "utc_ms", ambiguous: str = "earlier", nonexistent: str = "shift"
) -> DataFrame:
    """rows with the column out (bigint, milliseconds UTC). sources gives tz and country by source_key; one row per key is
    used (the smallest tz where a key repeats), and rows whose source is unknown keep their zoned texts' instants."""
    if ambiguous not in ("earlier", "later") or nonexistent not in ("shift", "null"):
        raise ValueError("ambiguous is 'earlier' or 'later', nonexistent 'shift' or 'null'")
    zones = (
        sources.where(F.col(source_key).isNotNull())
        .groupBy(F.col(source_key).alias("_tw_key"))
        .agg(F.min(F.struct("tz", "country")).alias("_tw_zone"))
        .select("_tw_key", known_zone(F.col("_tw_zone.tz")).alias("_tw_tz"), (F.upper(F.trim(F.col("_tw_zone.country"))) == "US").alias("_tw_us"))
    )
    joined = rows.join(zones, rows[source] == zones["_tw_key"], "left").drop("_tw_key")
    return _with_instant(joined, F.col(raw), out, ambiguous, nonexistent)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both tables whose published_at names an instant and is not canonical, with the instant."""
    sources = table(spark, sf_dir, "news_source")
    frames = [
        table(spark, sf_dir, name).select(F.lit(name).alias("tbl"), F.col(key).alias("rec_id"), "source_id", "published_at").where(F.col("published_at").isNotNull() & ~F.col("published_at").rlike(CANONICAL))
        for name, key in (("raw_feed_item", "item_id"), ("story", "id"))
    ]
    # repeated rows go first: the instants are then computed after the exchange, in a stage of their own
    out = normalise_times(union_all(frames).distinct(), "published_at", "source_id", sources)
    return out.where(F.col("utc_ms").isNotNull()).select("tbl", "rec_id", "utc_ms")


def p5_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source writes its times: rows by table, source and shape, and how many of them name an instant."""
    sources = table(spark, sf_dir, "news_source")
    frames = [
        table(spark, sf_dir, name).select(F.lit(name).alias("tbl"), "source_id", "published_at") for name in ("raw_feed_item", "story")
    ]
    shape = F.regexp_replace(F.regexp_replace(F.col("published_at"), r"\d", "9"), r"\p{L}+", "a")
    return (
        normalise_times(union_all(frames), "published_at", "source_id", sources)
        .groupBy("tbl", "source_id", shape.alias("shape"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("utc_ms").alias("n_instants"))
    )
