"""Best representative of each duplicate group (problem 6).

The chosen fields of each group's rows are unpivoted to long rows. Per normalised value the votes of its rows are summed
(trust of the source times decay with age, sums over
long spans of time kept to the power of two, so that no age is clamped), the value's own best row is found, and one value per field wins by min_by; the
winners are pivoted back to one record per group. All three steps are hash or sort aggregations with map-side combine, so
a group that holds a third of all rows is no task of its own, and only hashes of values travel until the winners are known.

Two policies: "votes" (the value with most votes, ties by its best row) and "best_row" (the value of the best row: lowest
trust tier, then highest importance, then latest, then smallest id; a null tier or importance comes last).

Defined results: null, blank and no-value texts never win; a field without any value is null in the record and absent
from p6_found; rows without a group are ignored; repeated rows vote as often as they stand there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import plain_ws, says_nothing
from tidewire.session import table

FIELDS = ("author", "dek", "excerpt", "image_url")
#: Votes halve with every so many hours of age.
HALF_LIFE_HOURS = 72.0
#: Half-lives that one sum of votes spans; longer spans are put together in logarithms.
ERA = 512
_LEAST, _MOST = -(2**31), 2**31 - 1


def rank_key() -> Column:
    """Less is better: trust tier, importance, time, then the smallest id."""
    late = F.coalesce(-F.unix_micros("fetched_at"), F.lit(2**63 - 1))
    return F.struct(F.coalesce("trust_tier", F.lit(_MOST)).alias("a"), (-F.coalesce("importance", F.lit(_LEAST)).cast("bigint")).alias("b"), late.alias("c"), F.col("id").alias("d"))


def long_rows(rows: DataFrame, group: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """rows unpivoted: grp, field_name, value (hash of the normalised value; null where there is none), key (rank), era and vote."""
    age = F.unix_micros("fetched_at") / (3.6e9 * HALF_LIFE_HOURS)
    era = F.floor(age / ERA)
    vote = F.coalesce(F.pow(F.lit(2.0), age - era * ERA), F.lit(0.0)) / F.coalesce(F.greatest("trust_tier", F.lit(1)), F.lit(6))
    normal = lambda n: F.lower(F.trim(F.regexp_replace(plain_ws(F.col(n)), r"\s+", " ")))
    values = F.array(*[F.struct(F.lit(n).alias("field_name"), F.when(~says_nothing(n), F.xxhash64(normal(n))).alias("value")) for n in fields])
    return (
        rows.where(F.col(group).isNotNull())
        .select(F.col(group).alias("grp"), rank_key().alias("key"), era.alias("era"), vote.alias("vote"), F.explode(values).alias("x"))
        .select("grp", "x.field_name", "x.value", "key", "era", "vote")
    )


def winners(rows: DataFrame, group: str, fields: tuple[str, ...] = FIELDS, policy: str = "votes", at_least: int = 1) -> DataFrame:
    """The row that gives each field of each group of at least so many rows: grp, field_name, id, n_rows, log_votes (to base 2,
    null where no row has a time)."""
    if policy not in ("votes", "best_row"):
        raise ValueError("policy is 'votes' or 'best_row'")
    long, usable = long_rows(rows, group, fields), F.col("value").isNotNull()
    if policy == "best_row":
        by_value = long.groupBy("grp", "field_name", "value").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("best")).withColumn("log_votes", F.lit(None).cast("double"))
        order = F.struct("best")
    else:
        by_era = long.groupBy("grp", "field_name", "value", "era").agg(F.count(F.lit(1)).alias("n"), F.sum("vote").alias("votes"), F.min("key").alias("best"))
        by_value = by_era.groupBy("grp", "field_name", "value").agg(F.sum("n").alias("n"), F.min("best").alias("best"), F.max("era").alias("last"), F.collect_list(F.struct("era", "votes")).alias("eras"))
        total = F.aggregate(F.array_sort("eras"), F.lit(0.0), lambda s, x: s + F.coalesce(x["votes"] * F.pow(F.lit(2.0), (x["era"] - F.col("last")) * ERA), F.lit(0.0)))
        # the same votes summed in another order are the same votes
        by_value = by_value.withColumn("log_votes", F.round(F.col("last") * ERA + F.log2(total), 6))
        order = F.struct((-F.coalesce("log_votes", F.lit(-1e18))).alias("v"), "best")
    by_field = by_value.groupBy("grp", "field_name").agg(F.sum("n").alias("n_rows"), F.min_by(F.struct("best.d", "log_votes"), F.when(usable, order)).alias("won"))
    return by_field.where((F.col("n_rows") >= at_least) & F.col("won").isNotNull()).select("grp", "field_name", F.col("won.d").alias("id"), "n_rows", "won.log_votes")


def records(rows: DataFrame, group: str, fields: tuple[str, ...] = FIELDS, policy: str = "votes") -> DataFrame:
    """One surviving record per group: the winners' values, pivoted back."""
    won = winners(rows, group, fields, policy).select("grp", "field_name", F.col("id").alias("row_id"))
    # a repeated id keeps one row: the smallest values
    values = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), "id").agg(*[F.min(F.when(~says_nothing(n), F.col(n))).alias(n) for n in fields])
    picked = F.coalesce(*[F.when(F.col("field_name") == n, F.col(n)) for n in fields])
    joined = won.join(values, (F.col("grp") == F.col("g")) & (F.col("row_id") == F.col("id"))).select("grp", "field_name", picked.alias("value"))
    # the pivot, as one aggregation; groups without any value come from the groups' own list
    got = joined.groupBy("grp").agg(*[F.max(F.when(F.col("field_name") == n, F.col("value"))).alias(n) for n in fields])
    groups = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("n_rows"))
    return groups.join(got, "grp", "left").withColumnRenamed("grp", group)


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories = table(spark, sf_dir, "story").select("id", "cluster_id", "source_id", "importance", "fetched_at", *FIELDS)
    tiers = table(spark, sf_dir, "news_source").where(F.col("id").isNotNull()).groupBy(F.col("id").alias("s")).agg(F.min("trust_tier").alias("trust_tier"))
    return stories.join(tiers, F.col("source_id") == F.col("s"), "left").drop("s")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = winners(_stories(spark, sf_dir), "cluster_id", policy="best_row", at_least=2)
    return won.select(F.col("grp").alias("cluster_id"), "field_name", "id")


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(_stories(spark, sf_dir), "cluster_id")
