"""Mixing sources to target weights (problem 8).

Weighted fair queueing: each source's documents are shuffled by a hash, and a document's virtual finish time is the
source's tokens up to and with it, divided by the source's target share; a second use of the source follows after all of its
first, and so on up to its cap. Sorting all uses by virtual time makes every beginning of the order hold the sources in
their shares; the order is cut where the total budget is reached. A source that runs out leaves its place to the others.

Running totals, both per source and over the whole order, come from range-sorted partitions and their offsets, never from
one task per source. Uses that cannot lie within the budget are not sorted. Where the fluid model (all sources drained at
their shares, in closed form from the sources' totals) stands at some virtual time, the uses finished by then hold all its
tokens but, of each source, less than one document, the one half served. So by the time at which the model has given out
the budget and each source's largest document besides, the finished uses fill the budget, and all later ones lie beyond it.

Defined results: documents without tokens, and sources with a null or non-positive share or cap, are not used; a null
total_ratio counts as 1; a document named twice in the table counts as two documents; a source named twice in a mix counts
with its shares summed and its larger cap. Shares need not sum to 1: they are weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.encode import with_size
from tidewire.session import prefix_sum, table, written

SEED = 17


def queued(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, n_tokens) with cum, the source's tokens up to and with the document in shuffled order."""
    used = docs.where((F.col("n_tokens") > 0) & F.col("source").isNotNull())
    # copies of one row are told apart by their number
    used = used.groupBy("doc_id", "source", "n_tokens").agg(F.count(F.lit(1)).alias("copies")).select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    shuffled = used.withColumn("place", F.xxhash64("doc_id", "copy", F.lit(SEED)))
    return prefix_sum(shuffled, ["source"], ["place", "doc_id", "copy", "n_tokens"], "n_tokens", "cum", "queue")


def horizon(targets: DataFrame, totals: DataFrame) -> DataFrame:
    """Per mix and source: share, cap, total (tokens of the source), and per mix budget and until, the virtual time at which
    the fluid model has given out the budget and the largest document of each source (null if it never does)."""
    corpus = totals.agg(F.sum("total").alias("corpus"))
    clean = (
        targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("mix_name").isNotNull())
        .groupBy("mix_name", "source")
        .agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"), F.max(F.coalesce("total_ratio", F.lit(1.0))).alias("ratio"))
    )
    joined = clean.join(totals, "source").where("total > 0").join(F.broadcast(corpus))  # one row
    mix = Window.partitionBy("mix_name")
    drained = joined.withColumn("dry_at", F.col("cap") * F.col("total") / F.col("share")).withColumn("budget", F.floor(F.max("ratio").over(mix) * F.col("corpus")))
    # the budget is reached in the piece between two sources' running dry: what is dry counts whole, the rest by its share
    order = mix.orderBy("dry_at", "source")
    dry = F.coalesce(F.sum(F.col("cap") * F.col("total")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flowing = F.sum("share").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = (F.col("budget") + F.sum("largest").over(whole) - dry) / flowing
    found = drained.withColumn("end", end).withColumn("until", F.first(F.when(F.col("end") <= F.col("dry_at"), F.col("end")), ignorenulls=True).over(whole))
    return found.select("mix_name", "source", "share", "cap", "total", "budget", "until")


def mixed(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Uses of documents within the budgets: mix_name, source, doc_id, n_tokens, use (from 0), finish."""
    queue = written(queued(docs), "queued")
    totals = docs.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("total"), F.max("n_tokens").alias("largest"))
    plan = horizon(targets, totals)
    # a document's uses up to the bound, one too many at most: a great cap makes no rows that are then left out
    last = F.floor((F.col("until") * (1 + 1e-9) * F.col("share") - F.col("cum")) / F.col("total")) + 1
    due = queue.join(plan, "source").withColumn("last", F.least(F.col("cap").cast("bigint") - 1, F.coalesce(last, F.col("cap").cast("bigint")))).where("last >= 0")
    uses = due.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("use"))
    finish = (F.col("use") * F.col("total") + F.col("cum")) / F.col("share")
    uses = uses.withColumn("finish", finish).where(F.col("until").isNull() | (finish <= F.col("until") * (1 + 1e-9)))
    order = ["finish", "source", "place", "doc_id", "copy", "use"]
    ranked = prefix_sum(uses.select("mix_name", *order, "n_tokens", "budget"), ["mix_name"], order, "n_tokens", "given", "uses")
    return ranked.where(F.col("given") <= F.col("budget")).select("mix_name", "source", "doc_id", "n_tokens", "use", "finish")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = written(with_size(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text"), "sizes")
    targets = table(spark, sf_dir, "mix_target")
    return docs, targets, mixed(docs, targets)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents of each mix and how often each is used."""
    return _mix(spark, sf_dir)[2].groupBy("mix_name", "source", "doc_id").agg(F.count(F.lit(1)).alias("n_uses"), F.max("n_tokens").alias("n_tokens"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each mix and source: the target share, documents and uses chosen, tokens, and the share really reached."""
    _, targets, uses = _mix(spark, sf_dir)
    got = uses.groupBy("mix_name", "source").agg(F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_uses"), F.sum("n_tokens").alias("n_tokens"))
    want = targets.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    all_ = want.join(got, ["mix_name", "source"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_docs", "n_uses", "n_tokens")})
    return all_.withColumn("actual_share", F.coalesce(F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(Window.partitionBy("mix_name"))), F.lit(0.0)))
