"""Streams: micro-batches that share the batch operators. What they hold on to lives in written tables, not in a state store; no
watermark is set, so late rows are never dropped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.urls import normalize_url
from tidewire.session import shared_dir, step, written


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/{name}.parquet*")


def _run(stream: DataFrame, each, home: str, mode: str = "append") -> None:
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type: every micro-batch writes its own counts, whose sums are the result. No state is held and no
    watermark drops late rows; a batch that is run again after a failure replaces its counts."""
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    events = _source(spark, sf_dir, "events").select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day"), "event_type")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{home}/out/batch_no={batch_id}")

    _run(events, each, home)
    return spark.read.schema("day string, event_type string, n bigint, batch_no bigint").parquet(f"{home}/out").groupBy("day", "event_type").agg(F.sum("n").alias("n"))


#: Folders over which a stream's key history is spread; a batch reads those that its keys fall into.
BUCKETS = 64


def first_seen_stream(stream: DataFrame, keys: list[str], order: list[str], home: str) -> DataFrame:
    """Rows whose key no earlier batch and no earlier row of their batch had. The history of keys is a written table in buckets,
    of which each batch is held against those its keys fall into; a batch that is run again after a failure replaces its rows."""
    spark = stream.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        first = batch.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in batch.columns if c not in order])).alias("r")).select("r.*").select(*batch.columns)
        first = written(first.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")), "first")
        if batch_id > 0:
            asked = [r.bucket for r in first.select("bucket").distinct().collect()]  # at most BUCKETS numbers
            seen = spark.read.parquet(f"{home}/out").where((F.col("batch_no") < batch_id) & F.col("bucket").isin(asked)).select(*[F.col(k).alias(f"_seen_{k}") for k in keys])
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_seen_{k}"))
            first = first.join(seen, same, "left_anti")
        first.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{home}/out/batch_no={batch_id}")

    _run(stream, each, home)
    return spark.read.parquet(f"{home}/out").drop("bucket", "batch_no")


def stream_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type."""
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    events = _source(spark, sf_dir, "events").select("user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id")
    return first_seen_stream(events, ["user_id", "event_type"], ["ms", "event_id"], home)


def stream_first_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first feed item of each canonical address (a second one is a duplicate, whatever its source and age)."""
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    items = step(_source(spark, sf_dir, "raw_feed_item").select("item_id", "link", F.unix_millis("fetched_at").alias("ms")), url=normalize_url("link"))
    return first_seen_stream(items.select("url", "ms", "item_id").where("url <> ''"), ["url"], ["ms", "item_id"], home)


def stream_sql(normalized_links: str) -> dict[str, str]:
    return {
        "stream_counts": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2",
        "stream_first_events": "select user_id, event_type, min((epoch_us(ts) // 1000, event_id))[1] as ms, min((epoch_us(ts) // 1000, event_id))[2] as event_id from events group by 1, 2",
        "stream_first_items": f"select url, epoch_ms(fetched_at) as ms, item_id from ({normalized_links}) join raw_feed_item using (item_id) where url <> '' qualify row_number() over (partition by url order by fetched_at, item_id) = 1",
    }
