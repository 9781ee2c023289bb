"""Session helpers: table access, the cluster's shared folder, written intermediate tables."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIRS: list[str] = []
_SHIPPED: set[str] = set()
_WRITTEN: dict[str, list[str]] = {}


def _drop_own_dirs() -> None:
    for path in _OWN_DIRS:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_drop_own_dirs)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where that is unset and the master is local (tests, local runs), an
    own one; on a cluster a folder of the driver would not be seen by the executors, so there it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidewire-')}"
        _OWN_DIRS.append(base[len("file://"):])
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage is cut by files that outlive executors. With by, a
    value of that column has files of its own, so what is read of one value does not grow with the others."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = df.hint("rebalance", by).write.partitionBy(by) if by else df.write
    out.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def part(df: DataFrame, by: str, value: int) -> DataFrame:
    """Of a table just written by a column, the rows of one value. Spark takes the size of a filtered table to be that of the whole
    one; this one has the size of its own files."""
    spark, path = df.sparkSession, f"{df._written_at}/{by}={value}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return df.where(F.col(by) == value)
    return spark.read.schema(df.schema).option("basePath", df._written_at).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Delete the intermediate tables written in this application so far: to be called when the results that read them have been
    taken. Gives their number."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def release(spark: SparkSession) -> None:
    """Let go of what jobs that are over have left in the driver (relations and task binaries that were broadcast) and on disk
    (shuffle files). Spark drops them when the driver's JVM happens to collect its garbage; until then its heap grows to the limit."""
    gc.collect()
    spark._jvm.System.gc()


def step(df: DataFrame, **cols: Column) -> DataFrame:
    """df with more columns that later expressions refer to. A generator of one row keeps the optimizer from inlining them
    into every use, which would compute them again and again and outgrow what can be compiled."""
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in cols.items()]))))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers on other machines."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = tempfile.mkdtemp(prefix="tidewire-zip-")
    _OWN_DIRS.append(out)
    target = os.path.join(out, "tidewire.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def prefix_sum(df: DataFrame, groups: list[str], order: list[str], value: str, out: str, name: str) -> DataFrame:
    """Running total of value per group in the given order, without a task per group.

    The rows are range-sorted by (groups, order) into many partitions and written; each partition's totals (one row per
    partition and group in it) give the offset at which the next partition of the group goes on. A group that holds a
    third of all rows is so spread over a third of the partitions. order must be unique within a group.
    """
    keys = [*groups, *order]
    cut = written(
        df.repartitionByRange(*[F.col(c) for c in keys]).sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()),
        name,
    )
    totals = cut.groupBy("_pid", *groups).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *groups, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    local = Window.partitionBy("_pid", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("_local", F.sum(value).over(local))
        .join(offsets, ["_pid", *groups])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_pid", "_local", "_offset")
    )
