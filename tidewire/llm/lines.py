"""Lines repeated across one source's documents (problem 3).

Each source's lines are held as compressed bitmaps of the documents they stand in. Documents are numbered source by source
within each partition, so those of one source follow one another, and a bitmap is kept in containers of 2**15 numbers:
a sorted array where it holds few documents, runs (first and last) where these take less, and a plain bitmap of 4 kB
otherwise. The bitmaps of a line's variants (case, tags, digits, blanks) are united container by container, the exact
cardinality is the sum of the containers' counts, and each document's lines are looked up in the bitmaps of the lines at or
over the threshold. A container holds no more than 2**15 documents, so a line in a third of all documents is many containers,
built, united and looked up apart.

Lines are told apart by 64-bit hashes of their normal form within a table and source.

Defined results: null texts and null sources have no repeated lines; blank lines are never repeated lines; a line that
stands twice in a document counts once for it, and both places are found; repeated rows of a document id are told apart
and each counts as a document; a text without its repeated lines is told by id, source and text, so rows that share an
id lose only their own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import with_line_key
from tidewire.session import table, union_all, written

MIN_DOCUMENTS = 10
#: Most documents (or twice the runs) of a container that is no plain bitmap; documents a container can number (fixed by the bitmap functions).
SPARSE, WIDTH = 1024, 1 << 15


def line_table(docs: DataFrame) -> DataFrame:
    """docs (tbl, source_id, rec_id, text) -> the written table of non-blank lines: tbl, source_id, rec_id, text_hash, block and
    low (of the document's number), no, h (hash of the normal form), v (hash of the line as it is)."""
    used = docs.where(F.col("text").isNotNull() & F.col("source_id").isNotNull()).select("tbl", "source_id", "rec_id", "text")
    # numbers follow the order of the rows: the local sort makes each source's documents neighbours
    numbered = used.sortWithinPartitions("tbl", "source_id").select("*", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("ord"))
    rows = numbered.select("tbl", "source_id", "rec_id", "text_hash", "ord", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    keyed = with_line_key(rows, "line", "k").where(F.col("k") != "")
    return written(
        keyed.select(
            "tbl", "source_id", "rec_id", "text_hash", F.shiftright("ord", 15).alias("block"), (F.col("ord") % WIDTH).cast("smallint").alias("low"), (F.col("no") + 1).alias("no"),
            F.xxhash64("k").alias("h"), F.xxhash64("line").alias("v"),
        ),
        "lines",
    )


def _runs(low: Column) -> Column:
    """First and last numbers of the runs of a sorted array."""
    firsts = F.filter(low, lambda x, i: (i == 0) | (F.get(low, i - 1) != x - 1))
    lasts = F.filter(low, lambda x, i: (i == F.size(low) - 1) | (F.get(low, i + 1) != x + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def line_bitmaps(lines: DataFrame) -> DataFrame:
    """Bitmap containers of each line, its variants united: tbl, source_id, h, block, n_docs, and one of few (array of numbers),
    runs (array of first and last) and bits (plain bitmap)."""
    key = ["tbl", "source_id", "h", "block"]
    variants = lines.groupBy(*key, "v").agg(F.collect_set("low").alias("low"))
    united = variants.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("low")))).alias("low"))
    sized = united.withColumn("n_docs", F.size("low")).withColumn("runs", F.when(F.col("n_docs") > 4, _runs(F.col("low"))))
    short = (2 * F.size("runs") < F.col("n_docs")) & (2 * F.size("runs") <= SPARSE)
    sized = written(sized.withColumn("kind", F.when(short, "runs").when(F.col("n_docs") <= SPARSE, "few").otherwise("bits")), "containers")
    pos = F.call_function("bitmap_bit_position", F.col("x").cast("bigint") + 1)  # its numbers begin at 1
    dense = sized.where("kind = 'bits'").select(*key, F.explode("low").alias("x")).groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("n_docs"), F.call_function("bitmap_construct_agg", pos).alias("bits"))
    sparse = sized.where("kind <> 'bits'").select(*key, "n_docs", F.when(F.col("kind") == "few", F.col("low")).alias("few"), F.when(F.col("kind") == "runs", F.col("runs")).alias("runs"))
    return sparse.unionByName(dense, allowMissingColumns=True)


def holds(low: Column) -> Column:
    """Whether a container (columns few, runs, bits) holds a number."""
    byte = F.conv(F.hex(F.substring("bits", (low / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    plain = F.shiftright(byte, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1), low % 8)) != 0
    return F.coalesce(F.when(F.col("few").isNotNull(), F.array_contains("few", low)).when(F.col("runs").isNotNull(), F.exists("runs", lambda r: low.between(r["first"], r["last"]))).otherwise(plain), F.lit(False))


def repeated_lines(bitmaps: DataFrame, at_least: int = MIN_DOCUMENTS) -> DataFrame:
    """Lines in at least so many documents of their source, with the exact count: tbl, source_id, h, n_docs, n_containers."""
    found = bitmaps.groupBy("tbl", "source_id", "h").agg(F.sum("n_docs").alias("n_docs"), F.count(F.lit(1)).alias("n_containers"))
    return found.where(F.col("n_docs") >= at_least)


def repeated_places(docs: DataFrame, at_least: int = MIN_DOCUMENTS) -> DataFrame:
    """Where repeated lines stand, by looking every line up in their bitmaps: tbl, source_id, rec_id, text_hash, no."""
    lines = line_table(docs)
    bitmaps = line_bitmaps(lines)
    common = bitmaps.join(repeated_lines(bitmaps, at_least).select("tbl", "source_id", "h"), ["tbl", "source_id", "h"], "left_semi").drop("n_docs")
    met = lines.join(common, ["tbl", "source_id", "h", "block"])
    return met.where(holds(F.col("low").cast("int"))).select("tbl", "source_id", "rec_id", "text_hash", "no")


def cleaned(docs: DataFrame, at_least: int = MIN_DOCUMENTS) -> DataFrame:
    """The rows of docs that lose lines, without them: tbl, source_id, rec_id, n_removed, text."""
    nos = repeated_places(docs, at_least).groupBy("tbl", "source_id", F.col("rec_id").alias("r"), "text_hash").agg(F.collect_set("no").alias("nos"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("nos"), i + 1))
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    same = (hashed["tbl"] == nos["tbl"]) & (hashed["source_id"] == nos["source_id"]) & F.col("rec_id").eqNullSafe(F.col("r")) & (hashed["text_hash"] == nos["text_hash"])
    return hashed.join(nos, same).select(hashed["tbl"], hashed["source_id"], "rec_id", F.size("nos").alias("n_removed"), F.array_join(kept, "\n").alias("text"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all([
        table(spark, sf_dir, name).select(F.lit(name).alias("tbl"), "source_id", F.col(key).alias("rec_id"), F.col(text).alias("text"))
        for name, key, text in (("raw_feed_item", "item_id", "content"), ("story", "id", "summary"))
    ])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = repeated_places(_texts(spark, sf_dir))
    return places.select("tbl", "rec_id", F.col("no").alias("line_no")).distinct()


def p3_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that lose lines, without them: tbl, rec_id, n_removed, text."""
    return cleaned(_texts(spark, sf_dir)).drop("source_id")


def p3_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of each table and source: how many, and in how many documents the commonest stands."""
    common = repeated_lines(line_bitmaps(line_table(_texts(spark, sf_dir))))
    return common.groupBy("tbl", "source_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("n_docs").alias("most_docs"))
