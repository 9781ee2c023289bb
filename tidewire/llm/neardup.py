"""Near-duplicate records with small edits (problem 4).

Records become bags of words; equal bags are one node. A bag's BagMinHash signature is cut into bands, and bags that agree in
a band are candidates; a candidate pair is linked if the exact multiset overlap (sum of the smaller over sum of the larger
counts) reaches the threshold. Groups are the components of the links.

The signature weighs a word by its rarity, in whole levels: words that stand in over one in RARE bags weigh less the more
common they are, all others the most. Only those common words' weights travel to the tasks, of the COMMON commonest at most.
The weights only choose candidates; README gives the share of true pairs that met in a band, by similarity.

Inside a band bucket not all pairs are compared at once: first every bag with the bucket's smallest, which gathers nearly
all of a big bucket in one component; then only bags of one bucket that are still in different components, in blocks of bounded
size. So a bucket that holds a third of all rows costs about its size where its bags are alike, and no candidate link that
could join two components is left out; a bucket of many unlike components costs the product of their sizes, over many tasks.

That finds the groups; a bag's links are counted when the groups are known. A link lies within a group, so every pair of
bags of a group is checked, whether they met in a band or not: the count depends on the groups alone. A big group is cut
into blocks, and a task takes the pairs of two blocks; the work grows with the square of a group's different bags.

Defined results: null texts count as empty; records without words are linked to nothing; repeated ids are one record for
each different text; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.components import components
from tidewire.session import step, table, written

SIMILARITY = 0.6
#: Bands and places per band; a pair at weighted similarity s is missed with probability (1 - s**ROWS)**BANDS.
BANDS, ROWS = 48, 5
#: Words in more than one in RARE bags weigh less; weights are levels 1..2**DEPTH.
RARE, DEPTH = 1000, 4
#: Most words whose weights travel to the tasks.
COMMON = 50_000
#: Bags in a block of a group whose links are counted or whose pairs are given, or of a part of a bucket that is compared with another.
BLOCK = 1000


def words(text: Column) -> Column:
    """Maximal runs of letters and digits of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def bags(records: DataFrame, text: Column, distinct: bool) -> DataFrame:
    """records (id) with key and bag (the sorted words, joined by blanks: half the bytes of an array). The key is what makes
    two records equal: 56 bits of the bag's hash and, in the last 8, its size up to 255, which tells pairs of too different
    sizes without looking at the bags."""
    found = words(text)
    found = F.array_sort(F.array_distinct(found) if distinct else found)
    # a repeated word counts by its numbered copies: overlap of the numbered words is multiset overlap
    return records.select("id", F.array_join(found, " ").alias("bag")).where("bag <> ''").withColumn("key", _key(F.xxhash64("bag")))


def _key(h: Column) -> Column:
    size = F.least(F.size(F.split("bag", " ")), F.lit(255)).cast("bigint")
    return h.bitwiseAND(F.lit(-256).cast("bigint")).bitwiseOR(size)


def told_apart(members: DataFrame) -> DataFrame:
    """members with other keys for bags that share one by chance, as a second hash tells: it takes 112 equal bits to be taken for
    the same bag."""
    return members.join(clashes(members), F.col("key") == F.col("k"), "left").select("id", "bag", F.when(F.col("k").isNull(), F.col("key")).otherwise(_key(_second())).alias("key"))


def _second() -> Column:
    return F.xxhash64(F.lit("second"), "bag")


def clashes(members: DataFrame) -> DataFrame:
    """Keys (k) that different bags share."""
    return members.groupBy("key").agg(F.min(_second()).alias("low"), F.max(_second()).alias("high")).where("low <> high").select(F.col("key").alias("k"))


def word_levels(bag: DataFrame) -> dict[str, int]:
    """Weight levels of the common words, of the COMMON commonest at most; every other word has the top level."""
    n = max(bag.count(), 1)
    df = bag.select(F.explode(F.array_distinct(F.split("bag", " "))).alias("w")).groupBy("w").count().where(F.col("count") * RARE > n)
    top = 1 << DEPTH
    # the weights choose candidates only, so words beyond the bound may well weigh the most
    common = df.orderBy(F.desc("count"), "w").limit(COMMON).collect()
    return {r.w: max(1, round(top * (math.log(n / r["count"]) / math.log(RARE)) ** 2)) for r in common}


def band_values(bag: DataFrame, levels: dict[str, int], n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(band, key, rep): one row per bag and band. Where several bags of a batch meet in a band, only the smallest (rep null)
    goes on to the exchange by band; the others carry it as rep. So no band, however common, has more rows to exchange
    than there are batches."""
    shared = bag.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        import xxhash

        from tidewire.llm.bagminhash import bands, signatures

        of, top = shared.value, 1 << DEPTH
        for batch in batches:
            lists = batch.column("words")
            if not len(lists):
                continue
            # a word's n-th copy in a bag is an element of its own
            flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            coded = pc.dictionary_encode(flat)
            names = coded.dictionary.to_pylist()
            code = coded.indices.to_numpy().astype(np.int64)
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in names], dtype=np.uint64)
            level = np.array([of.get(w, top) for w in names], dtype=np.int64)
            pos = np.arange(len(code))
            new = np.ones(len(code), dtype=bool)
            new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])  # words are sorted
            copy = pos - np.maximum.accumulate(np.where(new, pos, 0))
            with np.errstate(over="ignore"):
                elements = hashes[code] + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            found = bands(signatures(elements, level[code], starts, n_bands * rows, DEPTH), rows)
            keys = np.repeat(batch.column("key").to_numpy(), found.shape[1])
            flat_bands = found.ravel() & ((1 << 48) - 1)  # a false meeting of bands costs one comparison
            order = np.lexsort((keys, flat_bands))
            keys, flat_bands = keys[order], flat_bands[order]
            same = np.zeros(len(keys), dtype=bool)
            same[1:] = (keys[1:] == keys[:-1]) & (flat_bands[1:] == flat_bands[:-1])
            keys, flat_bands = keys[~same], flat_bands[~same]
            head = np.ones(len(keys), dtype=bool)
            head[1:] = flat_bands[1:] != flat_bands[:-1]
            reps = keys[np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))]
            yield pa.RecordBatch.from_arrays([pa.array(flat_bands), pa.array(keys), pa.array(reps, mask=head)], names=["band", "key", "rep"])

    return bag.select("key", F.split("bag", " ").alias("words")).mapInArrow(run, "band bigint, key bigint, rep bigint")


def overlap(a: Column, b: Column) -> Column:
    """Multiset intersection over union of two sorted word arrays."""
    numbered = lambda x: F.transform(x, lambda w, i: F.concat(w, F.lit("\x1f"), (i - F.array_position(x, w).cast("int") + 1).cast("string")))
    repeats = (F.size(F.array_distinct(a)) < F.size(a)) | (F.size(F.array_distinct(b)) < F.size(b))
    both = F.when(repeats, F.size(F.array_intersect(numbered(a), numbered(b)))).otherwise(F.size(F.array_intersect(a, b)))
    return both / (F.size(a) + F.size(b) - both)


def repeats() -> Column:
    """How many of a bag's words are second or later copies."""
    found = F.split("bag", " ")
    return F.size(found) - F.size(F.array_distinct(found))


def overlapping(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose bags bag_a and bag_b (with repeats_a and repeats_b) overlap enough, with overlap. Common words plus the
    fewer repeats are at least the multiset intersection; copies are numbered only in pairs that this bound lets through."""
    pairs = step(pairs, wa=F.split("bag_a", " "), wb=F.split("bag_b", " "))
    pairs = step(pairs, most=F.size(F.array_intersect("wa", "wb")) + F.least("repeats_a", "repeats_b"), both=F.size("wa") + F.size("wb"))
    pairs = pairs.where(F.col("most") >= similarity * (F.col("both") - F.col("most")) - 1e-9)
    return step(pairs, overlap=overlap(F.col("wa"), F.col("wb"))).where(F.col("overlap") >= similarity - 1e-12)


def sized(a: Column, b: Column, similarity: float) -> Column:
    """Whether the bags' sizes, as the keys tell them, allow the similarity."""
    size_a, size_b = a.bitwiseAND(F.lit(255)), b.bitwiseAND(F.lit(255))
    return (F.greatest(size_a, size_b) == 255) | (F.least(size_a, size_b) >= similarity * F.greatest(size_a, size_b) - 1e-9)


def links(pairs: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose bags overlap enough: a, b, overlap."""
    pairs = written(pairs.where(sized(F.col("a"), F.col("b"), similarity)), "pairs")
    asked = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    bag = members.join(asked, "key", "left_semi").select("key", "bag").dropDuplicates(["key"])
    first = bag.select(F.col("key").alias("a"), F.col("bag").alias("bag_a"), repeats().alias("repeats_a"))
    second = bag.select(F.col("key").alias("b"), F.col("bag").alias("bag_b"), repeats().alias("repeats_b"))
    return overlapping(pairs.join(first, "a").join(second, "b"), similarity).select("a", "b", "overlap")


def degrees(label: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """label (node, label) -> k, n_links: of each key, how many other bags of its group overlap enough."""
    bag = members.select("key", "bag").dropDuplicates(["key"]).join(label, F.col("key") == F.col("node")).select("label", "key", "bag")
    bag = written(bag, "grouped")
    blocks = bag.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    bag = bag.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    # a bag meets the blocks from its own on as the first, and those up to its own as the second
    first = bag.select("label", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("key").alias("a"), F.col("bag").alias("bag_a"), repeats().alias("repeats_a"))
    second = bag.select("label", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("key").alias("b"), F.col("bag").alias("bag_b"), repeats().alias("repeats_b"))
    once = (F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))
    pairs = first.join(second, ["label", "i", "j"]).where(once & sized(F.col("a"), F.col("b"), similarity))
    return overlapping(pairs, similarity).select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n_links"))


def groups(records: DataFrame, text: Column, similarity: float = SIMILARITY, distinct: bool = False, n_bands: int = BANDS, rows: int = ROWS, counted: bool = True) -> DataFrame:
    """One row per record: id, key, label (equal within a group) and, if counted, n_links (all links of its bag to other bags
    of the group)."""
    members = written(bags(records, text, distinct), "bags")
    if not clashes(members).isEmpty():
        members = written(told_apart(members), "members")
    band = written(band_values(members, word_levels(members), n_bands, rows), "bands")
    met = band.where("rep is not null")
    heads = band.where("rep is null").select("band", "key").repartition("band")
    # bands that one batch's smallest bag alone has link nothing more; both uses read one exchange
    shared = heads.groupBy("band").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last").drop("last")
    far = written(heads.join(shared, "band"), "shared")
    stars = far.select(F.col("first").alias("a"), F.col("key").alias("b")).unionByName(met.select(F.col("rep").alias("a"), F.col("key").alias("b"))).where("a <> b")
    stars = written(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    known = written(links(stars, members, similarity), "links")
    found = components(known)
    meetings = far.select("band", "key").unionByName(met.select("band", "key")).unionByName(met.select("band", F.col("rep").alias("key"))).distinct()
    in_bucket = meetings.join(found, meetings["key"] == found["node"], "left").select("band", "key", F.coalesce("label", "key").alias("label"))
    in_bucket = written(in_bucket, "buckets")
    # components of one bucket, in blocks where it is large: a task takes the pairs of two blocks
    split = in_bucket.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("x <> y").select("band", "blocks")
    apart = in_bucket.join(split, "band").select("band", "key", "label", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"))
    labels = apart.select("band", "label", "block").distinct()
    second = labels.select("band", F.col("label").alias("label2"), F.col("block").alias("block2"))
    crossed = labels.join(second, "band").where("label < label2")
    rest = (
        crossed.join(apart.select("band", "label", "block", F.col("key").alias("a")), ["band", "label", "block"])
        .join(apart.select("band", F.col("label").alias("label2"), F.col("block").alias("block2"), F.col("key").alias("b")), ["band", "label2", "block2"])
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where(sized(F.col("a"), F.col("b"), similarity))
        .distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    more = links(rest, members, similarity)
    every = written(known.unionByName(more), "all-links")
    label = components(every)
    found = members.select("id", "key").distinct().join(label, F.col("key") == F.col("node"), "left").select("id", "key", F.coalesce("label", "key").alias("label"))
    if not counted:
        return found
    return found.join(degrees(label, members, similarity), F.col("key") == F.col("k"), "left").select("id", "key", "label", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _stories(spark: SparkSession, sf_dir: str, distinct: bool, counted: bool) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("headline", F.lit("")), F.coalesce("summary", F.lit("")))
    return groups(table(spark, sf_dir, "story").select("id", "headline", "summary"), text, distinct=distinct, counted=counted)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of stories of one group (the result's fixed form), word sets as TESTDATA.md has them."""
    found = written(_stories(spark, sf_dir, distinct=True, counted=False), "groups")
    # a group's pairs in blocks, so that no key holds all of a large group
    blocks = found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = found.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    a = rows.select(F.col("id").alias("x"), "label", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    b = rows.select(F.col("id").alias("y"), "label", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))
    pairs = a.join(b, ["label", "i", "j"]).where(((F.col("i") < F.col("j")) & (F.col("x") != F.col("y"))) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per story, by multiset overlap of its words: its group (the group's smallest id), the group's size, its links."""
    found = _stories(spark, sf_dir, distinct=False, counted=True)
    heads = found.groupBy("label").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n_in_group"))
    return found.join(heads, "label").select("id", "group_id", "n_in_group", "n_links")
