"""Rows taken one at a time in order of arrival, each held against those accepted before it, as set operations.

A row is found by keys (digests of what must be equal) and looks for keys; some keys count only within a span of time. Rows that
share no key with another new row are decided at once. The contested ones are decided in rounds: a row is a duplicate as soon as
an accepted row has a key it looks for, and accepted as soon as no earlier undecided row has one; rows are compared through
one row per key, never pair by pair. When the undecided ones are few (FEW rows, a bound on a task's state), one task takes
them in order of arrival instead; both ways give the same.

Fingerprints of 64 bits are found through cells: they are cut into max_bits + agree blocks, and a cell holds the full vectors of
one source and time slot that agree on some `agree` of the blocks. By distance bounds, a vector in none of the probed cells
differs in more than max_bits blocks, hence bits: probing one cell per choice of blocks, and the neighbouring time slots,
leaves no match out. With agree = 1 a cell is a 12 or 13-bit part of one source and slot; where those have millions of
fingerprints, agree = 2 makes them 21 bits for three times as many rows.

Rows are named by a, a struct of arrival_no and id; rows with equal a share one verdict or have the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.session import union_all, written

#: Undecided rows that one task may finish in order of arrival.
FEW = 20_000


def digest(kind: str, *cols: Column) -> Column:
    """16 bytes of the values together; null where one is null."""
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.unhex(F.md5(F.concat_ws("\x1f", F.lit(kind), *[c.cast("string") for c in cols]))))


def prints(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows (by, source_id, slot, code, ms) -> one row per by, source, time slot and fingerprint, with first_ms and last_ms. Rows that
    lack one of them have no print."""
    known = rows.where(F.col("code").isNotNull() & F.col("source_id").isNotNull() & F.col("ms").isNotNull())
    return known.groupBy(*(by or []), "source_id", "slot", "code").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def spread(one: DataFrame, max_bits: int, agree: int = 1) -> DataFrame:
    """Prints -> one row per print and choice of blocks, with its cell: j, sub."""
    parts = max_bits + agree
    cut = [64 * j // parts for j in range(parts + 1)]
    block = [F.shiftrightunsigned("code", cut[j]).bitwiseAND(F.lit((1 << (cut[j + 1] - cut[j])) - 1).cast("bigint")) for j in range(parts)]
    subs = []
    for n, chosen in enumerate(combinations(range(parts), agree)):
        sub = block[chosen[0]]
        for j in chosen[1:]:
            sub = F.shiftleft(sub, cut[j + 1] - cut[j]).bitwiseOR(block[j])
        subs.append(F.struct(F.lit(n).alias("j"), sub.alias("sub")))
    return one.select("*", F.explode(F.array(*subs)).alias("x")).select(*one.columns, "x.j", "x.sub")


def cells(rows: DataFrame, max_bits: int, agree: int = 1) -> DataFrame:
    """rows (source_id, slot, code, ms) -> one row per source, time slot, fingerprint and choice of blocks: source_id, slot, code,
    first_ms, last_ms, j, sub. Rows that lack one of them are in no cell."""
    return spread(prints(rows), max_bits, agree)


def near(a: DataFrame, b: DataFrame, max_bits: int, within: str | None = None) -> DataFrame:
    """Cell rows a (columns a_...) with those of b at most max_bits apart in their own or a neighbouring slot, maybe several times
    each; with within, only where that column is equal."""
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]).withColumn("probe", F.explode(F.array(F.col("a_slot") - 1, F.col("a_slot"), F.col("a_slot") + 1)))
    same = (F.col("a_source_id") == F.col("source_id")) & (F.col("probe") == F.col("slot")) & (F.col("a_j") == F.col("j")) & (F.col("a_sub") == F.col("sub"))
    if within:
        same = same & (F.col(f"a_{within}") == F.col(within))
    close = F.bit_count(F.col("a_code").bitwiseXOR(F.col("code"))) <= max_bits
    return left.join(b, same & close).drop("a_j", "a_sub", "j", "sub", "probe")


def code_key() -> Column:
    """The key of a fingerprint in its source and slot."""
    return digest("c", F.col("code"), F.col("slot"), F.col("source_id"))


def first_come(rows: DataFrame, n: int, span: int, old: DataFrame | None = None) -> DataFrame:
    """Verdicts among at most n rows (a, ms, plain: keys, timed: keys a row is found by within span milliseconds, close: those it
    looks for within it): a, accepted. Of rows that are found by one timed key any two must lie within the span. The rows named
    in old (a, maybe several times each) are duplicates from the start."""
    verdicts, disputed = [], rows.select("a", "ms", "plain", "timed", "close")
    if n <= FEW:
        disputed = disputed.withColumn("accepted", F.lit(None).cast("boolean"))
        if old is not None:
            none = F.array().cast("array<binary>")
            disputed = disputed.unionByName(old.select("a", F.lit(None).cast("bigint").alias("ms"), none.alias("plain"), none.alias("timed"), none.alias("close"), F.lit(False).alias("accepted")))
    else:
        known = []
        if old is not None:
            old = written(old.distinct(), "old")
            known = [disputed.join(old, "a", "left_semi").select("a", F.lit(False).alias("accepted"))]
            disputed = disputed.join(old, "a", "left_anti")
        untimed = F.lit(None).cast("bigint").alias("ms")
        plain = disputed.select("a", untimed, F.explode("plain").alias("key"))
        own = plain.unionByName(disputed.select("a", "ms", F.explode("timed").alias("key")))
        look = plain.unionByName(disputed.select("a", "ms", F.explode("close").alias("key")))
        # keys that one row alone is found by and looks for concern no other
        found_by = own.groupBy("key").agg(F.min("a").alias("first"), F.max("a").alias("last"))
        contested = look.join(found_by, "key").where((F.col("first") != F.col("a")) | (F.col("last") != F.col("a"))).select("a", "key")
        rows_of = contested.select("a").unionByName(own.join(contested.select("key").distinct(), "key").select("a")).distinct()
        free = disputed.join(rows_of, "a", "left_anti").select("a", F.lit(True).alias("accepted"))
        disputed = written(disputed.join(rows_of, "a"), "disputed")
        disputed, settled = _rounds(disputed, own.join(disputed.select("a").distinct(), "a"), look.join(disputed.select("a").distinct(), "a"), span)
        verdicts = [*known, free, settled]
        # rows settled as accepted go along, as what the others are held against
        disputed = disputed.join(settled, "a", "left")
    ordered = disputed.select("a.arrival_no", "a.id", "ms", "plain", "timed", "close", "accepted").repartition(1).sortWithinPartitions(F.col("accepted").isNull(), "arrival_no", "id")
    last = ordered.mapInArrow(_in_order(span), "arrival_no bigint, id string, accepted boolean").select(F.struct("arrival_no", "id").alias("a"), "accepted")
    return union_all([*verdicts, last])


def _rounds(disputed: DataFrame, own: DataFrame, look: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Rounds over keys until at most FEW rows are undecided: the rows still of concern, and the verdicts (a, accepted)."""
    own, look = written(own, "own"), written(look, "look")
    status = disputed.select("a", F.lit(None).cast("boolean").alias("accepted")).distinct()
    while True:
        undecided = F.col("accepted").isNull()
        by_key = own.join(status.where("accepted is null or accepted"), "a").groupBy("key").agg(
            F.min(F.when(undecided, F.col("a"))).alias("first_open"), F.collect_set(F.when(F.col("accepted"), F.struct(F.col("ms").alias("taken_ms")))).alias("taken")
        )
        # of the rows found by one key one at most is ever accepted: taken has one row or none
        hit = F.exists("taken", lambda x: F.col("ms").isNull() | (F.abs(x["taken_ms"] - F.col("ms")) <= span))
        seen = look.join(status.where(undecided).select("a"), "a").join(by_key, "key").groupBy("a").agg(F.max(hit).alias("hit"), F.min("first_open").alias("first_open"))
        verdict = F.when(F.col("hit"), F.lit(False)).when(F.col("first_open").isNull() | (F.col("first_open") >= F.col("a")), F.lit(True))
        status = written(status.join(seen, "a", "left").select("a", F.coalesce("accepted", F.when(undecided & F.col("hit").isNull(), F.lit(True)).otherwise(verdict)).alias("accepted")), "status")
        if status.where("accepted is null").limit(FEW + 1).count() <= FEW:
            break
    open_ = status.where("accepted is null").select("a")
    # accepted rows matter for the rest only where an undecided row looks for a key of theirs
    asked = look.join(open_, "a").select("key").distinct()
    holders = own.join(asked, "key").join(status.where("accepted").select("a"), "a").select("a").distinct()
    return disputed.join(open_.unionByName(holders), "a"), status.where("accepted is not null")


def _in_order(span: int):
    """Rows one at a time, those already accepted (True) and the names of duplicates (False) first, the others in order of arrival:
    verdicts of the others."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        plain_taken: set[bytes] = set()
        timed_taken: dict[bytes, list[int]] = {}
        old: set[tuple] = set()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for arrival, row_id, ms, plain, timed, close, accepted in zip(*[c.to_pylist() for c in batch.columns]):
                if accepted is False:
                    old.add((arrival, row_id))
                    continue
                take = accepted or not (
                    (arrival, row_id) in old or any(k in plain_taken for k in plain) or any(abs(t - ms) <= span for k in close for t in timed_taken.get(k, ()))
                )
                if accepted is None:
                    for col, v in zip(out, (arrival, row_id, take)):
                        col.append(v)
                if take:
                    plain_taken.update(plain)
                    for k in timed:
                        timed_taken.setdefault(k, []).append(ms)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.bool_()))], names=["arrival_no", "id", "accepted"])

    return run
