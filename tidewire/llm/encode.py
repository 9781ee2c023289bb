"""Encoding of the whole corpus with a public tokenizer (problem 7).

Texts are cut into content-defined chunks: a rolling hash over the last signs picks the cuts, so texts that share a passage
share its chunks, wherever it stands. Each distinct chunk is encoded once for the whole corpus and its ids are joined back.
A cut is taken where the tokenizer's own splitting cannot span it (a change between letters, digits and punctuation, or
before a single blank); where a passage offers no such place for too long, the cut is made anyway and the join is repaired:
the stretch from the last to the next place that nothing can span is encoded anew, a window on whose both sides the text's
own splitting agrees with the chunks', whose ids are used up to it. So the ids are exactly those of the whole text.

Defined results: null and empty texts have an empty list; every row of the input gives one row, repeated ids too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.tokenizer import TOKENIZER, TOKENIZER_DIR, encoder, id_type, ship_tokenizer, token_bytes
from tidewire.session import table, written

#: Signs the rolling hash sees; mean number of possible places per cut; least and greatest chunk in signs.
WINDOW, SPACING, LEAST, MOST = 16, 128, 64, 4096


@lru_cache(maxsize=1)
def _classes():
    """Class of every code point: 1 letter, 2 digit, 3 punctuation, 4 blank or line end, 5 other signs, 6 apostrophe, 0 what never is beside a cut."""
    import numpy as np

    out = np.full(0x110000, 5, dtype=np.uint8)
    out[:0xC0] = 0
    out[0x1680] = out[0x3000] = 0
    out[0x2000:0x2070] = 0
    for c in range(33, 127):
        ch = chr(c)
        out[c] = 1 if ch.isalpha() else 2 if ch.isdigit() else 6 if ch == "'" else 3
    out[10] = out[32] = 4
    return out


def places(cp):
    """Where the tokenizer's splitting cannot span: a boolean per position (the cut is before that sign)."""
    import numpy as np

    cls = _classes()[cp]
    out = np.zeros(len(cp), dtype=bool)
    plain = (cls - np.uint8(1)) < 3  # 1 to 3
    blank = cls == 4
    solid = (cls > 0) & ~blank
    out[1:] = (cls[:-1] != cls[1:]) & plain[:-1] & plain[1:]
    out[1:-1] |= blank[1:-1] & solid[:-2] & solid[2:]
    return out


def rolling(cp):
    """Hash of the WINDOW signs before each position."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        h = np.zeros(len(cp), dtype=np.uint64)
        for k in range(1, WINDOW + 1):
            h[k:] += x[:-k] * np.uint64(pow(0xBF58476D1CE4E5B9, k, 1 << 64))
    return h


def segments(text: str) -> list[tuple[str, int, int]]:
    """The text as (chunk, from byte, to byte): the stretches of chunks whose ids make up the text's."""
    import numpy as np

    cp = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    n, safe = len(cp), places(cp)
    spots = np.flatnonzero(safe)
    marked = spots[(rolling(cp)[spots] >> np.uint64(40)) % np.uint64(SPACING) == 0]
    cuts, last = [0], 0
    for m in [*marked.tolist(), n]:
        if m != n and m - last < LEAST:
            continue
        while m - last > MOST:
            k = int(np.searchsorted(spots, last + MOST, "right")) - 1
            last = int(spots[k]) if k >= 0 and spots[k] >= last + LEAST else last + MOST
            cuts.append(last)
        if m > last:
            cuts.append(m)
            last = m
    if all(safe[c] for c in cuts[1:-1]):
        return [(text[a:b], 0, -1) for a, b in zip(cuts, cuts[1:])]
    windows: list[list[int]] = []
    for c in cuts[1:-1]:
        if not safe[c]:
            k = int(np.searchsorted(spots, c))
            a, b = int(spots[k - 1]) if k else 0, int(spots[k]) if k < len(spots) else n
            if windows and a < windows[-1][1]:
                windows[-1][1] = max(windows[-1][1], b)
            elif not windows or b > windows[-1][1]:
                windows.append([a, b])
    size = lambda a, b: len(text[a:b].encode())
    out: list[tuple[str, int, int]] = []
    w = 0
    for a, b in zip(cuts, cuts[1:]):
        at = a
        while at < b:
            while w < len(windows) and windows[w][1] <= at:
                w += 1
            if w < len(windows) and windows[w][0] <= at:
                if windows[w][0] == at:
                    out.append((text[at : windows[w][1]], 0, -1))
                at = min(b, windows[w][1])
                continue
            end = min(b, windows[w][0]) if w < len(windows) else b
            out.append((text[a:b], size(a, at), size(a, end)) if (at, end) != (a, b) else (text[a:b], 0, -1))
            at = end
        # a window that begins inside the next chunk is met there
    return out


def encode_corpus(docs: DataFrame, key: str, text: str, name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """One row per row of docs: key and ids (array<int>) of the text, without special tokens."""
    ship_tokenizer(docs.sparkSession, name, folder)
    kind = docs.schema[key].dataType.simpleString()
    numbered = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("ord"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for k, o, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for i, (chunk, a, b) in enumerate(segments(t) if t else [("", 0, -1)]):
                    for col, v in zip(rows, (k, o, i, chunk, a, b)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.string()), pa.array(rows[4], pa.int32()), pa.array(rows[5], pa.int32())], names=["key", "ord", "i", "chunk", "a", "b"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        # ids travel as bytes: two each where the vocabulary allows it
        enc, width = encoder(name, folder), id_type(name, folder)
        for batch in batches:
            ids = [np.array(enc.encode_ordinary(x), dtype=width).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["h", "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lengths, width = token_bytes(name, folder), id_type(name, folder)
        for batch in batches:
            flat, offsets = [np.empty(0, dtype=np.int32)], [0]
            for parts in batch.column(1).to_pylist():
                n = 0
                for p in sorted(parts, key=lambda p: p["i"]):
                    ids = np.frombuffer(p["ids"], dtype=width)
                    if p["b"] >= 0:
                        ends = np.r_[0, np.cumsum(lengths[ids])]
                        ids = ids[int(np.searchsorted(ends, p["a"])) : int(np.searchsorted(ends, p["b"]))]
                    flat.append(ids.astype(np.int32))
                    n += len(ids)
                offsets.append(offsets[-1] + n)
            values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["key", "ids"])

    chunks = written(numbered.mapInArrow(cut, f"key {kind}, ord bigint, i int, chunk string, a int, b int").withColumn("h", F.unhex(F.md5("chunk"))), "chunks")
    distinct = chunks.where("chunk <> ''").select("h", "chunk").dropDuplicates(["h"])
    coded = distinct.mapInArrow(encode, "h binary, ids binary")
    parts = chunks.drop("chunk").join(coded, "h", "left").select("key", "ord", F.struct("i", "a", "b", F.coalesce("ids", F.lit(b"")).alias("ids")).alias("p"))
    return parts.groupBy("ord").agg(F.first("key").alias("key"), F.collect_list("p").alias("parts")).select("key", "parts").mapInArrow(join, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def with_size(docs: DataFrame, text: str, out: str = "n_tokens", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """docs without the text, with its size in tokens (0 for null and empty texts)."""
    from pyspark.sql import types as T

    ship_tokenizer(docs.sparkSession, name, folder)
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(out, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            sizes = [len(enc.encode_ordinary(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(sizes, pa.int64())], names=[*kept, out])

    return docs.select(*kept, text).mapInArrow(count, schema)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
