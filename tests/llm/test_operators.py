"""The operators on small fixtures: brute force, and nulls, empty and long texts, ties, repeated rows, empty tables, other columns."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import bagminhash, encode, history, lines, mixing, neardup, splitting, survivor, truncation
from tidewire.llm.bagminhash import signatures
from tidewire.llm.tokenizer import encoder
from tidewire.operators import arrival
from tidewire.operators.components import components

T0 = datetime(2025, 1, 1)
SENTENCE = "The panel heard that the quiet network had been patrolled twice at noon. "


# --- p1 -------------------------------------------------------------------------------------------------------------
STORY = "id string, source_id string, summary string, excerpt string, text int, body string"


def cut(spark, rows):
    df = spark.createDataFrame([(f"i{n}", s, a, b, 1, "x") for n, (s, a, b) in enumerate(rows)], STORY)
    return {(r.id, r.field_name): r.is_case for r in truncation.posteriors(df).collect()}


def test_truncation_cases(spark):
    added = ["", "…", "...", " [...]", " [&#8230;]", " Read more", " #tag", " 🎉", ' <a href="', " &#82", " https://x.example/live", " (Cocoa Gazette)", "\n<p>Got a tip? Call 0800</p>"]
    rows = [("s", SENTENCE + "Officials in the town app" + a, None) for a in added] + [("s", SENTENCE.strip() + a, None) for a in added if a not in ("…", "...")]
    rows += [("s", "Also today: Rapid rise leaves town short; How the council plans a road", "n/a"), ("s", SENTENCE + "The song was sold to Dr.", ""), (None, "-", " "), ("s", None, SENTENCE * 2000 + "Half a sen"), ("s", '"We will be back," she said.', "<p></p>")]
    got = cut(spark, rows)
    n = len(added)
    assert [got[f"i{i}", "summary"] for i in range(n)] == [True] * n
    assert [got[f"i{i}", "summary"] for i in range(n, 2 * n - 2)] == [False] * (n - 2)
    m = 2 * n - 2
    assert not got[f"i{m}", "summary"] and got[f"i{m + 1}", "summary"] and got[f"i{m + 3}", "excerpt"] and not got[f"i{m + 4}", "summary"]
    assert (f"i{m}", "excerpt") not in got and (f"i{m + 2}", "summary") not in got and (f"i{m + 4}", "excerpt") not in got


def test_truncation_numbers_by_context(spark):
    rows = [("s", f"The pension cost {n}.5 per cent and left. They sell the ferry for {n}. " + SENTENCE, None) for n in range(20, 60)]
    rows += [("s", SENTENCE + "The tariff cost 31.", None), ("s", SENTENCE + "They would sell the ferry for 31.", None)]
    got = cut(spark, rows)
    assert got["i40", "summary"] and not got["i41", "summary"]


def test_truncation_by_length(spark):
    """The same list of headlines, with the same ending, is a case at its source's limit and none elsewhere."""
    rng = random.Random(11)
    words = "panel network council harbour quiet bridge report officials market winter garden station".split()
    prose = lambda n: " ".join([" ".join(rng.choice(words) for _ in range(rng.randrange(5, 12))).capitalize() + "." for _ in range(n)])
    made = lambda: "Also today: " + "; ".join(" ".join(rng.choice(words).capitalize() for _ in range(4)) for _ in range(rng.randrange(3, 9)))
    same = made() + "; The Panel Heard Nothing"
    at = len(same)
    rows = [("limited", prose(60)[:at].rstrip() if (i % 4) else prose(3), None) for i in range(240)] + [("free", prose(rng.randrange(1, 5)), None) for _ in range(240)]
    rows += [(s, x, None) for s in ("limited", "free") for x in [made() for _ in range(40)] if abs(len(x) - at) > 2] + [("limited", same, None), ("free", same, None)]
    got = cut(spark, rows)
    n = len(rows)
    assert got[f"i{n - 2}", "summary"] and not got[f"i{n - 1}", "summary"]
    assert not any(got[f"i{k}", "summary"] for k in range(480, n - 2))


def test_truncation_empty(spark):
    assert truncation.posteriors(spark.createDataFrame([], STORY)).count() == 0


# --- p2 -------------------------------------------------------------------------------------------------------------
ROW = "id string, source_id string, url_hash string, title_key string, simhash string, fetched_at timestamp"


def story_rows(rng, n, prefix):
    base = [rng.getrandbits(64) for _ in range(6)]
    out = []
    for i in range(n):
        code = rng.choice(base)
        for _ in range(rng.randrange(6)):
            code ^= 1 << rng.randrange(64)
        url = rng.choice([None, f"{rng.randrange(60):064x}"])
        out.append((f"{prefix}{i}", rng.choice(["a", "a", "b", None]), url, rng.choice([None, f"{rng.randrange(80):032X}"]), rng.choice([None, f"0x{code:016X}", f"{code:016x}"]), rng.choice([None, T0 + timedelta(hours=rng.randrange(400))])))
    return out


def brute_history(old, new):
    plain = lambda v: None if v is None else v.lower().removeprefix("0x")
    taken = [(s, plain(u), plain(t), plain(h), f) for _, s, u, t, h, f in old]
    found = set()
    for i, s, u, t, h, f in new:
        u, t, h = plain(u), plain(t), plain(h)
        if any(
            (u and u == b[1]) or (t and s and (s, t) == (b[0], b[2])) or (h and b[3] and s and s == b[0] and f and b[4] and (int(h, 16) ^ int(b[3], 16)).bit_count() <= 4 and abs(f - b[4]) <= timedelta(hours=72))
            for b in taken
        ):
            found.add(i)
        else:
            taken.append((s, u, t, h, f))
    return found


@pytest.mark.parametrize("seed, few, agree", [(1, 20_000, 1), (2, 0, 1), (3, 5, 2)])
def test_history_is_row_by_row(spark, tmp_path, monkeypatch, seed, few, agree):
    monkeypatch.setattr(arrival, "FEW", few)
    rng = random.Random(seed)
    old, new = story_rows(rng, 40, "o"), story_rows(rng, 90, "n")
    want = brute_history(old, new)
    batch = spark.createDataFrame([(*r, i, i // 30, 0) for i, r in enumerate(new)], ROW + ", arrival_no bigint, batch_no int, slot int")
    stored = history.prepared(spark.createDataFrame(old, ROW))
    whole = history.HistoryIndex(spark, f"{tmp_path}/w", agree=agree)
    whole.append(stored)
    assert {r.id for r in whole.ingest(batch).where("is_duplicate").collect()} == want
    # batch by batch gives the same as all at once; a batch that failed before its marker was written counts once
    steps = history.HistoryIndex(spark, f"{tmp_path}/s", agree=agree)
    steps.append(stored, "old")
    got = set()
    for b in range(3):
        part = batch.where(F.col("batch_no") == b)
        if b == 1:
            mark = steps._mark
            monkeypatch.setattr(steps, "_mark", lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                steps.ingest(part, "b1")
            monkeypatch.setattr(steps, "_mark", mark)
        got |= {r.id for r in steps.ingest(part, f"b{b}").where("is_duplicate").collect()}
        if b == 1:
            rows = steps.cells().count()
            steps = history.HistoryIndex(spark, steps.path, agree=agree)  # opened anew: only what is stored counts
            steps.compact()
            assert len(steps.segments()) == 1 and 0 < steps.cells().count() <= rows
    assert got == want


def test_batches_follow_the_order_of_arrival(spark):
    rows = [("a", 2, 30), ("b", 1, 10), ("c", 1, 19), ("d", 3, 35), ("e", 2, 36), ("f", None, 50), ("g", 1, None)]
    got = history.in_batches(spark.createDataFrame(rows, "id string, batch_no int, arrival_no bigint"))
    assert got == [(10, 19), (30, 36), (50, 50), (history._LAST, history._LAST)]


def test_history_batches_at_once_cost_few_jobs(spark, tmp_path):
    """Every job leaves plans, threads and code in the driver: with 19 a batch 24 batches took more than 1500 MB of it."""
    rng = random.Random(4)
    old, new = story_rows(rng, 40, "o"), story_rows(rng, 120, "n")
    last = lambda: spark.range(1).count() and max(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    index = history.HistoryIndex(spark, f"{tmp_path}/i")
    index.append(history.prepared(spark.createDataFrame(old, ROW)), "history")
    batch = spark.createDataFrame([(*r, i, i // 20) for i, r in enumerate(new)], ROW + ", arrival_no bigint, batch_no int")
    took = []
    for part, name in ((batch.where("batch_no < 1"), "a"), (batch.where("batch_no >= 1"), "b")):
        ranges, began = history.in_batches(part), last()
        found = index.ingest_all(part, [low for low, _ in ranges], [f"{name}{i}" for i in range(len(ranges))])
        took.append(last() - began)
        assert len(ranges) == (1 if name == "a" else 5) and len(index.segments()) == (2 if name == "a" else 7)
        took[-1] = (took[-1], {r.id for r in found.where("is_duplicate").collect()})
    assert took[0][1] | took[1][1] == brute_history(old, new)
    assert (took[1][0] - took[0][0]) / 4 <= 11, took


def test_history_copies_and_empty(spark, tmp_path):
    index = history.HistoryIndex(spark, f"{tmp_path}/i")
    index.append(history.prepared(spark.createDataFrame([], ROW)))
    rows = [(f"n{i}", "a", None, None, "0" * 16, T0 + timedelta(hours=30 * i), i) for i in range(8)]
    batch = spark.createDataFrame(rows + rows[:2], ROW + ", arrival_no bigint")
    got = {r.id: r.is_duplicate for r in index.ingest(batch).collect()}
    assert got == {f"n{i}": i % 3 != 0 for i in range(8)}  # each accepted row covers the next 72 hours
    assert index.ingest(batch.limit(0)).count() == 0
    assert index.ingest(batch).where("not is_duplicate").count() == 0


# --- p3 -------------------------------------------------------------------------------------------------------------
def test_lines_in_ten_documents(spark, monkeypatch):
    docs = [("t", "s", f"d{i}", f"Body {chr(97 + i)}\n<p>Sign&nbsp;up at {i}</p>\r\n\n  SIGN  up at 7 \nonly nine" if i < 9 else f"Body {chr(97 + i)}\nsign up at 1", i) for i in range(12)]
    docs += [("t", "other", f"e{i}", "sign up at 3", 0) for i in range(9)] + [("t", None, "f", "sign up at 3", 0), ("t", "s", "g", None, 0), ("t", "s", "h", "", 0), ("t", "s", "long", "x" * 200_000 + "\nsign up at 5", 0)]
    df = spark.createDataFrame(docs, "tbl string, source_id string, rec_id string, text string, no int")
    want = {(f"d{i}", n) for i in range(9) for n in (2, 4)} | {(f"d{i}", 2) for i in range(9, 12)} | {("long", 2)}
    for sparse in (1024, 6, 0):  # arrays, runs and plain bitmaps hold the same documents
        monkeypatch.setattr(lines, "SPARSE", sparse)
        got = {(r.rec_id, r.no) for r in lines.repeated_places(df).collect()}
        assert got == want
    kinds = lines.line_bitmaps(lines.line_table(df))
    assert kinds.where("bits is not null").count() > 0 and kinds.where("few is not null and runs is not null").count() == 0
    assert lines.repeated_places(df.limit(0)).count() == 0


def test_lines_count_documents_and_leave_others_alone(spark):
    # one document with a line twice is one document; rows that share an id lose only their own lines
    docs = [("t", "s", f"d{i}", "Sign up\nSign up" if i else f"Sign up\nown {i}") for i in range(9)] + [("t", "s", "x", "alone\nkept"), ("t", "s", "x", "Sign up\nkept"), ("t", "s", None, "SIGN UP\nlast")]
    df = spark.createDataFrame(docs, "tbl string, source_id string, rec_id string, text string")
    assert lines.repeated_places(df.limit(9)).count() == 0
    got = sorted((r.rec_id or "", r.n_removed, r.text) for r in lines.cleaned(df).collect())
    assert got == sorted([(f"d{i}", 2, "") for i in range(1, 9)] + [("d0", 1, "own 0"), ("x", 1, "kept"), ("", 1, "last")])


@pytest.mark.parametrize("n", [3000])
def test_containers_hold_what_they_were_given(spark, monkeypatch, n):
    monkeypatch.setattr(lines, "SPARSE", 64)
    rng = random.Random(n)
    numbers = {"few": rng.sample(range(32768), 40), "runs": [*range(5, 900), 32767], "bits": rng.sample(range(32768), n)}
    rows = [("t", "s", k, 0, v, x % 3) for k, xs in ((1, numbers["few"]), (2, numbers["runs"]), (3, numbers["bits"])) for x in xs for v in [x]]
    df = spark.createDataFrame(rows, "tbl string, source_id string, h bigint, block bigint, low int, v bigint").withColumn("low", F.col("low").cast("smallint"))
    made = lines.line_bitmaps(df)
    assert {r.h: r.n_docs for r in made.collect()} == {1: 40, 2: 896, 3: n}
    asked = spark.range(0, 32768, 7).select(F.col("id").cast("int").alias("x")).crossJoin(made).where(lines.holds(F.col("x")))
    got = {(r.h, r.x) for r in asked.select("h", "x").collect()}
    assert got == {(h, x) for h, k in ((1, "few"), (2, "runs"), (3, "bits")) for x in numbers[k] if x % 7 == 0}


# --- p4 -------------------------------------------------------------------------------------------------------------
def test_bagminhash_is_unbiased(monkeypatch):
    rng = np.random.default_rng(0)
    a = {int(x): int(w) for x, w in zip(rng.integers(1, 10**9, 40), rng.integers(1, 17, 40))}
    b = {k: (v if i % 3 else max(1, v // 2)) for i, (k, v) in enumerate(a.items()) if i < 32} | {7: 9, 8: 3}
    keys = list(a), list(b)
    elements, levels, starts = np.array(keys[0] + keys[1], dtype=np.uint64), np.array([a[k] for k in keys[0]] + [b[k] for k in keys[1]]), np.array([0, len(a)])
    sig = signatures(elements, levels, starts, 4096, 4)
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03
    # where the processes are stopped, and in what blocks they are followed, changes nothing
    for slack, block in ((-3.0, 1 << 17), (20.0, 1 << 17), (5.0, 16)):
        monkeypatch.setattr(bagminhash, "SLACK", slack)
        monkeypatch.setattr(bagminhash, "BLOCK", block)
        assert (signatures(elements, levels, starts, 512, 4) == signatures(elements[::-1], levels[::-1], np.array([0, len(b)]), 512, 4)[::-1]).all()
        assert (signatures(elements, levels, starts, 512, 4)[0] == signatures(elements[: len(a)], levels[: len(a)], np.array([0]), 512, 4)[0]).all()
    few = signatures(elements, levels, starts, 512, 4)
    monkeypatch.undo()
    assert (few == signatures(elements, levels, starts, 512, 4)).all()


def test_equal_keys_of_other_bags_are_told_apart(spark):
    rows = [("a", "x y", 512 + 2), ("b", "z w", 512 + 2), ("c", "x y", 512 + 2), ("d", "q", 256 + 1)]
    got = {r.id: r.key for r in neardup.told_apart(spark.createDataFrame(rows, "id string, bag string, key bigint")).collect()}
    assert got["a"] == got["c"] != got["b"] and got["d"] == 257 and got["a"] & 255 == 2


def brute_groups(texts, distinct):
    import re
    from collections import Counter

    bags = {i: Counter(re.findall(r"[^\W_]+", t.lower())) for i, t in texts.items() if t}
    if distinct:
        bags = {i: Counter(set(b)) for i, b in bags.items()}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in bags:
        for j in bags:
            if i < j and bags[i] and bags[j] and sum((bags[i] & bags[j]).values()) >= 0.6 * sum((bags[i] | bags[j]).values()) - 1e-12:
                parent[find(i)] = find(j)
    out = {}
    for i in bags:
        if bags[i]:
            out.setdefault(find(i), set()).add(i)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("distinct", [True, False])
def test_groups_by_brute_force(spark, distinct):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for g in range(30):
        base = rng.sample(vocabulary, 30) + ["the", "of", "the"]
        for k in range(rng.choice([1, 2, 5])):
            words = list(base)
            for _ in range(rng.randrange(6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[f"g{g}-{k}"] = " ".join(words)
    # a chain of small edits: equal ends are far apart, and a large group of copies and near-copies
    chain = rng.sample(vocabulary, 40)
    for k in range(12):
        chain = chain[3:] + rng.sample(vocabulary, 3)
        texts[f"chain{k}"] = " ".join(chain)
    for k in range(60):
        texts[f"copy{k}"] = "a b c d e f g h i j k l m n o p q r s t" + (f" x{k}" if k % 2 else "")
    texts |= {"null": None, "empty": "", "signs": "?!", "long": "word " * 30_000}
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in texts.items()], "id string, text string, label int, key string")
    got = neardup.groups(df.select("id", "text"), F.coalesce("text", F.lit("")), distinct=distinct, n_bands=120).collect()  # so many that none is missed
    found = {}
    for r in got:
        found.setdefault(r.label, set()).add(r.id)
    assert {frozenset(g) for g in found.values()} == brute_groups(texts, distinct)
    assert neardup.groups(df.limit(0).select("id", "text"), F.col("text")).count() == 0


@pytest.mark.parametrize("block", [3, 1000])
def test_links_by_brute_force(spark, monkeypatch, block):
    from collections import Counter

    monkeypatch.setattr(neardup, "BLOCK", block, raising=False)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for g in range(12):
        base = rng.sample(vocabulary, 24)
        for k in range(8):
            words = [*base, "the", "the"]
            for at in rng.sample(range(24), rng.randrange(6)):
                words[at] = rng.choice(vocabulary)
            texts[f"g{g}-{k}"] = " ".join(words)
        texts[f"g{g}-copy"] = texts[f"g{g}-0"]
    got = neardup.groups(spark.createDataFrame(list(texts.items()), "id string, text string"), F.col("text"), n_bands=120).collect()
    bags = {tuple(sorted(t.split())): r.label for r in got for t in [texts[r.id]]}
    near = lambda a, b: sum((Counter(a) & Counter(b)).values()) >= 0.6 * sum((Counter(a) | Counter(b)).values()) - 1e-12
    want = {a: sum(a != b and bags[a] == bags[b] and near(a, b) for b in bags) for a in bags}
    assert {r.id: r.n_links for r in got} == {i: want[tuple(sorted(t.split()))] for i, t in texts.items()} and max(want.values()) > 2


def test_star_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[300 + i] == 300 for i in range(200))
    assert all(got[a] == got[b] for a, b in edges if a != b)


# --- p6 -------------------------------------------------------------------------------------------------------------
FIELDS = "id string, cluster_id string, trust_tier int, importance int, fetched_at timestamp, author string, dek string, excerpt string, image_url string, value int, grp int"


def test_survivors(spark):
    rows = [
        ("b", "c1", 1, 5, T0, "Ann", "n/a", None, "u1"), ("a", "c1", 1, 5, T0, "Bob", "-", "cut te", "u1"), ("c", "c1", None, 9, T0, "Ann", "dek", " ", None), ("d", "c2", 2, None, None, None, None, "", "none"),
        ("e", None, 1, 1, T0, "x", "x", "x", "x"), ("ab", "c3", 1, 1, T0, "p", "p", None, None), ("abc", "c3", 1, 1, T0, "q", "q", None, None), ("ab", "c3", 1, 1, T0, "p", "p", None, None),
    ]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], FIELDS)
    got = {(r.grp, r.field_name): r.id for r in survivor.winners(df, "cluster_id", policy="best_row", at_least=2).collect()}
    assert got == {("c1", "author"): "a", ("c1", "dek"): "c", ("c1", "excerpt"): "a", ("c1", "image_url"): "a", ("c3", "author"): "ab", ("c3", "dek"): "ab"}
    best = {r.cluster_id: r for r in survivor.records(df, "cluster_id").collect()}
    assert best["c1"].author == "Ann" and best["c1"].dek == "dek" and best["c2"].author is None and best["c3"].n_rows == 3
    assert survivor.records(df.limit(0), "cluster_id").count() == 0
    with pytest.raises(ValueError):
        survivor.winners(df, "cluster_id", policy="x")


def test_votes_have_no_horizon(spark):
    # thirty years ago: two rows of one value against one somewhat younger, all far beyond any fixed span from today
    old = datetime(1990, 1, 1)
    rows = [("a", "g", 1, 0, old, "Ann"), ("b", "g", 1, 0, old, "ann "), ("c", "g", 1, 0, old + timedelta(hours=60), "Bob"), ("d", "h", 1, 0, old, "Ann"), ("e", "h", 1, 0, old + timedelta(hours=60), "Bob"), ("f", "h", 9, 9, T0, None)]
    rows += [("i", "k", 3, 0, None, "Ann"), ("j", "k", 3, 0, None, "Ann"), ("l", "k", 2, 0, None, "Bob"), ("m", "n", 1, 0, datetime(2070, 1, 1), "Ann"), ("o", "n", 1, 0, datetime(1970, 1, 1), "Bob"), ("p", "n", 1, 0, datetime(1970, 1, 2), "Bob")]
    df = spark.createDataFrame([(*r, "x", None, "y") for r in rows], "id string, cluster_id string, trust_tier int, importance int, fetched_at timestamp, author string, dek string, excerpt string, image_url string")
    got = {r.cluster_id: r.author for r in survivor.records(df, "cluster_id").collect()}
    assert got == {"g": "Ann", "h": "Bob", "k": "Bob", "n": "Ann"}


# --- p7 -------------------------------------------------------------------------------------------------------------
def test_ids_are_the_whole_texts(spark):
    rng = random.Random(9)
    parts = ["a" * 9000, "漢字かな" * 2000, " " * 5000, "it's don't 'll", "x1y2|", "é", "\n\n", "\t", "!?", "🎉", "　", "word ", "The quick brown fox. " * 60, "<|endoftext|>", "​", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 10))) for _ in range(60)] + ["", None, " "]
    texts += texts[:5]
    enc = encoder()
    df = spark.createDataFrame([(i % 40, t, 1, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, ord int, h string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode.encode_corpus(df, "doc_id", "text").collect())
    assert got == sorted((i % 40, enc.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert encode.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


# --- p8 -------------------------------------------------------------------------------------------------------------
def test_mixing_reaches_shares(spark):
    rng = random.Random(2)
    docs = [(i, "big" if i % 3 == 0 else f"s{i % 4}", rng.randrange(1, 200)) for i in range(900)] + [(9000, "big", 0), (9001, None, 5), (9000, "big", 7), (9000, "big", 7)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = [("m", "big", 0.5, 3, 0.9), ("m", "s1", 0.3, 3, 0.9), ("m", "s2", 0.2, 9, 0.9), ("tiny", "s1", 1.0, 1, 5.0), ("odd", "none", 1.0, 1, 1.0), ("odd", "s1", None, 1, 1.0), (None, "s1", 1.0, 1, 1.0)]
    got = mixing.mixed(df, spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int, total_ratio double")).collect()
    total, budget = {}, int(sum(d[2] for d in docs) * 0.9)
    for r in got:
        total[r.mix_name, r.source] = total.get((r.mix_name, r.source), 0) + r.n_tokens
    m = {s: n for (x, s), n in total.items() if x == "m"}
    assert budget - 200 <= sum(m.values()) <= budget
    assert all(abs(m[s] / sum(m.values()) - w) < 0.01 for s, w in (("big", 0.5), ("s1", 0.3), ("s2", 0.2)))
    assert total["tiny", "s1"] == sum(d[2] for d in docs if d[1] == "s1") and not any(k[0] in ("odd", None) for k in total)
    assert max(r.use for r in got if r.mix_name == "m" and r.source == "big") <= 2
    assert mixing.mixed(df.limit(0), spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int, total_ratio double")).count() == 0


MIX = "mix_name string, source string, target_share double, max_repeats int, total_ratio double"


def test_mixing_by_brute_force(spark):
    rng = random.Random(6)
    docs = [(i, "short", 10) for i in range(12)] + [(100, "long", 90), (101, "long", 60)] + [(200 + i, rng.choice("xyz"), rng.choice([1, 3, 20, 200])) for i in range(60)]
    targets = [("half", "short", 0.5, 1, 0.05), ("half", "long", 0.5, 1, 0.05), ("dry", "short", 0.6, 2, 0.3), ("dry", "x", 0.3, 9, 0.3), ("dry", "y", 0.1, 3, 0.3)]
    targets += [("endless", "short", 0.5, 2_000_000_000, 0.2), ("endless", "y", 0.5, 2_000_000, 0.2)]
    targets += [(f"m{k}", s, rng.choice([0.1, 0.5, 2.0]), rng.randrange(1, 4), k / 16) for k in range(1, 9) for s in ("short", "long", "x", "y", "z")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    queue = mixing.queued(df).collect()
    total = {s: sum(d[2] for d in docs if d[1] == s) for s in {d[1] for d in docs}}
    want = set()
    for mix in {t[0] for t in targets}:
        plan = {t[1]: t for t in targets if t[0] == mix}
        uses = [((u * total[r.source] + r.cum) / plan[r.source][2], r.source, r.place, r.doc_id, r.copy, u, r.n_tokens) for r in queue if r.source in plan for u in range(min(plan[r.source][3], 300))]
        left = int(next(iter(plan.values()))[4] * sum(total.values()))
        for use in sorted(uses):
            left -= use[-1]
            if left < 0:
                break
            want.add((mix, use[1], use[3], use[5]))
    got = [(r.mix_name, r.source, r.doc_id, r.use) for r in mixing.mixed(df, spark.createDataFrame(targets, MIX)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


# --- p9 -------------------------------------------------------------------------------------------------------------
def search_all(kinds, n, step, overlap, target):
    """Least cost over all cuts, from the end back."""
    best = {n: 0.0}
    for at in range(n - 1, overlap - 1, -1):
        own = lambda e: ((e - at + overlap - target) / target) ** 2 + (splitting.PENALTY[kinds[e]] if e < n else 0)  # noqa: B023, E731
        best[at] = min(own(e) + best[e] for e in range(at + 1, min(n, at + step) + 1))
    return best[overlap]


@pytest.mark.parametrize("sparse", [False, True])
def test_cuts_are_the_best_by_exhaustive_search(sparse):
    rng = random.Random(4)
    tasks = []
    for _ in range(400):
        n, limit = rng.randrange(12, 140 if sparse else 40), rng.randrange(5, 13)
        overlap = rng.randrange(0, min(4, limit))
        weights = [1, 1, rng.choice([3, 10]), rng.choice([5, 30]), rng.choice([0, 10])] if sparse else [1, 1, 1, 1, 0]
        tasks.append((n, limit - overlap, overlap, rng.choices([0, 1, 2, 3, 4], weights, k=n + 1)))
    flat, start, end = [], [], []
    for n, _, overlap, kinds in tasks:
        start.append(len(flat) + overlap)
        end.append(len(flat) + n)
        flat += [9] * overlap + [0] + kinds[overlap + 1 : n] + [0]
    cuts, owner = splitting.best_cuts(np.array(flat, dtype=np.int8), np.array(start), np.array(end), np.array([t[1] for t in tasks]), np.array([t[2] for t in tasks]))
    for i, (n, step, overlap, kinds) in enumerate(tasks):
        mine = [int(c) - start[i] + overlap for c in cuts[owner == i]]
        k = max(2, -(-(n - overlap) // step))
        target = (n - overlap) / k + overlap
        sizes = [e - a + overlap for a, e in zip([overlap, *mine], mine)]
        cost = sum(((s - target) / target) ** 2 for s in sizes) + sum(splitting.PENALTY[kinds[e]] for e in mine[:-1])
        assert mine[-1] == n and max(sizes) <= step + overlap and cost == pytest.approx(search_all(kinds, n, step, overlap, target), rel=1e-9)


PROFILE = "profile string, max_tokens int, overlap_tokens int"


def test_pieces(spark, monkeypatch):
    enc = encoder()
    texts = ["One two three. " * 80, "para one\n\n" * 90, "漢字かな交じり" * 300, "x" * 3000, "🎉" * 400, "short", "", None, "a|b" * 500, "é" * 60 + " ab" * 90, "don't 'll 12a3 _x_ " * 200, "\n" * 700, "long wordy text " * 20_000]
    df = spark.createDataFrame([(i, t, "p", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, profile string, max_tokens int")
    profiles = [("tight", 16, 4), ("none", 40, 0), ("odd", 8, 20), ("null", 30, None), ("negative", 30, -5), (None, 500, 3), ("one", 1, 0), ("off", 0, 0), ("unset", None, 1)]
    monkeypatch.setattr(splitting, "PROFILES", 4)
    got = splitting.split_documents(df, spark.createDataFrame(profiles, PROFILE)).collect()
    for profile, limit, overlap in profiles:
        overlap = min(max(overlap or 0, 0), (limit or 1) - 1)
        for i, t in enumerate(texts):
            ids = enc.encode_ordinary(t or "")
            mine = sorted((r for r in got if r.profile == profile and r.doc_id == i), key=lambda r: r.piece_no)
            assert bool(mine) == (bool(limit) and len(ids) > limit)
            if mine:
                assert [r.piece_no for r in mine] == list(range(len(mine)))
                assert mine[0].start_token == 0 and mine[-1].end_token == len(ids) and max(r.n_tokens for r in mine) <= limit
                assert all(b.start_token == a.end_token - overlap and b.end_token > a.end_token for a, b in zip(mine, mine[1:]))
                assert all(r.over == (len(enc.encode_ordinary(r.text)) > limit) for r in mine)
                if "é" not in t and "🎉" not in t and "漢" not in t:
                    assert all(r.text == enc.decode(ids[r.start_token : r.end_token]) for r in mine)
            if profile not in ("odd", "one"):
                assert not any(r.over for r in mine)
    assert all(r.cut in ("sentence", "end") for r in got if r.doc_id == 0 and r.profile == "none")
    assert splitting.split_documents(df.limit(0), spark.createDataFrame(profiles, PROFILE)).count() == 0
    assert splitting.split_documents(df, spark.createDataFrame([], PROFILE)).count() == 0


def test_repeated_profiles_and_documents(spark):
    df = spark.createDataFrame([(1, "One two three. " * 30)] * 2, "doc_id bigint, text string")
    profiles = spark.createDataFrame([("p", 16, 4)] * 3, PROFILE)
    rows = [tuple(r) for r in splitting.split_documents(df, profiles).collect()]
    assert len(rows) == 6 * len(set(rows))
