"""Items to stories: normalisation on hand-made cases, first-come decisions against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import arrival, pipeline
from tidewire.streaming.ingest import first_seen_stream

ITEM = "item_id string, source_id string, title string, link string, description string, content string, author string, image_url string, categories array<string>, published_ms bigint, now_ms bigint, _h string"
NOW = 1_760_000_000_000


def test_normalisation(spark):
    title, link = "A headline that is long enough", "http://www.x.example/a?utm_source=q"
    rows = [
        ("ok", "s", f"<b>{title}</b>", link, "<p>Short.</p>", "<p>A longer body of text.</p>", "Ann", "http://x.example/p.jpg", ["a"], NOW - 5, NOW, "clash"),
        ("same", None, title, link, title.upper(), None, None, "https://x.example/logo.png", None, NOW + 1, NOW, None),
        ("future", "s", title, link, "Body.", "", None, None, None, NOW + 40 * 3_600_000, NOW, None), ("ancient", "s", title, link, "Body.", "", None, None, None, 0, NOW, None),
        ("long", "s", "word " * 100, link, "x " * 2000, None, None, None, None, None, NOW, None),
        ("short", "s", "Too short", link, "Body.", None, None, None, None, None, NOW, None), ("mail", "s", title, "mailto:a@b", "Body.", None, None, None, None, None, NOW, None),
        ("nulls", None, None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r.item_id: r for r in pipeline.normalized(spark.createDataFrame(rows, ITEM)).collect()}
    assert set(got) == {"ok", "same", "future", "ancient", "long"}
    ok = got["ok"]
    assert (ok.headline, ok.url, ok.summary, ok.excerpt, ok.image_url, ok.ms, ok.time_inferred) == (title, "https://x.example/a", "A longer body of text.", "A longer body of text.", "https://x.example/p.jpg", NOW - 5, False)
    assert (got["same"].summary, got["same"].excerpt, got["same"].image_url, got["same"].ms, got["same"].time_inferred) == (f"{title}. Full report at the source.", None, None, NOW, False)
    assert got["future"].time_inferred and got["ancient"].time_inferred and got["ancient"].ms == NOW
    assert len(got["long"].headline) <= 241 and len(got["long"].summary) <= 321 and 321 < len(got["long"].excerpt) <= 601
    assert pipeline.normalized(spark.createDataFrame([], ITEM)).count() == 0


def brute(stored, items):
    span = pipeline.HOURS * 3_600_000
    taken, out = list(stored), {}
    for arrival_no, name, s, u, t, h, ms in sorted(items, key=lambda r: (r[0], r[1])):
        near = lambda b: b[0] is not None and b[0] == s and ms is not None and b[4] is not None and abs(ms - b[4]) <= span  # noqa: B023, E731
        hit = any((u and u == b[1]) or (near(b) and ((t and t == b[2]) or (h and b[3] and (int(h, 16) ^ int(b[3], 16)).bit_count() <= 4))) for b in taken)
        out[name] = "duplicate" if hit else "created"
        if not hit:
            taken.append((s, u, t, h, ms))
    return out


@pytest.mark.parametrize("seed, few", [(1, 20_000), (2, 0), (3, 7)])
def test_new_items_are_taken_one_by_one(spark, monkeypatch, seed, few):
    monkeypatch.setattr(arrival, "FEW", few)
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(5)]

    def row():
        code = rng.choice(base)
        for _ in range(rng.randrange(6)):
            code ^= 1 << rng.randrange(64)
        return (
            rng.choice(["a", "a", "b", None]), rng.choice([None, f"{rng.randrange(80):064x}"]), rng.choice([None, f"{rng.randrange(40):032x}"]), rng.choice([None, f"{code:016x}"]),
            rng.choice([None, NOW + rng.randrange(400) * 3_600_000]),
        )

    stored, items = [row() for _ in range(30)], [(rng.randrange(60), f"i{k}", *row()) for k in range(80)]
    columns = "source_id string, url_hash string, title_key string, simhash string, ms bigint"
    got = pipeline.new_items(spark.createDataFrame(items, f"arrival_no bigint, item_id string, {columns}"), spark.createDataFrame(stored, columns)).collect()
    assert {r.item_id: r.status for r in got} == brute(stored, items) and len(got) == len(items)
    assert pipeline.new_items(spark.createDataFrame([], f"arrival_no bigint, item_id string, {columns}"), spark.createDataFrame(stored, columns)).count() == 0


def test_ledger_adds_up(spark):
    sf = "/root/testdata/sf0.001"
    rows = pipeline.run_ledger(spark, sf).collect()
    total = next(r for r in rows if r.is_total)
    assert total.n_seen == sum(r.n_seen for r in rows if not r.is_total) == spark.read.parquet(f"{sf}/raw_feed_item.parquet").count()
    assert all(r.n_seen == r.n_created + r.n_duplicate + r.n_rejected and r.n_rejected >= 0 for r in rows)
    stories = pipeline.ingested_stories(spark, sf)
    assert stories.count() == total.n_created == stories.select("url_hash").distinct().count()


def test_stream_keeps_late_rows(spark, tmp_path):
    for i, ms in enumerate((10_000_000_000_000, 5, 7)):
        spark.createDataFrame([(i // 2, ms)], "k int, ms bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ms bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert {r.k for r in first_seen_stream(stream, ["k"], ["ms"], str(tmp_path / "home")).select(F.col("k")).collect()} == {0, 1}
