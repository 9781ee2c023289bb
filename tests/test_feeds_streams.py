from pyspark.sql import functions as F

from tidewire.sources.feeds import parse_feeds
from tidewire.streaming.ingest import first_seen_stream

RSS = """<rss version="2.0" xmlns:dc="d" xmlns:media="m"><channel><title>T</title><item><title><![CDATA[One & two]]></title><link>/a</link><dc:creator>By Jane Doe</dc:creator>
<media:content url="https://x.example/p.jpg" medium="image"/><category>News</category><category>News</category><pubDate>Mon, 08 Sep 2025 02:00:00 GMT</pubDate><description>d&eacute;</description></item><item><title>No link</title></item></channel></rss>"""
ATOM = '<feed xmlns="a"><title>A</title><entry><title>Atom one</title><link rel="self" href="https://x.example/self"/><link rel="alternate" type="text/html" href="https://x.example/b"/><author><name>Ann</name></author><category term="World"/><published>2025-09-08T02:00:00Z</published><id>i1</id></entry></feed>'
RDF = '<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel><title>R</title></channel><item><title>Rdf one</title><link>https://x.example/c</link><dc:date>2025-09-08</dc:date></item></rdf:RDF>'


def test_three_dialects(spark):
    feeds = spark.createDataFrame([(1, RSS), (2, ATOM), (3, RDF), (4, "<html/>"), (5, None), (6, "no xml")], "n int, xml string").withColumn("base", F.lit("https://x.example/feed"))
    got = {r.n: r for r in parse_feeds(feeds, "xml", "base").collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].title, got[1].link, got[1].author, got[1].image_url, got[1].categories, got[1].description) == ("One & two", "https://x.example/a", "Jane Doe", "https://x.example/p.jpg", ["News"], "dé")
    assert (got[2].link, got[2].author, got[2].categories, got[2].guid) == ("https://x.example/b", "Ann", ["World"], "i1")
    assert (got[3].link, got[3].published_at) == ("https://x.example/c", "2025-09-08")


def test_stream_over_batches_is_the_batch(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(k, i * 10 + k) for k in range(i, i + 3)], "k int, ms int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ms int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.k: r.ms for r in first_seen_stream(stream, ["k"], ["ms"], str(tmp_path / "home")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 13, 4: 24}


def test_rarer_elements(spark):
    item = lambda x: f'<rss version="2.0" xmlns:media="m" xmlns:itunes="i" xmlns:feedburner="f"><channel><item><title>T</title>{x}</item></channel></rss>'
    rows = {
        "group": '<link>/a</link><media:group><media:content url="v.mp4" type="video/mp4"/><media:content url="../p.png"/></media:group><itunes:summary>Sum</itunes:summary>',
        "enclosure": '<link>?q=1</link><enclosure url="https://y.example/s.mp3" type="audio/mpeg"/><enclosure url="https://y.example/x" type="image/jpeg"/><body>B</body>',
        "image": "<feedburner:origLink>https://y.example/o</feedburner:origLink><image><url>https://y.example/i.webp?w=1</url></image><categories>One</categories>",
        "pixel": '<link>/b</link><description>&lt;img src="/pixel.gif"&gt; text</description><lastBuildDate>2025-01-01</lastBuildDate>',
        "html": '<link>/b</link><description>&lt;p&gt;&lt;img alt="" src=\'pics/a\'&gt;&lt;/p&gt;</description>',
    }
    feeds = spark.createDataFrame([(k, item(x)) for k, x in rows.items()], "n string, xml string").withColumn("base", F.lit("https://x.example/f/feed"))
    got = {r.n: r for r in parse_feeds(feeds, "xml", "base").collect()}
    assert {k: r.image_url for k, r in got.items()} == {"group": "https://x.example/p.png", "enclosure": "https://y.example/x", "image": "https://y.example/i.webp?w=1", "pixel": None, "html": "https://x.example/f/pics/a"}
    assert (got["group"].description, got["enclosure"].content, got["enclosure"].link) == ("Sum", "B", "https://x.example/f/feed?q=1")
    assert (got["image"].link, got["image"].categories, got["pixel"].published_at) == ("https://y.example/o", ["One"], "2025-01-01")
