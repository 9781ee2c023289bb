from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import formats, urls
from tidewire.functions.text import decode_entities, hamming_hex, html_to_text, says_nothing, simhash_hex, single_line, title_key, with_line_key
from tidewire.operators.components import components
from tidewire.operators.similarity import find_duplicates, replay
from tidewire.session import drop_written, prefix_sum, shared_dir, written


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_entities_in_one_pass(spark):
    r = one(spark, *[decode_entities(F.lit(x)) for x in ("&#38;amp;", "&eacute;&#x1F600;", "&#0;&#xD800;&nope;", "a & b")])
    assert tuple(r) == ("&amp;", "é😀", "&#0;&#xD800;&nope;", "a & b")


def test_html_to_text(spark):
    html = "<script>x</script><p>One&nbsp;&amp; two</p><p>Three<br>four</p><!-- c -->\r\n Read more"
    assert one(spark, html_to_text(F.lit(html)))[0] == "One & two\nThree\nfour"
    assert tuple(one(spark, html_to_text(F.lit(None).cast("string")), single_line(F.lit("a   b\n c")))) == ("", "a b c")


def test_fingerprints(spark):
    a, b = "CBN raises benchmark interest rate to 27 per cent", "CBN raises benchmark interest rate to 27 percent"
    r = one(spark, title_key(F.lit(a)), title_key(F.lit(b)), simhash_hex(F.lit(a)), simhash_hex(F.lit("the of")))
    assert tuple(r) == ("2503964c166cfcbbd5e969b5f8ced525", "d15439a2cee1ae53565e744d116dbaaa", "2584618f263dce18", "0" * 16)
    assert tuple(one(spark, hamming_hex(F.lit("0xFF00000000000000"), F.lit("fe00000000000000")), hamming_hex(F.lit(None).cast("string"), F.lit("00")))) == (1, 64)


def test_urls(spark):
    cases = {
        "http://WWW.Example.com:80//a//b/amp/?utm_source=x&b=2&a=1 2&a=0#top": "https://example.com/a/b?a=1+2&a=0&b=2",
        "https://user:pw@example.com": "https://example.com/", "mailto:a@b": "", " not a url ": "not a url", "": "", "https://example.com:8443/x.amp": "https://example.com:8443/x",
    }
    got = one(spark, *[urls.normalize_url(F.lit(x)) for x in cases])
    assert list(got) == list(cases.values())
    r = one(spark, urls.resolve_url(F.lit("/b"), F.lit("https://x.example/a/c")), urls.resolve_url(F.lit("d"), F.lit("https://x.example/a/c")), urls.resolve_url(F.lit("//y/z"), F.lit("q")), urls.resolve_url(F.lit("d"), F.lit("q")))
    assert tuple(r) == ("https://x.example/b", "https://x.example/a/d", "https://y/z", "")
    cases = {
        "../d": "https://x.example/d", "../../../d?x=1#y": "https://x.example/d?x=1#y", "./e/../f": "https://x.example/a/f", "..": "https://x.example/", ".": "https://x.example/a/", "?q=2": "https://x.example/a/c?q=2", "#z": "https://x.example/a/c?p=1#z",
        "/g/./h": "https://x.example/g/h", "mailto:a@b": "", "HTTP://Y.example/..": "HTTP://Y.example/..",
    }
    assert list(one(spark, *[urls.resolve_url(F.lit(x), F.lit("https://x.example/a/c?p=1#q")) for x in cases])) == list(cases.values())
    assert one(spark, urls.resolve_url(F.lit("?a"), F.lit("https://x.example")))[0] == "https://x.example/?a"


def test_formats(spark):
    r = one(spark, formats.truncate(F.lit("hello world foo bar"), 12), formats.format_count(F.lit(1000)), formats.format_count(F.lit(12345)), formats.relative_time(F.lit(0), 90_000_000), formats.slugify(F.lit("Café’s n’est-ce pas?")))
    assert tuple(r) == ("hello world…", "1.0k", "12k", "yesterday", "cafes-nest-ce-pas")
    assert one(spark, formats.extractive_summary(F.lit("One two three four. " * 40), 100))[0] == ("One two three four. " * 5).strip()


def test_no_value_and_line_keys(spark):
    r = one(spark, *[says_nothing(F.lit(x)) for x in (" N/A ", "", "x")], says_nothing(F.lit(None).cast("string")))
    assert tuple(r) == (True, True, False, True)
    df = with_line_key(spark.createDataFrame([("<p>Sign&nbsp; UP  at 12:30</p>\r",), ("sign up at 7:5 ",)], "line string"), "line", "k")
    assert {x.k for x in df.collect()} == {"sign up at #:#"}


def test_prefix_sum_with_one_large_group(spark):
    rows = [("a" if i % 3 else "b", i, i % 7) for i in range(500)]
    got = prefix_sum(spark.createDataFrame(rows, "g string, k int, v int"), ["g"], ["k"], "v", "s", "t").collect()
    want, run = {}, {}
    for g, k, v in rows:
        run[g] = run.get(g, 0) + v
        want[g, k] = run[g]
    assert {(r.g, r.k): r.s for r in got} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == got[101] == 100


def test_replay_needs_the_lead():
    hour = 3_600_000
    times = [0, hour, 2 * hour, 200 * hour]
    links = {"b": {"a": 0.7}, "c": {"b": 0.9}, "d": {"c": 1.0}}
    assert replay(list("abcd"), times, links) == {"a": "a", "b": "a", "c": "c", "d": "d"}  # c does not match the lead a; d is out of the band


def test_duplicate_rules_in_order(spark):
    schema = "id string, source_id string, url_hash string, title_key string, simhash string, fetched_at timestamp"
    t0, t1 = datetime(2025, 1, 1), datetime(2025, 1, 4)
    stored = spark.createDataFrame([("s1", "x", "u1", "t1", "0" * 16, t0), ("s2", "x", "u2", "t2", "f" * 16, t0)], schema)
    new = spark.createDataFrame([("n1", "y", "u1", "t9", None, t1), ("n2", "x", "u9", "t2", "0" * 16, t1), ("n3", "x", "u8", "t8", "0" * 15 + "f", t1), ("n4", "y", "u7", "t1", "0" * 16, t1), ("n5", None, None, None, None, None)], schema)
    got = {r.id: (r.matched_id, r.rule) for r in find_duplicates(new, stored).collect()}
    assert got["n1"] == ("s1", 1) and got["n2"][1] in (2, 3) and got["n3"] == ("s1", 3) and "n4" not in got and "n5" not in got


def test_shared_folder_and_intermediates(spark):
    path = written(spark.range(3), "three").inputFiles()[0]
    assert path.startswith("file:") and drop_written(spark) >= 1
    assert not spark._jvm.java.io.File(path[len("file:"):].replace("//", "/")).exists()

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        shared_dir(Cluster())


def test_simhash_of_long_lists(spark):
    # every bit by itself, and four counts in one number, give the same
    import hashlib

    words = [f"word{i % 700}" for i in range(16_000)]
    for ws in (words, words[:900], ["one"]):
        votes = [0] * 64
        for f, w in [(x, 1) for x in ws] + [(f"{a}_{b}", 2) for a, b in zip(ws, ws[1:])]:
            h = int.from_bytes(hashlib.md5(f.encode()).digest()[:8], "big")
            for i in range(64):
                votes[i] += w if h >> i & 1 else -w
        want = sum(1 << i for i in range(64) if votes[i] > 0)
        assert one(spark, simhash_hex(F.lit(" ".join(ws))))[0] == f"{want:016x}"
