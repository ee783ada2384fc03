"""Suffix rules (G16, C4), character references and hidden markup (H1, H2)."""

from pyspark.sql import functions as F

from shelfspark.functions import html as H
from shelfspark.functions.url import c_registered_domain
from shelfspark.operators import crawl

RULES = ["com", "uk", "co.uk", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "github.io", "io", "*.ck", "!www.ck", "Net "]
GOLD = {"www.shop.com": "shop.com", "shop.com": "shop.com", "com": None, "a.b.co.uk": "b.co.uk", "co.uk": None, "x.kawasaki.jp": None,
        "a.x.kawasaki.jp": "a.x.kawasaki.jp", "deep.a.x.kawasaki.jp": "a.x.kawasaki.jp", "city.kawasaki.jp": "city.kawasaki.jp", "www.city.kawasaki.jp": "city.kawasaki.jp",
        "kawasaki.jp": "kawasaki.jp", "me.github.io": "me.github.io", "www.me.github.io": "me.github.io", "github.io": None, "other.io": "other.io",
        "www.ck": "www.ck", "b.ck": None, "a.b.ck": "a.b.ck", "10.0.0.1": None, "192.168.0.1": None, "10.0.0.1:8080": None, "[::1]": None, "shop.unknown": None,
        "Shop.COM:8080": "shop.com", "user@shop.com": "shop.com", "shop.com.": "shop.com", "a.net": "a.net", "localhost": None, "": None, None: None}


def test_registered_domain_by_rules(spark):
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    df = spark.createDataFrame([(h, i, "clash") for i, h in enumerate(GOLD)] * 2, "host string, n int, registered_domain string")
    out = crawl.with_registered_domain(df, "host", rules)
    assert out.count() == 2 * len(GOLD) and {r.host: r.registered_domain for r in out.collect()} == GOLD
    assert [c for c in out.columns if c.startswith("_")] == []


def test_addresses_have_no_domain(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("192.168.0.1",), ("[2001:db8::1]",), ("1.2.3.4.example.com",)], "h string")
    assert [r[0] for r in df.select(c_registered_domain("h")).collect()] == [None, None, None, "example.com"]


def test_scope_by_rules(spark):
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    seeds = spark.createDataFrame([(["me.github.io", "shop.co.uk", "10.0.0.1"],)], "domains array<string>")
    links = spark.createDataFrame([("https://me.github.io/x", "me.github.io"), ("https://you.github.io/x", "me.github.io"), ("https://www.shop.co.uk/", "shop.co.uk"),
                                   ("https://shop.co.uk/", "me.github.io"), ("https://10.0.0.1/", None), ("https://192.168.0.1/", None), ("ftp://shop.co.uk/", None),
                                   ("https://shop.co.uk/y", None)], "link string, seed_domain string")
    got = {r.link for r in crawl.in_scope(links, seeds, rules=rules).collect()}
    assert got == {"https://me.github.io/x", "https://www.shop.co.uk/", "https://shop.co.uk/y"}


def test_character_references(spark):
    gold = {"a &amp; b": "a & b", "&amp;lt;": "&lt;", "caf&eacute; &euro;5": "café €5", "&#8217;&#x2019;&#X1F600;": "’’😀", "&nosuch; &lt": "&nosuch; &lt", "&#0;&#xD800;&#99999999;": "���",
            "&quot;&apos;&#39;": "\"''", "x&nbsp;y": "x\u00a0y", "&&amp;&": "&&&", "plain": "plain", "": "", "&#65;": "A", "&Alpha;&alpha;": "Αα"}
    df = spark.createDataFrame([(k,) for k in gold], "c string")
    assert {r.c: r.d for r in df.select("c", H.c_unescape(F.col("c")).alias("d")).collect()} == gold


def test_hidden_markup_is_not_read(spark):
    page = ('<!-- <title>old</title><meta name="description" content="old"><script type="application/ld+json">{"old":1}</script> -->'
            '<script>var t = "<title>made</title>";</script><title>Real &eacute;</title><meta name="description" content="a &#8211; b">'
            '<script type="application/ld+json">{"new":1}</script><!-- open <title>late</title>')
    r = spark.createDataFrame([(page,), (None,)], "html string").select(
        H.c_title(F.col("html")), H.c_meta(F.col("html"), "name", "description"), H.c_json_ld(F.col("html"))).collect()
    assert tuple(r[0]) == ("Real é", "a – b", ['{"new":1}']) and tuple(r[1]) == ("", "", [])
