"""Extraction round trip, crawl levels on a toy site, stream = batch with replay, driver contract."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF0001, SF001
from shelfspark import fixtures as fx
from shelfspark.operators import crawl, extract
from shelfspark.plans import backtest as bt
from shelfspark.plans import scrape
from shelfspark.sources import readers
from shelfspark.sources.snapshots import Snapshots
from shelfspark.streaming import feed


def product_page(name, brand, price, ld=True):
    ld_block = json.dumps({"@context": "https://schema.org", "@type": "Product", "name": name,
                           "brand": {"@type": "Brand", "name": brand}, "sku": "SKU1", "model": "MX-1",
                           "offers": [{"price": price, "priceCurrency": "INR", "availability": "InStock"}],
                           "aggregateRating": {"ratingValue": "4.5", "reviewCount": "120"}})
    return (f"<html><head><title>{name} | Shop</title><meta name='description' content='Buy {name} now'>"
            f"<meta property='og:title' content='OG {name}'>"
            + (f"<script type='application/ld+json'>{ld_block}</script>" if ld else "") +
            f"</head><body><div class='a-breadcrumb'><a>Home</a><a>Phones</a></div>"
            f"<h1 id='productTitle'> {name} </h1><a id='bylineInfo'>{brand}</a>"
            f"<span class='a-price'><span class='a-offscreen'>₹{price}</span></span>"
            f"<div id='feature-bullets'><ul><li>8GB RAM</li><li> Fast &amp; light </li></ul></div>"
            f"<table class='a-keyvalue'><tr><th>Colour</th><td>Black</td></tr><tr><th>Colour</th><td>Blue</td></tr></table>"
            f"<img itemprop='image' src='https://img/1.jpg'><img itemprop='image' src='/rel.jpg'>"
            f"<a href='/next?page=2' rel='next'>next</a><a href='mailto:x@y'>m</a><a href='#top'>t</a>"
            f"</body></html>")


def test_extract_one_product(spark):
    html = product_page("Galaxy S24", "Samsung", 74999)
    x = extract.extract_one(html)
    assert x["dom_product_name"] == "Galaxy S24" and x["breadcrumbs"] == ["Home", "Phones"]
    assert x["bullet_points"] == ["8GB RAM", "Fast & light"]
    assert x["dom_price"] == "₹74999" and x["specs"] == {"Colour": "Blue"} and x["images"] == ["https://img/1.jpg"]
    page = spark.createDataFrame([(1, "https://shop.example.com/p/1#frag", html)], "page_id long, url string, html string")
    r = extract.extracted_table(page).first()
    # a fragment alone is the page itself
    assert r.links == ["https://shop.example.com/next?page=2", "https://shop.example.com/p/1"]
    assert r.meta_description == "Buy Galaxy S24 now" and r.og_title == "OG Galaxy S24" and r.og_image == ""
    assert r.page_title == "Galaxy S24 | Shop" and r.rel_next == "https://shop.example.com/next?page=2" and len(r.json_ld) == 1


def test_links_resolve_as_urljoin(spark):
    bases = ["https://Shop.example.com/a/b/c?q=1#f", "http://x.org", "https://x.org/a/", "https://x.org/a?b/c"]
    hrefs = ["d", "./d", "../d", "../../../d", "/d/./e/../f", "//Other.org/p", "?z=2", "#top", "HTTPS://Y.org/Q?r#s", "d/..", "mailto:a@b", "javascript:x()", "e;p=1?x=&y", "  /trim  "]
    rows = [(b, "".join(f"<a class='k' href='{h}'>t</a>" for h in hrefs)) for b in bases]
    from urllib.parse import urldefrag, urljoin, urlsplit
    for r in crawl.extract_links(spark.createDataFrame(rows, "url string, html string")).collect():
        want = []
        for h in hrefs:
            u = urlsplit(urldefrag(urljoin(r.url, h.strip()))[0])
            if u.scheme in ("http", "https"):
                want.append(u._replace(netloc=u.netloc.lower()).geturl())
        assert r.links == list(dict.fromkeys(want))


def test_markup_that_is_no_link(spark):
    html = ("<!-- <a href='/no1'> --><script>var s = \"<a href='/no2'>\";</script><style>a[href='/no3']{}</style><abbr href='/no4'>"
            "<a data-href='/no5' HREF=/yes1>1</a><A title='>' href=\"/yes2?a=1&amp;b=2\">2</A><a href='http://[bad'>3</a><a>4</a>")
    r = crawl.extract_links(spark.createDataFrame([("https://x.org/", html), (None, None), ("", "")], "url string, html string")).collect()
    assert r[0].links[:2] == ["https://x.org/yes1", "https://x.org/yes2?a=1&b=2"] and not any("no" in u for u in r[0].links)
    assert r[1].links == r[2].links == [] and r[1].rel_next == ""


def test_rel_next_prefers_link(spark):
    html = "<a rel='next' href='/a2'>n</a><link rel='prefetch next' href='/l2'>"
    df = spark.createDataFrame([("https://x.org/", html), ("https://x.org/", "<a rel=next href='p?page=2'>n</a>")], "url string, html string")
    assert [r.rel_next for r in crawl.extract_links(df).collect()] == ["https://x.org/l2", "https://x.org/p?page=2"]


def test_page_numbers_that_are_too_long(spark):
    urls = ["https://x.org/?page=99999999999999999999", "https://x.org/?page=99999999999999999999&p=4", "https://x.org/page/99999999999999999999/",
            "https://x.org/?page=9223372036854775807", "https://x.org/page/7/"]
    df = spark.createDataFrame([(u, "", 0, 4, "category_page") for u in urls], "url string, rel_next string, depth int, max_depth int, page_type string")
    got = [r[0] for r in df.select(crawl.next_page()).collect()]
    assert got == [None, "https://x.org/?page=99999999999999999999&p=5", None, None, "https://x.org/page/8/"]


def test_one_bad_page_does_not_end_the_job(spark):
    deep = "<div>" * 3000 + "<table class='a-keyvalue'><tr><th>a</th><td>b</td></tr></table>" + "</div>" * 3000
    rank = "<li class='zg-grid-general-faceout'><span class='zg-bdg-text'>#99999999999999999999999</span><span class='p13n-sc-truncated'>N</span></li>"
    pages = spark.createDataFrame([(1, "https://x.org/product/1", deep), (2, "http://[bad", "<a href='http://[worse'>"), (3, "https://x.org/bestseller/", rank), (4, None, None)],
                                  "page_id long, url string, html string")
    rows = {r.page_id: r for r in scrape.parse_pages(scrape.pages_with_hints(pages)).collect()}
    assert len(rows) == 4 and rows[1].specs == {"a": "b"} and rows[3].trend_items[0].rank == 1


def test_objects_without_a_name(spark):
    ld = lambda brand: "<script type='application/ld+json'>" + json.dumps([{"@type": "Product", "name": "N", "brand": brand}]) + "</script>"
    pages = spark.createDataFrame([(i, f"https://x.org/product/{i}", ld(b)) for i, b in enumerate([{"@type": "Brand"}, {"name": "B"}, "Plain", None, 5])],
                                  "page_id long, url string, html string")
    rows = scrape.parse_pages(scrape.pages_with_hints(pages)).orderBy("page_id").collect()
    assert [r.brand for r in rows] == ["", "B", "Plain", "", ""] and {r.product_name for r in rows} == {"N"}


def test_scrape_round_trip_from_part(spark):
    part = fx.table(spark, SF0001, "part").limit(20).collect()
    rows = [(p.p_partkey, f"https://shop.example.com/product/{p.p_partkey}",
             product_page(p.p_name, p.p_brand, int(p.p_retailprice), ld=p.p_partkey % 2 == 0)) for p in part]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    parsed = scrape.parse_pages(scrape.pages_with_hints(pages))
    prods = {r.url: r for r in scrape.product_records(parsed).collect()}
    assert len(prods) == len(part)
    for p in part:
        r = prods[f"https://shop.example.com/product/{p.p_partkey}"]
        assert r.product_name == p.p_name and r.brand == p.p_brand
        assert r.price.amount == float(int(p.p_retailprice))
        if p.p_partkey % 2 == 0:     # JSON-LD present: its fields win
            assert r.sku_hint == "SKU1" and r.model_number == "MX-1" and r.rating.value == 4.5
            assert r.rating["count"] is None   # a bare JSON-LD count needs accept_bare (quirk Q14)
        else:                        # DOM fallbacks only
            assert r.sku_hint == "" and r.price.currency == "INR"
        assert r.bullet_points == ["8GB RAM", "Fast & light"]
        assert json.loads(r.extra["specs"]) == {"Colour": "Blue"}


def test_review_and_trend_records(spark):
    review_html = ("<html><body>" + "".join(
        f"<div data-hook='review'><span data-hook='review-author'>A{i}</span>"
        f"<i data-hook='review-star-rating'><span class='a-icon-alt'>{i}.0 out of 5 stars</span></i>"
        f"<span data-hook='review-body'>Body {i}</span><span data-hook='avp-badge'>Verified</span></div>"
        for i in (4, 5)) + "</body></html>")
    trend_html = ("<html><body><ol>" + "".join(
        f"<li class='zg-grid-general-faceout'><span class='zg-bdg-text'>#{i}</span>"
        f"<span class='p13n-sc-truncated'>{'' if i == 2 else f'Item {i}'}</span><a href='/i{i}'>x</a></li>"
        for i in (1, 2, 3)) + "</ol></body></html>")
    pages = spark.createDataFrame([(1, "https://s.example.com/reviews/1", review_html),
                                   (2, "https://s.example.com/bestseller/", trend_html)],
                                  "page_id long, url string, html string")
    parsed = scrape.parse_pages(scrape.pages_with_hints(pages))
    revs = sorted(scrape.review_records(parsed).collect(), key=lambda r: r.reviewer_name)
    assert [(r.reviewer_name, r.rating.value, r.verified_purchase) for r in revs] == [("A4", 4.0, True), ("A5", 5.0, True)]
    trends = sorted(scrape.trend_records(parsed).collect(), key=lambda r: r.rank)
    assert [(r.rank, r.product_name) for r in trends] == [(1, "Item 1"), (3, "Item 3")]   # nameless item dropped
    out = {r.output for r in scrape.records_by_output(parsed).collect()}
    assert out == {"reviews", "trends"}


def _toy_site(spark):
    h = "https://toy.example.com"
    pages = {
        f"{h}/": ["/category/phones", "/about", "https://other.example.org/x", "/logo.png"],
        f"{h}/category/phones": ["/product/a", "/product/b", "/category/phones?page=2"],
        f"{h}/product/a": ["/reviews/a", "/product/b"],
        f"{h}/about": [],
    }
    rows = [(u, "<html><body>" + "".join(f"<a href='{l}'>x</a>" for l in links) + "</body></html>")
            for u, links in pages.items()]
    return spark.createDataFrame(rows, "url string, html string")


def test_crawl_levels(spark):
    pages = _toy_site(spark)
    links = crawl.extract_links(pages)
    seeds = spark.createDataFrame([(["toy.example.com"],)], "domains array<string>")
    frontier = spark.createDataFrame([("https://toy.example.com/", "phones", "toy.example.com",
                                       "https://toy.example.com/", 0, 3, None, None)],
                                     "url string, seed_category string, seed_domain string, origin_url string, "
                                     "depth int, max_depth int, parent_url string, product_hint string")
    allreq = crawl.crawl_plan(frontier, links, seeds)
    got = {r.url: (r.depth, r.page_type, r.parent_url) for r in allreq.collect()}
    h = "https://toy.example.com"
    assert got[f"{h}/category/phones"] == (1, "category_page", f"{h}/")
    assert got[f"{h}/product/a"][0] == 2 and got[f"{h}/product/a"][2] == f"{h}/"
    assert f"https://other.example.org/x" not in got and f"{h}/logo.png" not in got
    assert f"{h}/reviews/a" not in got            # would be depth 3 = max depth: gated
    assert sum(1 for u in got if u == f"{h}/product/b") == 1


def test_cap_and_hint(spark):
    cands = spark.createDataFrame([(f"https://d.com/x{i}", "d.com", "product_page" if i % 2 else "unknown")
                                   for i in range(10)], "url string, seed_domain string, page_type string")
    already = spark.createDataFrame([("d.com", 2)], "seed_domain string, enqueued long")
    kept = crawl.cap_per_domain(cands, already, cap=5).collect()
    assert len(kept) == 3 and all(r.page_type == "product_page" for r in kept)
    kw = spark.createDataFrame([("S24", 0, 0, "galaxy-s24"), ("galaxy", 0, 1, "galaxy-s24"), ("pixel", 1, 0, "pixel-8")],
                               "keyword string, product_ord int, kw_ord int, model_id string")
    urls = spark.createDataFrame([("https://x.com/Galaxy-S24-Ultra", None), ("https://x.com/pixel", "kept"),
                                  ("https://x.com/none", None)], "url string, product_hint string")
    hints = {r.url: r.product_hint for r in crawl.product_hint(urls, kw).collect()}
    assert hints == {"https://x.com/Galaxy-S24-Ultra": "galaxy-s24", "https://x.com/pixel": "kept",
                     "https://x.com/none": None}


def test_stream_equals_batch_and_replay(spark, tmpdir_path):
    a = fx.actuals(spark, SF0001)
    dates = sorted(r.date for r in a.select("date").distinct().collect())[:6]
    feed_dir, state = os.path.join(tmpdir_path, "feed"), os.path.join(tmpdir_path, "state")
    for d in dates:                                   # files arrive one day at a time
        a.filter(F.col("date") == d).select(*[f.name for f in feed.ACTUALS_STREAM_SCHEMA.fields]) \
            .coalesce(1).write.mode("append").parquet(feed_dir)
    feed.run_tick_stream(spark, feed_dir, state, os.path.join(tmpdir_path, "ck1"), max_files_per_trigger=1)
    sub = a.filter(F.col("date").isin(dates))
    want = sorted(map(tuple, bt.backtest(sub)["fva"].collect()), key=repr)
    got = sorted(map(tuple, spark.read.parquet(f"{state}/fva").select(*bt.panel.FVA_COLS).collect()), key=repr)
    assert got == want
    days1 = sorted(map(tuple, spark.read.parquet(f"{state}/days").select("sim_day", "date", "model_version").collect()))
    # a retried batch (same id, same input) rewrites the same rows
    last = a.filter(F.col("date") == dates[-1]).select(*[f.name for f in feed.ACTUALS_STREAM_SCHEMA.fields])
    feed.Tick(state)(last, len(dates) - 1)
    feed.Tick(state).flush(spark)
    # and so does replaying every batch with a fresh checkpoint (a new run, whose commits replace the old ones)
    feed.run_tick_stream(spark, feed_dir, state, os.path.join(tmpdir_path, "ck2"), max_files_per_trigger=2)
    store = Snapshots(spark, state)
    got2 = sorted(map(tuple, store.table("fva").select(*bt.panel.FVA_COLS).collect()), key=repr)
    days2 = sorted(map(tuple, store.table("days").select("sim_day", "date", "model_version").collect()))
    assert got2 == want and days2 == days1


def test_dates_over_many_files_and_a_uri_state(spark, tmpdir_path):
    """One file a trigger, four files a date in no order, state under a file:// folder."""
    a = fx.actuals(spark, SF0001)
    dates = sorted(r.date for r in a.select("date").distinct().collect())[:4]
    sub = a.filter(F.col("date").isin(dates))
    cols = [f.name for f in feed.ACTUALS_STREAM_SCHEMA.fields]
    feed_dir, state, manifest = (f"file://{tmpdir_path}/{n}" for n in ("feed", "state", "manifest"))
    for d in (dates[0], dates[2], dates[1], dates[3]):        # a later day is written first
        sub.filter(F.col("date") == d).select(*cols).repartition(4).write.mode("append").parquet(feed_dir)
    sub.groupBy("date").agg(F.count(F.lit(1)).alias("rows")).write.parquet(manifest)
    feed.run_tick_stream(spark, feed_dir, state, max_files_per_trigger=1, manifest=manifest)
    want = bt.backtest(sub)
    for name, keys in (("fva", bt.panel.FVA_COLS), ("days", ["sim_day", "date", "rows_ingested", "drift_score", "retrained", "model_version"])):
        got = sorted(map(tuple, spark.read.parquet(f"{state}/{name}").select(*keys).collect()), key=repr)
        assert got == sorted(map(tuple, want[name].select(*keys).collect()), key=repr)
    assert readers.read_if_any(spark, f"{state}/late") is None


def test_an_incomplete_date_waits(spark, tmpdir_path):
    a = fx.actuals(spark, SF0001)
    dates = sorted(r.date for r in a.select("date").distinct().collect())[:2]
    cols = [f.name for f in feed.ACTUALS_STREAM_SCHEMA.fields]
    feed_dir, state, manifest, ck = (os.path.join(tmpdir_path, n) for n in ("feed", "state", "manifest", "ck"))
    sub = a.filter(F.col("date").isin(dates)).select(*cols)
    sub.groupBy("date").agg(F.count(F.lit(1)).alias("rows")).write.parquet(manifest)
    first = sub.filter((F.col("date") == dates[1]) | (F.col("entity_id") % 2 == 0))
    first.coalesce(1).write.mode("append").parquet(feed_dir)
    feed.run_tick_stream(spark, feed_dir, state, ck, manifest=manifest)
    assert readers.read_if_any(spark, f"{state}/days") is None
    sub.subtract(first).coalesce(1).write.mode("append").parquet(feed_dir)
    feed.run_tick_stream(spark, feed_dir, state, ck, manifest=manifest)
    assert [r.sim_day for r in spark.read.parquet(f"{state}/days").orderBy("date").collect()] == [1, 2]


def test_late_rows_go_to_late_table(spark, tmpdir_path):
    a = fx.actuals(spark, SF0001)
    dates = sorted(r.date for r in a.select("date").distinct().collect())[:3]
    feed_dir, state = os.path.join(tmpdir_path, "feed"), os.path.join(tmpdir_path, "state")
    cols = [f.name for f in feed.ACTUALS_STREAM_SCHEMA.fields]
    for d in (dates[0], dates[1], dates[2], dates[0]):         # dates[0] comes again after dates[1] has closed it
        a.filter(F.col("date") == d).select(*cols).coalesce(1).write.mode("append").parquet(feed_dir)
    feed.run_tick_stream(spark, feed_dir, state, os.path.join(tmpdir_path, "ck"), max_files_per_trigger=1)
    late = spark.read.parquet(f"{state}/late").select("date").distinct().collect()
    assert [r.date for r in late] == [dates[0]]
    assert spark.read.parquet(f"{state}/days").count() == 3


def test_daily_summary_over_many_batches(spark, tmpdir_path):
    ev = fx.table(spark, SF0001, "events")
    ev.repartition(5).write.parquet(f"{tmpdir_path}/ev")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmpdir_path}/ev")
    got = feed.run_to_latest(feed.daily_event_summary(stream)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, feed.daily_event_summary(ev).collect())) and len(got) == 30


def test_driver_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "top_brand" in df.columns
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs) and len(qs) >= 60


def test_oracles_small(spark):
    """A handful of registered queries against their DuckDB SQL at sf0.001."""
    import oracle_check as oc
    import __spark_entry__ as E
    con = oc.duck(SF0001)
    for name in ("category_summary", "backtest_fva", "dedup_products", "frontier_level", "page_titles"):
        msg = oc.compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF0001)
        assert msg.startswith("OK"), msg
    _ = SF001


def test_quirk_options(spark):
    # Q15 / Q14: JSON-LD currency and bare counts only on request
    html = product_page("Pixel 8", "Google", 500).replace('"priceCurrency": "INR"', '"priceCurrency": "usd"')
    pages = spark.createDataFrame([(1, "https://shop.example.com/product/1", html)], "page_id long, url string, html string")
    parsed = scrape.parse_pages(scrape.pages_with_hints(pages))
    default = scrape.product_records(parsed).first()
    fixed = scrape.product_records(parsed, use_ld_currency=True, accept_bare_count=True).first()
    assert (default.price.currency, default.rating["count"]) == ("INR", None)
    assert (fixed.price.currency, fixed.rating["count"]) == ("USD", 120)
    # Q17: with html_scope="parent" an unknown link takes the parent page's HTML type
    site = spark.createDataFrame([("https://t.example.com/", "<a href='/x'>a</a> add to cart")], "url string, html string")
    links = crawl.extract_links(site)
    seeds = spark.createDataFrame([(["t.example.com"],)], "domains array<string>")
    fr = spark.createDataFrame([("https://t.example.com/", "c", "t.example.com", "https://t.example.com/", 0, 3, None, None)],
                               "url string, seed_category string, seed_domain string, origin_url string, depth int, "
                               "max_depth int, parent_url string, product_hint string")
    own = crawl.expand_level(fr, links, seeds, fr.select("url")).first().page_type
    parent = crawl.expand_level(fr, links, seeds, fr.select("url"), html_scope="parent").first().page_type
    assert (own, parent) == ("unknown", "product_page")
