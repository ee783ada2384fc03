"""Gold rows for the scalar functions (worked out by reading the reference; FIXTURES.md §5)."""

from pyspark.sql import functions as F

from shelfspark.functions import classify as cl
from shelfspark.functions import numeric, parse, sku, text, url


def one(spark, col, data, schema="x string"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col.alias("y")).collect()]


def test_price(spark):
    rows = spark.createDataFrame([("₹1,49,999",), ("$1,299.99",), ("1.299,99",), ("",), ("free",), ("US$1,299",),
                                  ("Rs. 1299",)], "x string") \
        .select(parse.c_price("x").alias("p")).collect()
    got = [(r.p.amount, r.p.currency) for r in rows]
    assert got == [(149999.0, "INR"), (1299.99, "USD"), (1.29, "INR"), (None, "INR"), (None, "INR"),
                   (1299.0, "USD"), (1299.0, "INR")]


def test_rating(spark):
    got = one(spark, parse.c_rating("x"), [("4.2 out of 5 stars",), ("8.4/10",), ("84%",), ("8.4",), ("500%",),
                                            ("",), ("3/0",), ("7",)])
    assert got == [4.2, 4.2, 4.2, 4.2, 25.0, None, None, 3.5]


def test_rating_count(spark):
    assert one(spark, parse.c_rating_count("x"), [("(1,234 ratings)",), ("1234",), ("56 reviews",)]) == [1234, None, 56]
    assert one(spark, parse.c_rating_count("x", accept_bare=True), [("1234",)]) == [1234]


def test_normalize_url(spark):
    got = one(spark, url.c_normalize_url("x"), [("HTTPS://Shop.COM/A/?utm_source=x&b=2&c=#f",),
                                                 ("http://x.com/p?a=1&b=&a=3&LinkCode=q",),
                                                 ("https://x.com/p?q=a+b%20c&z=~*",), ("",)])
    assert got == ["https://shop.com/a?b=2", "http://x.com/p?a=1&a=3", "https://x.com/p?q=a+b+c&z=~%2A", ""]
    # the staged form gives the same strings
    df = spark.createDataFrame([("HTTPS://Shop.COM/A/?utm_source=x&b=2&c=#f",), ("http://x.com/p?x=1&y=2&x=3",)], "x string")
    assert [r.n for r in url.with_normalized_url(df, "x", "n").collect()] == \
        [r.n for r in df.select(url.c_normalize_url("x").alias("n")).collect()]


def test_url_fp(spark):
    import hashlib
    got = one(spark, url.c_url_fp("x"), [("https://shop.com/a/?utm_source=1",)])
    assert got == [hashlib.sha256(b"https://shop.com/a").hexdigest()[:16]]


def test_slug(spark):
    assert one(spark, text.c_slug("x"), [(" Galaxy S24 (Ultra)! ",)]) == ["galaxy-s24-ultra"]


def test_brand(spark):
    df = spark.createDataFrame([("", "Redmi Note 13"), ("Acme Co", "X"), ("", ""), ("Samsung", "Galaxy")], "b string, n string")
    assert [r[0] for r in df.select(sku.c_brand("b", "n")).collect()] == ["xiaomi", "acme-co", "unknown", "samsung"]


def test_sku_id(spark):
    df = spark.createDataFrame([("Samsung", "", "Samsung Galaxy S24 8GB 256GB Black")], "b string, m string, n string")
    r = df.select(sku.c_brand("b", "n").alias("b2"), sku.c_model("b", "m", "n").alias("m2"),
                  sku.c_variant("n", F.lit(""), F.array().cast("array<string>")).alias("v")).first()
    assert (r.b2, r.m2, r.v) == ("samsung", "galaxy-s24", "8gb-256gb-black")
    assert spark.range(1).select(sku.c_sku_id(F.lit(r.b2), F.lit(r.m2), F.lit(r.v))).first()[0] == \
        "samsung:galaxy-s24:8gb-256gb-black"
    assert spark.range(1).select(sku.c_sku_id(F.lit("a"), F.lit(""), F.lit("c"))).first()[0] == "a:c"


def test_field_fp_half_even(spark):
    import hashlib
    got = spark.createDataFrame([("B", "Name", "", 2.5, "Cat")], "b string, n string, m string, p double, c string") \
        .select(sku.c_field_fp("b", "n", "m", "p", "c")).first()[0]
    assert got == hashlib.sha256(b"b|name|cat|2").hexdigest()[:16]


def test_page_type(spark):
    got = one(spark, cl.c_page_type_url("x"), [("https://x.com/product/abc",), ("https://x.com/reviews/1",),
                                                ("https://x.com/about",), ("https://www.amazon.in/dp/B0ABCDEFGH",),
                                                ("https://x.com/customer-reviews/",)])
    assert got == ["product_page", "review_page", "unknown", "product_page", "unknown"]
    df = spark.createDataFrame([("https://x.com/a", "<b>Add to Cart</b>"), ("https://x.com/a", "why this ad"),
                                ("https://x.com/a", "product-card product-card product_card")], "u string, h string")
    assert [r[0] for r in df.select(cl.c_page_type("u", "h")).collect()] == ["product_page", "ad_creative", "category_page"]


def test_retrain_and_version(spark):
    df = spark.createDataFrame([(7, 0.0), (3, 8.0), (3, 8.1), (0, 0.0)], "d int, s double")
    assert [r[0] for r in df.select(numeric.c_should_retrain("d", "s")).collect()] == [True, False, True, False]
    assert spark.range(1).select(numeric.c_next_version(F.lit("v1.0"))).first()[0] == "v1.1"


def test_naive_and_health(spark):
    df = spark.createDataFrame([(50.0, 30.0, 0.7, 50.0)], "s double, a double, m double, d double")
    assert df.select(numeric.c_naive_demand("s", "a", "m")).first()[0] == 46.0
    assert df.select(numeric.c_health("m", "d", "s")).first()[0] == 58.0


def test_clean_text(spark):
    got = one(spark, text.c_clean_text("x", 10), [("A &amp;  B\x07 ",), ("ｆｕｌｌ width",), (None,)])
    assert got == ["A & B", "full width", ""]
    many = text.c_clean_many({"a": ("x", 500)})
    assert one(spark, many["a"], [("caf&eacute;  x",)]) == ["café x"]


def test_first_int(spark):
    assert one(spark, numeric.c_first_int("x"), [("#12 in Phones",), ("none",), (None,)]) == [12, None, None]


def test_clean_list_decodes_and_normalises(spark):
    from shelfspark.functions.text import c_clean_list
    df = spark.createDataFrame([(["A &amp; B", " ", "\ufb01ne", "plain  text", None],), (["x\x07 y"],), (None,)], "a array<string>")
    assert [r[0] for r in df.select(c_clean_list("a")).collect()] == [["A & B", "fine", "plain text"], ["x y"], []]


def test_url_rules_gold(spark):
    from shelfspark.functions.classify import c_page_type_url
    gold = {"https://x.com/reviews/1": "review_page", "https://x.com/rating?x": "review_page", "https://x.com/write-a-review#a": "review_page",
            "https://www.amazon.in/dp/B0ABCDEFGH#customerReviews": "review_page", "https://amazon.com/product-reviews/B0": "review_page",
            "https://www.flipkart.com/x?reviewPage=2": "review_page", "https://x.com/sponsored/9": "ad_creative", "https://x.com/ad/": "ad_creative",
            "https://x.com/search-trends/": "trend_data", "https://x.com/new-release?y": "trend_data", "https://amazon.in/gp/bestsellers": "trend_data",
            "https://www.amazon.in/Some-Name/dp/B0ABCDEFGH": "product_page", "https://www.flipkart.com/a/p/itm123": "product_page",
            "https://www.croma.com/some-phone-p123": "product_page", "https://x.com/item/7": "product_page", "https://x.com/details/abc": "product_page",
            "https://www.amazon.in/s?k=a": "category_page", "https://www.flipkart.com/a/pr?sid=b": "category_page", "https://x.com/collection": "category_page",
            "https://x.com/c/12": "category_page", "https://x.com/about": "unknown", "https://x.com/product/": "unknown"}
    df = spark.createDataFrame([(u,) for u in gold], "u string")
    assert {r[0]: r[1] for r in df.select("u", c_page_type_url("u")).collect()} == gold


def test_registered_domains(spark):
    from shelfspark.functions.url import c_registered_domain
    gold = {"www.shop.co.za": "shop.co.za", "a.b.example.com": "example.com", "x.com.tr": "x.com.tr", "s.gov.in": "s.gov.in", "com.tr": "com.tr", "localhost": None}
    df = spark.createDataFrame([(h,) for h in gold], "h string")
    assert {r[0]: r[1] for r in df.select("h", c_registered_domain("h")).collect()} == gold
    assert df.select(c_registered_domain("h", ["com.tr"])).filter("h = 'www.shop.co.za'").first()[0] == "co.za"


def test_alias_and_currency_tables(spark):
    from shelfspark.functions.parse import c_price
    from shelfspark.functions.sku import c_brand
    df = spark.createDataFrame([("Acme", "Foo Phone", "CHF 1,200.50"), ("", "bar", "kr.99")], "b string, n string, p string")
    got = df.select(c_brand("b", "n", [("acme", "acme-corp"), ("bar", "barco")]).alias("brand"), c_price("p", {"chf": "CHF", "kr.": "SEK"}, "EUR").alias("price")).collect()
    assert [(r.brand, r.price.amount, r.price.currency) for r in got] == [("acme-corp", 1200.5, "CHF"), ("barco", 99.0, "SEK")]


def test_plain_urls_are_not_taken_apart_and_come_out_the_same(spark):
    urls = [None, "", "https://a.b", "HTTPS://A.b//", "http://a.b/p/?utm_source=x&sku=1&", "https://a.b/p?=v&x=&y", "https://a.b?a=1&b=2&a=3",
            "https://a.b/p;q?ref=1", "https://a.b/p?x=%41", "http://u@a.b:80/p#f", "https://a.b/p\n", "//a.b/p?a=b=c", "https://a.b/p?ref=1"]
    staged = url.with_normalized_url(spark.createDataFrame([(u,) for u in urls], "u string"), "u", "n")
    assert [r.n for r in staged.collect()] == [r.n for r in staged.select(url.c_normalize_url("u").alias("n")).collect()]
    assert "NOT _nu_plain" in staged._jdf.queryExecution().optimizedPlan().toString()


def test_clean_text_is_only_looked_through(spark):
    texts = ["", "a b", " a", "a ", "a  b", "a\tb", "a\x00b", "a&amp;b", "\ufb01x", "\x7f", "a\x85", None]
    df = spark.createDataFrame([(t, "é" if i % 2 else "x") for i, t in enumerate(texts)], "t string, o string")
    many = df.select(*[c.alias(n) for n, c in text.c_clean_many({"t": ("t", 9), "o": ("o", 9)}).items()])
    assert [(r.t, r.o) for r in many.collect()] == [(text._py_clean(t) or "", "é" if i % 2 else "x") for i, t in enumerate(texts)]
    assert text._clean_many_udf.evalType != text._clean_udf.evalType                    # no pandas batch for rows that send nothing
