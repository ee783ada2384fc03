"""I1 scrape: pages (+ crawl-queue hints) -> one extraction pass -> JSON-LD fields -> parser choice
by hint (H12) -> content type (G15) -> normalised product / review / ad / trend / other records
(H11, F4) -> one write partitioned by output (A7).

``html`` never leaves the extraction stage, and all outputs come from one extraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as cl
from ..functions.parse import c_price, c_rating, c_rating_count
from ..functions.text import LONG, SHORT, c_clean_list, c_clean_short, c_clean_text
from ..operators.extract import PAGE_FIELDS, extract_pages

def _empty():
    return F.array().cast("array<string>")


def _ne(c: Column) -> Column:
    """NULL for NULL/''."""
    return F.nullif(c, F.lit(""))


def _ld_types(o: Column) -> Column:
    arr = F.try_variant_get(o, "$['@type']", "array<string>")
    one = F.try_variant_get(o, "$['@type']", "string")
    return F.coalesce(arr, F.when(one.isNotNull(), F.array(one)), _empty())


def _vs(o: Column, *paths: str) -> Column:
    """First non-empty string among JSON paths of a variant (scalars are cast to string)."""
    return F.coalesce(*[_ne(F.try_variant_get(o, p, "string")) for p in paths])


def _name_of(o: Column, key: str) -> Column:
    """Name of an object, or the text itself where the value is a text; an object without a name has none."""
    text = F.when(F.schema_of_variant(F.try_variant_get(o, f"$.{key}", "variant")) == "STRING", _vs(o, f"$.{key}"))
    return F.coalesce(_vs(o, f"$.{key}.name"), text)


def json_ld_fields(x: Column) -> dict[str, Column]:
    """H2 + H5 from the raw JSON-LD objects of the extraction struct (Spark VARIANT)."""
    blocks = F.transform(F.coalesce(F.col("json_ld"), _empty()), lambda s: F.try_parse_json(s))
    objs = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.try_variant_get(b, "$", "array<variant>"), F.array(b))))
    objs = F.filter(objs, lambda o: o.isNotNull())
    prods = F.filter(objs, lambda o: F.array_contains(_ld_types(o), "Product"))
    revs = F.filter(objs, lambda o: F.array_contains(_ld_types(o), "Review")
                    & ~F.array_contains(_ld_types(o), "Product"))
    crumbs = F.filter(objs, lambda o: F.array_contains(_ld_types(o), "BreadcrumbList")
                      & ~F.array_contains(_ld_types(o), "Product") & ~F.array_contains(_ld_types(o), "Review"))
    p = F.try_element_at(prods, F.lit(-1))      # last Product wins
    r = F.try_element_at(revs, F.lit(-1))
    b = F.try_element_at(crumbs, F.lit(-1))
    items = F.coalesce(F.try_variant_get(b, "$.itemListElement", "array<variant>"), F.array().cast("array<variant>"))
    ld_crumbs = F.transform(items, lambda i: F.coalesce(F.try_variant_get(i, "$.item.name", "string"),
                                                       F.try_variant_get(i, "$.name", "string"), F.lit("")))
    detected = F.try_element_at(F.filter(F.transform(objs, lambda o: F.when(
        F.array_contains(_ld_types(o), "Product"), F.lit("Product")).when(
        F.array_contains(_ld_types(o), "Review"), F.lit("Review")).when(
        F.array_contains(_ld_types(o), "SearchResultsPage"), F.lit("SearchResultsPage"))),
        lambda t: t.isNotNull()), F.lit(1))
    return {
        "product_name": _vs(p, "$.name"),
        "brand": _name_of(p, "brand"),
        "description": _vs(p, "$.description"),
        "sku_raw": _vs(p, "$.sku"),
        "model_number": _vs(p, "$.model"),
        "availability": _vs(p, "$.offers[0].availability", "$.offers.availability"),
        "price_raw": _vs(p, "$.offers[0].price", "$.offers.price"),
        "currency_raw": _vs(p, "$.offers[0].priceCurrency", "$.offers.priceCurrency"),
        "rating_raw": _vs(p, "$.aggregateRating.ratingValue"),
        "review_count_raw": _vs(p, "$.aggregateRating.reviewCount", "$.aggregateRating.ratingCount"),
        "review_text": _vs(r, "$.reviewBody"),
        "reviewer_name": _name_of(r, "author"),
        "review_date_raw": _vs(r, "$.datePublished"),
        "review_rating_raw": _vs(r, "$.reviewRating.ratingValue"),
        "breadcrumbs": F.when(F.size(F.filter(ld_crumbs, lambda c: c != "")) > 0, ld_crumbs),
        "detected_type": F.coalesce(detected, F.lit("")),
    }


def parse_pages(pages: DataFrame) -> DataFrame:
    """Extraction + field merge + parser choice. ``pages`` has url, html, page_type_hint,
    seed_category, seed_domain. Output: one row per page with the merged parsed fields."""
    ex = extract_pages(pages)
    x = F.col("x")
    ld = json_ld_fields(x)
    hint = F.coalesce(F.col("page_type_hint"), F.lit(cl.UNKNOWN))
    is_ = lambda t: hint == t
    s = lambda c: F.coalesce(c, F.lit(""))
    brand = s(F.coalesce(ld["brand"], _ne(x["dom_brand"])))
    og_desc, meta_desc = s(F.col("og_description")), s(F.col("meta_description"))
    description = s(F.coalesce(ld["description"], _ne(x["description"])))
    cols = {
        "page_title": s(F.col("page_title")), "meta_description": meta_desc, "og_title": s(F.col("og_title")),
        "og_description": og_desc, "og_image": s(F.col("og_image")),
        "product_name": s(F.coalesce(ld["product_name"], _ne(x["dom_product_name"]))),
        "brand": brand,
        "description": description,
        "sku_raw": s(ld["sku_raw"]), "model_number": s(ld["model_number"]),
        "availability": s(F.coalesce(ld["availability"], _ne(x["dom_availability"]))),
        "price_raw": s(F.coalesce(ld["price_raw"], _ne(x["dom_price"]))),
        "currency_raw": s(ld["currency_raw"]),
        "rating_raw": s(F.coalesce(ld["rating_raw"], _ne(x["dom_rating"]))),
        "review_count_raw": s(F.coalesce(ld["review_count_raw"], _ne(x["dom_review_count"]))),
        "breadcrumbs": F.coalesce(ld["breadcrumbs"], x["breadcrumbs"], _empty()),
        "bullet_points": F.coalesce(x["bullet_points"], _empty()),
        "review_text": s(ld["review_text"]), "reviewer_name": s(ld["reviewer_name"]),
        "review_date_raw": s(ld["review_date_raw"]), "review_rating_raw": s(ld["review_rating_raw"]),
        "verified_purchase": F.lit(False),
        "detected_type": ld["detected_type"],
        # Parser-specific fields only for their page type
        "images": F.when(is_(cl.PRODUCT), x["images"]).otherwise(_empty()),
        "variants": F.when(is_(cl.PRODUCT), x["variants"]).otherwise(_empty()),
        "specs": F.when(is_(cl.PRODUCT), x["specs"]).otherwise(F.create_map().cast("map<string,string>")),
        "seller": F.when(is_(cl.PRODUCT), s(x["seller"])).otherwise(F.lit("")),
        "mrp_raw": F.when(is_(cl.PRODUCT), s(x["mrp_raw"])).otherwise(F.lit("")),
        "reviews": F.when(is_(cl.REVIEW), x["reviews"]),
        "trend_items": F.when(is_(cl.TREND), x["trend_items"]),
        "advertiser": F.when(is_(cl.AD), F.when(brand != "", brand).otherwise(s(x["dom_advertiser"]))).otherwise(F.lit("")),
        "ad_type": F.when(is_(cl.AD), F.when(F.col("url").contains("ad-transparency") | F.col("url").contains("adtransparency"),
                                             F.lit("transparency_page"))
                          .otherwise(F.coalesce(_ne(x["dom_ad_type"]), F.lit("unknown")))).otherwise(F.lit("")),
        "ad_target_url": F.when(is_(cl.AD), s(x["ad_target_url"])).otherwise(F.lit("")),
        "links": F.col("links"), "rel_next": s(F.col("rel_next")),
    }
    cols["ad_snippet"] = F.when(is_(cl.AD), F.substring(
        F.coalesce(_ne(og_desc), _ne(meta_desc), description), 1, 500)).otherwise(F.lit(""))
    keep = [c for c in ex.columns if c != "x" and c not in PAGE_FIELDS]
    out = ex.select(*keep, *[v.alias(k) for k, v in cols.items()])
    ct = cl.c_content_type("detected_type", "page_type_hint", "price_raw", "product_name", "brand", "description",
                           "meta_description", "bullet_points", "review_text", F.size(F.coalesce("reviews", F.array())),
                           F.size(F.coalesce("trend_items", F.array())), "advertiser")
    return out.withColumn("content_type", ct)


def _host(url="url") -> Column:
    return F.coalesce(F.expr(f"try_parse_url({url}, 'HOST')"), F.lit(""))


def _shared(content_type: str) -> list[Column]:
    return [F.lit(content_type).alias("content_type"), F.col("url"), _host().alias("source_domain"), F.col("seed_category")]


def product_fields(use_ld_currency: bool = False, accept_bare_count: bool = False) -> list[Column]:
    name = F.coalesce(_ne(F.col("product_name")), _ne(F.col("og_title")), F.col("page_title"))
    price = c_price("price_raw")
    if use_ld_currency:
        price = price.withField("currency", F.coalesce(_ne(F.upper(F.trim("currency_raw"))), price["currency"]))
    extra = F.map_filter(F.create_map(
        F.lit("specs"), F.when(F.size("specs") > 0, F.to_json("specs")),
        F.lit("variants"), F.when(F.size("variants") > 0, F.to_json("variants")),
        F.lit("images"), F.when(F.size("images") > 0, F.to_json("images")),
        F.lit("seller"), F.when(F.col("seller") != "", c_clean_short("seller")),
        F.lit("mrp"), F.when(F.col("mrp_raw") != "", F.to_json(c_price("mrp_raw")))), lambda k, v: v.isNotNull())
    return _shared("product") + [
        c_clean_short(name).alias("product_name"), c_clean_short("brand").alias("brand"),
        c_clean_short("model_number").alias("model_number"), c_clean_short("sku_raw").alias("sku_hint"),
        c_clean_list("breadcrumbs").alias("breadcrumbs"),
        c_clean_list("bullet_points").alias("bullet_points"),
        c_clean_text(F.coalesce(_ne(F.col("description")), F.col("meta_description")), LONG).alias("description"),
        c_clean_short("availability").alias("availability"), price.alias("price"),
        F.struct(c_rating("rating_raw").alias("value"),
                 c_rating_count("review_count_raw", accept_bare_count).alias("count"),
                 F.col("rating_raw").alias("raw")).alias("rating"),
        F.col("crawled_at"), extra.alias("extra")]


def _review_cards() -> Column:
    """Cards of a review page, or one card of its top-level fields."""
    cards = F.coalesce(F.col("reviews"), F.array())
    top = F.struct(F.col("reviewer_name").alias("reviewer"), F.col("review_rating_raw").alias("rating"),
                   F.lit(None).cast("string").alias("title"), F.col("review_date_raw").alias("date"),
                   F.col("review_text").alias("text"), F.col("verified_purchase").alias("verified"))
    return F.when(F.size(cards) > 0, cards).otherwise(F.array(top))


def review_fields(c: Column) -> list[Column]:
    return _shared("review") + [
        F.lit("").alias("parent_product_url"),
        c_clean_short(c["reviewer"]).alias("reviewer_name"), c_clean_text(c["text"], LONG).alias("review_text"),
        c_clean_short(c["date"]).alias("review_date"), F.coalesce(c["verified"], F.lit(False)).alias("verified_purchase"),
        F.struct(c_rating(c["rating"]).alias("value"), F.lit(None).cast("bigint").alias("count"),
                 F.coalesce(c["rating"], F.lit("")).alias("raw")).alias("rating"),
        F.col("crawled_at"),
        F.when(c["title"].isNotNull(), F.create_map(F.lit("title"), c_clean_short(c["title"])))
        .otherwise(F.create_map().cast("map<string,string>")).alias("extra")]


def ad_fields() -> list[Column]:
    return _shared("ad") + [c_clean_short("advertiser").alias("advertiser"), c_clean_short("ad_type").alias("ad_type"),
                            F.col("ad_target_url").alias("target_url"),
                            c_clean_text("ad_snippet", SHORT).alias("content_snippet"), F.col("crawled_at")]


def _trend_cards() -> Column:
    """Named items of a trend page; a page without items has one null card (its summary)."""
    items = F.coalesce(F.col("trend_items"), F.array())
    return F.when(F.size(items) > 0, F.filter(items, lambda i: i["name"] != "")).otherwise(F.array(F.lit(None)))


def trend_fields(c: Column) -> list[Column]:
    name = F.when(c.isNotNull(), c["name"]).otherwise(F.coalesce(_ne(F.col("product_name")), F.col("page_title")))
    return _shared("trend") + [
        c["rank"].alias("rank"), c_clean_short(name).alias("product_name"),
        F.lit(None).cast("double").alias("trend_score"), F.col("seed_category").alias("category"), F.col("crawled_at"),
        F.when(c.isNotNull(), F.create_map(F.lit("price"), c["price"], F.lit("item_url"), c["url"]))
        .otherwise(F.create_map().cast("map<string,string>")).alias("extra")]


def other_fields() -> list[Column]:
    return [F.col(c) for c in ("content_type", "url", "seed_category", "page_title")]


def product_records(parsed: DataFrame, use_ld_currency: bool = False, accept_bare_count: bool = False) -> DataFrame:
    """H11 product records. Defaults reproduce the reference: currency from the price text
    (Q15; ``use_ld_currency`` takes the JSON-LD currency when present) and a rating count only
    when written before ratings/reviews (Q14; ``accept_bare_count`` also accepts a bare number)."""
    return parsed.filter(F.col("content_type") == cl.CT_PRODUCT).select(*product_fields(use_ld_currency, accept_bare_count))


def review_records(parsed: DataFrame) -> DataFrame:
    """H11 + F4: one record per review card, or one from the top-level fields when none."""
    r = parsed.filter(F.col("content_type") == cl.CT_REVIEW).withColumn("_card", F.explode(_review_cards()))
    return r.select(*review_fields(F.col("_card")))


def ad_records(parsed: DataFrame) -> DataFrame:
    """H11 ad records."""
    return parsed.filter(F.col("content_type") == cl.CT_AD).select(*ad_fields())


def trend_records(parsed: DataFrame) -> DataFrame:
    """H11 + F4: named ranked items become records; a page without items gives one summary record."""
    t = parsed.filter(F.col("content_type") == cl.CT_TREND).withColumn("_card", F.explode(_trend_cards()))
    return t.select(*trend_fields(F.col("_card")))


def other_records(parsed: DataFrame) -> DataFrame:
    o = parsed.filter(~F.col("content_type").isin(cl.CT_PRODUCT, cl.CT_REVIEW, cl.CT_AD, cl.CT_TREND))
    return o.select(*other_fields())


# Output file per content type; category and other share one output.
OUTPUT_OF = {"product": "products", "review": "reviews", "ad": "ads", "trend": "trends"}
OTHER_OUTPUT = "unclassified"


def records_by_output(parsed: DataFrame) -> DataFrame:
    """All records as (output, record JSON) rows: the single DataFrame A7 writes. One pass over ``parsed``: a page's
    cards are exploded, then each row is written by the fields of its own content type."""
    ct = F.col("content_type")
    reviews = F.when(ct == cl.CT_REVIEW, _review_cards())
    trends = F.when(ct == cl.CT_TREND, _trend_cards())
    # one row per card; the two kinds of cards never meet in one page
    n = F.when(ct == cl.CT_REVIEW, F.size(reviews)).when(ct == cl.CT_TREND, F.size(trends)).otherwise(F.lit(1))
    rows = (parsed.withColumns({"_reviews": reviews, "_trends": trends, "_n": n}).filter(F.col("_n") > 0)
            .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
            .withColumns({"_review": F.try_element_at("_reviews", F.col("_i")), "_trend": F.try_element_at("_trends", F.col("_i"))}))
    record = lambda fields: F.to_json(F.struct(*fields))
    value = (F.when(ct == cl.CT_PRODUCT, record(product_fields())).when(ct == cl.CT_REVIEW, record(review_fields(F.col("_review"))))
             .when(ct == cl.CT_AD, record(ad_fields())).when(ct == cl.CT_TREND, record(trend_fields(F.col("_trend"))))
             .otherwise(record(other_fields())))
    output = F.lit(OTHER_OUTPUT)
    for kind, name in OUTPUT_OF.items():
        output = F.when(ct == kind, F.lit(name)).otherwise(output)
    return rows.select(output.alias("output"), value.alias("value"))


def pages_with_hints(pages: DataFrame, html_scope: str = "own") -> DataFrame:
    """Page-type hint for driver pages (no queue): classify each page by its own URL and HTML
    (Q17 default)."""
    return pages.select("page_id", "url", "html",
                        cl.c_page_type("url", "html").alias("page_type_hint"),
                        F.lit("").alias("seed_category"),
                        F.coalesce(F.expr("try_parse_url(url, 'HOST')"), F.lit("")).alias("seed_domain"),
                        F.lit("").alias("crawled_at"))


def scrape(queue: DataFrame | None, pages: DataFrame) -> DataFrame:
    """Queue entries joined to fetched pages on url (C2) -- or the pages alone -- parsed and
    normalised; returns the (output, value) table for ``sources.writers.write_by_type``."""
    if queue is None:
        src = pages_with_hints(pages)
    else:
        src = attach_html(queue, pages)
    return records_by_output(parse_pages(src))


def attach_html(queue: DataFrame, pages: DataFrame) -> DataFrame:
    """Queue entries INNER JOIN fetched pages on url; empty bodies dropped."""
    p = pages.select("url", "html").filter(F.col("html").isNotNull() & (F.length("html") > 0))
    q = queue.select("url", F.col("page_type").alias("page_type_hint"), "seed_category", "seed_domain",
                     F.lit("").alias("crawled_at"))
    return q.join(p, "url").withColumn("page_id", F.lit(None).cast("bigint"))
