"""Registered crawl / scrape queries over the driver's ``pages`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import classify as cl
from ..functions import url as U
from ..functions.html import c_title
from ..operators import crawl
from . import scrape
from .catalog_queries import q, sql_normalize_url
from .registry import query

# ---------------------------------------------------------------- DuckDB twins


def sql_page_type_url(u: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(COALESCE({u}, ''), {q(p)}) THEN {q(t)}" for p, t in cl.URL_RULES)
    return f"(CASE {cases} ELSE 'unknown' END)"


def sql_page_type_html(h: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(COALESCE({h}, ''), {q(p)}) THEN {q(t)}" for p, t in cl.HTML_RULES)
    grid = f"len(regexp_extract_all(COALESCE({h}, ''), {q(cl.GRID_RE)})) >= {cl.GRID_MIN}"
    return f"(CASE {cases} WHEN {grid} THEN 'category_page' ELSE 'unknown' END)"


def sql_page_type(u: str, h: str) -> str:
    return f"(CASE WHEN {sql_page_type_url(u)} <> 'unknown' THEN {sql_page_type_url(u)} ELSE {sql_page_type_html(h)} END)"


def sql_priority(t: str) -> str:
    arr = "[" + ", ".join(q(x) for x in cl.PRIORITY_ORDER) + "]"
    return f"CAST(CASE WHEN list_position({arr}, {t}) > 0 THEN list_position({arr}, {t}) ELSE {len(cl.PRIORITY_ORDER) + 1} END AS INTEGER)"


def sql_host(u: str) -> str:
    return f"NULLIF(regexp_extract(lower(trim({u})), '^[a-z][a-z0-9+.\\-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1), '')"


def sql_registered_domain(h: str) -> str:
    hh = f"regexp_replace(regexp_replace(lower({h}), '^(?:[^@/]*@)?www\\.|:\\d+$', '', 'g'), '^[^@/]*@', '')"
    labels = f"string_split({hh}, '.')"
    last2 = f"array_to_string({labels}[-2:], '.')"
    return (f"(CASE WHEN {h} IS NULL OR {hh} = '' OR len({labels}) < 2 THEN NULL WHEN len({labels}) = 2 THEN {hh} "
            f"WHEN regexp_matches({last2}, '^(co|com|net|org|gov|edu|ac|or|ne|go)[.][a-z][a-z]$') THEN array_to_string({labels}[-3:], '.') ELSE {last2} END)")


_EXT = "[" + ", ".join(q(e) for e in U.SKIP_EXTENSIONS) + "]"
_HREF_RE = r'<a\s[^>]*href="([^"]*)"'

# links per page: root-relative / absolute / protocol-relative hrefs resolved against the page URL,
# fragment dropped, scheme+host lower-cased, unique per page in first-seen order, G25 filters.
LINKS_SQL = f"""
_raw AS (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\\-]*)://', 1) AS scheme,
  regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1) AS netloc,
  unnest(list_transform(regexp_extract_all(html, {q(_HREF_RE)}, 1), lambda h, i: {{'h': trim(h), 'i': i}})) AS e
  FROM pages),
_abs AS (SELECT page_id, url, e.i AS i,
  regexp_replace(CASE
    WHEN regexp_matches(e.h, '^(?i)https?://') THEN lower(regexp_extract(e.h, '^([^:]*)', 1)) || '://' || lower(regexp_extract(e.h, '^[^:]*://([^/?#]*)', 1)) || regexp_extract(e.h, '^[^:]*://[^/?#]*(.*)$', 1)
    WHEN starts_with(e.h, '//') THEN lower(scheme) || '://' || lower(regexp_extract(e.h, '^//([^/?#]*)', 1)) || regexp_extract(e.h, '^//[^/?#]*(.*)$', 1)
    WHEN starts_with(e.h, '/') THEN lower(scheme) || '://' || lower(netloc) || e.h
    WHEN starts_with(e.h, '#') THEN lower(scheme) || '://' || lower(netloc) || regexp_extract(url, '^[^:]*://[^/?#]*(.*)$', 1)
    ELSE NULL END, '#.*$', '') AS link
  FROM _raw WHERE e.h <> '' AND NOT regexp_matches(e.h, '^(?i)(javascript|mailto|tel|data):')),
_uniq AS (SELECT page_id, url, link, MIN(i) AS i FROM _abs WHERE link IS NOT NULL GROUP BY page_id, url, link),
links AS (SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, link FROM _uniq),
edges AS (SELECT * FROM links WHERE regexp_matches(link, '^(?i)https?://[^/]')
  AND NOT list_contains({_EXT}, regexp_extract(rtrim(lower(regexp_extract(link, {q(U._URL_RE)}, 3)), '/'), '\\.([a-z0-9]+)$', 1)))"""


def _pages(spark, sf):
    return fx.table(spark, sf, "pages")


def _edges(spark, sf):
    return crawl.link_edges(crawl.extract_links(_pages(spark, sf)))


# ---------------------------------------------------------------- queries


@query("page_titles", """
SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS page_title FROM pages""")
def q_page_titles(spark, sf):
    """H1: page title per page."""
    return _pages(spark, sf).select("page_id", c_title(F.col("html")).alias("page_title"))


@query("page_links", f"WITH {LINKS_SQL}\nSELECT page_id, pos, link FROM edges")
def q_page_links(spark, sf):
    """H10 + G25: every page's unique absolute links in order."""
    return _edges(spark, sf).select("page_id", "pos", "link")


@query("page_types", f"""SELECT page_id, {sql_page_type_url('url')} AS type_by_url, {sql_page_type('url', 'html')} AS page_type,
  {sql_priority(sql_page_type('url', 'html'))} AS priority FROM pages""")
def q_page_types(spark, sf):
    """G13 + G14 + E6 over every page."""
    p = _pages(spark, sf)
    t = cl.c_page_type("url", "html")
    return p.select("page_id", cl.c_page_type_url("url").alias("type_by_url"), t.alias("page_type"),
                    cl.c_priority(t).alias("priority"))


@query("type_breakdown", f"""SELECT {sql_host('url')} AS seed_domain, {sql_page_type('url', 'html')} AS page_type,
  COUNT(*) AS n FROM pages GROUP BY 1, 2""")
def q_type_breakdown(spark, sf):
    """Pages per (domain, page type)."""
    p = _pages(spark, sf).select(U.c_host("url").alias("seed_domain"), cl.c_page_type("url", "html").alias("page_type"))
    return crawl.type_breakdown(p)


@query("url_domains", f"""SELECT page_id, {sql_host('url')} AS host, {sql_registered_domain(sql_host('url'))} AS registered_domain
FROM pages""")
def q_url_domains(spark, sf):
    """G16 over every page URL."""
    h = U.c_host("url")
    return _pages(spark, sf).select("page_id", h.alias("host"), U.c_registered_domain(h).alias("registered_domain"))


_NEXT_SQL = "(CASE " + " ".join(
    f"WHEN regexp_matches(COALESCE(regexp_extract(url, '\\?([^#]*)', 1), ''), {q(r'(^|&)' + p + r'=(\d+)(&|$)')}) THEN "
    f"split_part(url, '?', 1) || '?' || regexp_replace(regexp_extract(url, '\\?([^#]*)', 1), {q(r'(^|&)' + p + r'=(\d+)(&|$)')}, "
    f"'\\1{p}=' || CAST(CAST(regexp_extract(regexp_extract(url, '\\?([^#]*)', 1), {q(r'(^|&)' + p + r'=(\d+)(&|$)')}, 2) AS BIGINT) + 1 AS VARCHAR) || '\\3') "
    f"|| (CASE WHEN contains(url, '#') THEN '#' || regexp_extract(url, '#(.*)$', 1) ELSE '' END)"
    for p in crawl.PAGE_PARAMS) + " END)"


@query("next_pages", f"""SELECT page_id, CASE WHEN {sql_page_type('url', 'html')} IN ('category_page', 'unknown') THEN
  COALESCE({_NEXT_SQL},
    CASE WHEN regexp_matches(split_part(url, '?', 1), {q(crawl.PAGE_PATH_RE)}) THEN
      regexp_replace(url, '(?i)/(?:page|p)/(\\d+)/?($|\\?|#)', '/page/' || CAST(CAST(regexp_extract(split_part(url, '?', 1), {q(crawl.PAGE_PATH_RE)}, 1) AS BIGINT) + 1 AS VARCHAR) || '/\\2') END)
  END AS next_url FROM pages""")
def q_next_pages(spark, sf):
    """G24 for every page treated as a depth-0 request (max depth 4); pages carry no rel=next."""
    p = (crawl.extract_links(_pages(spark, sf).withColumn("page_type", cl.c_page_type("url", "html")))
         .withColumn("depth", F.lit(0)).withColumn("max_depth", F.lit(4)))
    return p.select("page_id", crawl.next_page().alias("next_url"))


@query("next_pages_rel", f"""SELECT page_id, CASE WHEN {sql_page_type('url', 'html')} IN ('category_page', 'unknown') THEN
  regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || '/after/' || page_id END AS next_url FROM pages""")
def q_next_pages_rel(spark, sf):
    """G24 where every page names its successor: the pages with a rel=next link set before their own HTML."""
    link = F.concat(F.lit('<a rel="next" href="/other">x</a><link rel="next" href="/after/'), F.col("page_id"), F.lit('">'))
    pages = _pages(spark, sf).withColumn("page_type", cl.c_page_type("url", "html")).withColumn("html", F.concat(link, "html"))
    p = crawl.extract_links(pages).withColumn("depth", F.lit(0)).withColumn("max_depth", F.lit(4))
    return p.select("page_id", crawl.next_page().alias("next_url"))


@query("page_url_keys", f"""SELECT page_id, {sql_normalize_url('url')} AS url_normalized,
  substr(sha256({sql_normalize_url('url')}), 1, 16) AS url_fp FROM pages""")
def q_page_url_keys(spark, sf):
    """G5 + G6 over the pages' URLs, which come with queries, tracking parameters, fragments and slashes at the end."""
    p = U.with_normalized_url(_pages(spark, sf).select("page_id", "url"), "url", "url_normalized")
    return p.select("page_id", "url_normalized", U.c_url_fp("url").alias("url_fp"))


@query("product_pages", """SELECT p_partkey AS page_id, p_name AS product_name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS brand,
  CAST(floor(p_retailprice) AS DOUBLE) AS amount, 'INR' AS currency, CASE WHEN p_partkey % 2 = 0 THEN 'S' || p_partkey ELSE '' END AS sku_hint
FROM part""")
def q_product_pages(spark, sf):
    """H2, H3, H11 on product pages made from ``part``: JSON-LD on every second page, DOM fields on all."""
    part, price = fx.table(spark, sf, "part"), F.floor("p_retailprice").cast("bigint").cast("string")
    ld = F.when(F.col("p_partkey") % 2 == 0, F.concat(
        F.lit('<script type="application/ld+json">'), F.to_json(F.struct(
            F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"),
            F.concat(F.lit("S"), F.col("p_partkey")).alias("sku"), F.struct(price.alias("price"), F.lit("USD").alias("priceCurrency")).alias("offers"))),
        F.lit("</script>"))).otherwise(F.lit(""))
    html = F.concat(F.lit("<html><head><title>Shop</title>"), ld, F.lit('</head><body><h1 id="productTitle">'), F.col("p_name"),
                    F.lit('</h1><span class="price">Rs. '), price, F.lit("</span></body></html>"))
    pages = part.select(F.col("p_partkey").cast("bigint").alias("page_id"), F.concat(F.lit("https://shop.example.com/product/"), F.col("p_partkey")).alias("url"),
                        html.alias("html"))
    r = scrape.product_records(scrape.parse_pages(scrape.pages_with_hints(pages)))
    return r.select(F.substring_index("url", "/", -1).cast("bigint").alias("page_id"), "product_name", "brand",
                    F.col("price.amount").alias("amount"), F.col("price.currency").alias("currency"), "sku_hint")


def _frontier(spark, sf):
    pages = _pages(spark, sf)
    host = U.c_host("url")
    frontier = pages.select("url", F.lit("").alias("seed_category"), host.alias("seed_domain"),
                            F.col("url").alias("origin_url"), F.lit(0).alias("depth"), F.lit(4).alias("max_depth"),
                            F.lit(None).cast("string").alias("parent_url"),
                            F.lit(None).cast("string").alias("product_hint"))
    seeds = pages.select(F.array(host).alias("domains"))
    return frontier, crawl.extract_links(pages.select("url", "html")), seeds, pages.select("url")


# One crawl level from all pages as depth-0 requests: the fresh links, one row a URL, with their place in their domain.
FRESH_SQL = f"""{LINKS_SQL},
kids AS (SELECT e.link AS url, '' AS seed_category, {sql_host('e.url')} AS seed_domain, e.url AS origin_url, 1 AS depth,
  4 AS max_depth, e.url AS parent_url, CAST(NULL AS VARCHAR) AS product_hint, e.url AS found_on, e.pos,
  {sql_page_type_url('e.link')} AS page_type
  FROM edges e
  WHERE {sql_registered_domain(sql_host('e.link'))} IS NOT NULL
    AND {sql_registered_domain(sql_host('e.link'))} = {sql_registered_domain(sql_host('e.url'))}
    AND {sql_registered_domain(sql_host('e.link'))} IN (SELECT {sql_registered_domain(sql_host('url'))} FROM pages)),
fresh AS (SELECT * FROM kids WHERE url NOT IN (SELECT url FROM pages)),
firsts AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {sql_priority('page_type')}, found_on, pos) AS rn
  FROM fresh) WHERE rn = 1)"""


@query("frontier_level", f"""WITH {FRESH_SQL},
capped AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY seed_domain ORDER BY {sql_priority('page_type')}, url) AS rn
  FROM firsts) WHERE rn <= 500)
SELECT *, {sql_priority('page_type')} AS priority FROM capped""")
def q_frontier_level(spark, sf):
    """I3 one level over all pages as depth-0 requests."""
    frontier, links, seeds, seen = _frontier(spark, sf)
    return crawl.expand_level(frontier, links, seeds, seen)


@query("crawl_plan", f"""WITH {FRESH_SQL},
held AS (SELECT {sql_host('url')} AS seed_domain, COUNT(*) AS n FROM pages GROUP BY 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY seed_domain ORDER BY {sql_priority('page_type')}, url) AS rn FROM firsts)
SELECT url, '' AS seed_category, {sql_host('url')} AS seed_domain, url AS origin_url, 0 AS depth, 4 AS max_depth,
  CAST(NULL AS VARCHAR) AS parent_url, CAST(NULL AS VARCHAR) AS product_hint, CAST(NULL AS VARCHAR) AS page_type FROM pages
UNION ALL
SELECT p.url, p.seed_category, p.seed_domain, p.origin_url, p.depth, p.max_depth, p.parent_url, p.product_hint, p.page_type
FROM placed p JOIN held USING (seed_domain) WHERE rn <= {crawl.MAX_PER_DOMAIN} - held.n""")
def q_crawl_plan(spark, sf):
    """I3 all levels until the frontier is empty. Every page with a body is a request of level 0, so what level 1 finds has none
    and level 2 is empty."""
    frontier, links, seeds, _ = _frontier(spark, sf)
    return crawl.crawl_plan(frontier, links, seeds)


_SITE = "https://r' || n_regionkey || '.example.com"


@query("crawl_site", f"""WITH RECURSIVE
cust AS (SELECT c_custkey, n_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
links AS (
  SELECT '{_SITE}/' AS parent, '{_SITE}/category/' || n_nationkey AS child, n_nationkey + 0 AS pos FROM nation
  UNION ALL SELECT '{_SITE}/category/' || n_nationkey, '{_SITE}/product/' || c_custkey, c_custkey FROM cust
  UNION ALL SELECT '{_SITE}/product/' || c_custkey, '{_SITE}/reviews/' || c_custkey, 0 FROM cust
  UNION ALL SELECT '{_SITE}/reviews/' || c_custkey, '{_SITE}/stories/' || c_custkey, 0 FROM cust),
walk AS (SELECT DISTINCT parent AS url, regexp_extract(parent, '//([^/]*)', 1) AS seed_domain, 0 AS depth FROM links WHERE regexp_matches(parent, 'com/$')
  UNION SELECT l.child, w.seed_domain, w.depth + 1 FROM walk w JOIN links l ON l.parent = w.url WHERE w.depth + 1 < 4)
SELECT url, seed_domain, MIN(depth) AS depth, CASE WHEN MIN(depth) = 0 THEN NULL ELSE 'https://' || seed_domain || '/' END AS parent_url,
  CASE WHEN MIN(depth) > 0 THEN {sql_page_type_url('url')} END AS page_type FROM walk GROUP BY url, seed_domain""")
def q_crawl_site(spark, sf):
    """I3 over several levels, a site a region: front page, a page a nation, a page a customer, one of its reviews, and below
    the largest depth its stories. All pages link back to their nation's page and the front page."""
    nation, cust = fx.table(spark, sf, "nation"), fx.table(spark, sf, "customer").join(fx.table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
    site = F.concat(F.lit("https://r"), F.col("n_regionkey").cast("string"), F.lit(".example.com"))
    at = lambda kind, key: F.concat(F.lit(f"/{kind}/"), F.col(key).cast("string"))      # noqa: E731
    a = lambda path: F.concat(F.lit('<a href="'), path, F.lit('">x</a>'))               # noqa: E731
    back = F.concat(a(F.lit("/")), a(at("category", "n_nationkey")))
    fronts = nation.groupBy(F.concat(site, F.lit("/")).alias("url")).agg(F.concat_ws("", F.collect_list(a(at("category", "n_nationkey")))).alias("html"))
    lists = cust.groupBy(F.concat(site, at("category", "n_nationkey")).alias("url")).agg(F.concat_ws("", F.collect_list(F.concat(back, a(at("product", "c_custkey"))))).alias("html"))
    leaf = lambda kind, below: cust.select(F.concat(site, at(kind, "c_custkey")).alias("url"), F.concat(back, a(at(below, "c_custkey"))).alias("html"))
    pages = fronts.unionByName(lists).unionByName(leaf("product", "reviews")).unionByName(leaf("reviews", "stories"))
    frontier = fronts.select("url", F.lit("").alias("seed_category"), U.c_host("url").alias("seed_domain"), F.col("url").alias("origin_url"),
                             F.lit(0).alias("depth"), F.lit(4).alias("max_depth"))
    plan = crawl.crawl_plan(frontier, crawl.extract_links(pages), frontier.select(F.array("seed_domain").alias("domains")), cap=2**31 - 1)
    return plan.select("url", "seed_domain", "depth", "parent_url", "page_type")


@query("product_hints", """WITH kw AS (
  SELECT CAST(p_partkey AS VARCHAR) AS k, p_name AS m, -p_partkey AS po, 0 AS ko FROM part
  UNION ALL SELECT DISTINCT '.COM/' || lang || '/', 'lang ' || lang, 1, ascii(lang) * 256 + ascii(substr(lang, 2)) FROM documents WHERE lang IS NOT NULL),
hits AS (SELECT url, m, row_number() OVER (PARTITION BY url ORDER BY po, ko) AS rn
  FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL) JOIN kw ON contains(lower(url), lower(k)))
SELECT page_id, url, m AS product_hint FROM pages LEFT JOIN (SELECT * FROM hits WHERE rn = 1) USING (url)""")
def q_product_hints(spark, sf):
    """For every page the part of the largest number in its URL, else its language; keywords of one character and more."""
    part = fx.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("keyword"), F.col("p_name").alias("model_id"),
                                              (-F.col("p_partkey")).cast("bigint").alias("product_ord"), F.lit(0).alias("kw_ord"))
    langs = fx.table(spark, sf, "documents").select("lang").filter(F.col("lang").isNotNull()).distinct().select(
        F.concat(F.lit(".COM/"), "lang", F.lit("/")).alias("keyword"), F.concat(F.lit("lang "), "lang").alias("model_id"), F.lit(1).cast("bigint").alias("product_ord"),
        (F.ascii("lang") * 256 + F.ascii(F.substr("lang", F.lit(2)))).alias("kw_ord"))
    urls = _pages(spark, sf).select("page_id", "url", F.lit(None).cast("string").alias("product_hint"))
    return crawl.product_hint(urls, part.unionByName(langs))


@query("parsed_pages")
def q_parsed_pages(spark, sf):
    """H1-H12 + G15: one parsed row per page (rows-only; gold tests in pytest)."""
    parsed = scrape.parse_pages(scrape.pages_with_hints(_pages(spark, sf)))
    return parsed.select("page_id", "url", "page_type_hint", "content_type", "page_title", "product_name",
                         "brand", "price_raw", F.size("links").alias("n_links"))


@query("scrape_records")
def q_scrape_records(spark, sf):
    """The (output, record) table the scrape job writes (rows-only)."""
    return scrape.scrape(None, _pages(spark, sf))


@query("crawl_summary", f"""WITH {LINKS_SQL},
kids AS (SELECT e.link AS url, {sql_host('e.url')} AS seed_domain, e.url AS found_on, e.pos,
  {sql_page_type_url('e.link')} AS page_type
  FROM edges e
  WHERE {sql_registered_domain(sql_host('e.link'))} IS NOT NULL
    AND {sql_registered_domain(sql_host('e.link'))} = {sql_registered_domain(sql_host('e.url'))}
    AND {sql_registered_domain(sql_host('e.link'))} IN (SELECT {sql_registered_domain(sql_host('url'))} FROM pages)),
fresh AS (SELECT * FROM kids WHERE url NOT IN (SELECT url FROM pages)),
firsts AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {sql_priority('page_type')}, found_on, pos) AS rn
  FROM fresh) WHERE rn = 1),
capped AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY seed_domain ORDER BY {sql_priority('page_type')}, url) AS rn
  FROM firsts) WHERE rn <= 500),
log AS (SELECT seed_domain, 'enqueued' AS status FROM capped
  UNION ALL SELECT {sql_host('url')} AS seed_domain, 'completed' AS status FROM pages)
SELECT seed_domain, COUNT_IF(status = 'enqueued') AS enqueued, COUNT_IF(status = 'completed') AS completed,
  COUNT_IF(status = 'failed') AS failed FROM log GROUP BY seed_domain ORDER BY seed_domain""")
def q_crawl_summary(spark, sf):
    """D10 per seed domain: requests enqueued by one crawl level, pages completed (fetched), failed."""
    frontier, links, seeds, seen = _frontier(spark, sf)
    level = crawl.expand_level(frontier, links, seeds, seen)
    log = level.select("seed_domain", F.lit("enqueued").alias("status")).unionByName(
        _pages(spark, sf).select(U.c_host("url").alias("seed_domain"), F.lit("completed").alias("status")))
    return crawl.crawl_summary(log)
