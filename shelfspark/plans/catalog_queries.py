"""Registered catalogue queries: scalars over listings, dedup, SKU merge, taxonomy, run stats."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import parse, sku, url
from ..functions.text import c_slug
from ..operators import catalog
from ..session import written_once
from .registry import R, query

# ---------------------------------------------------------------- DuckDB twins of the scalars


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(COALESCE({x}, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def sql_price_amount(x: str) -> str:
    num = f"NULLIF(regexp_extract(trim({x}), {q(parse.PRICE_RE)}, 2), '')"
    return f"TRY_CAST(replace({num}, ',', '') AS DOUBLE)"


def sql_currency(x: str) -> str:
    num = f"NULLIF(regexp_extract(trim({x}), {q(parse.PRICE_RE)}, 2), '')"
    sym = f"lower(trim(regexp_extract(trim({x}), {q(parse.PRICE_RE)}, 1)))"
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in parse.CURRENCY_PREFIXES.items())
    return f"CASE WHEN {num} IS NULL THEN 'INR' ELSE (CASE {sym} {cases} ELSE 'INR' END) END"


def sql_r2(e: str) -> str:
    return R(e, 2)


def sql_rating(x: str) -> str:
    raw = f"trim({x})"
    pct = f"TRY_CAST(NULLIF(regexp_extract({raw}, {q(parse.PERCENT_RE)}, 1), '') AS DOUBLE)"
    pct_any = f"regexp_extract({raw}, {q(parse.PERCENT_RE)}, 0)"
    v = f"TRY_CAST(NULLIF(regexp_extract({raw}, {q(parse.RATING_RE)}, 1), '') AS DOUBLE)"
    scale_s = (f"COALESCE(NULLIF(regexp_extract({raw}, {q(parse.RATING_RE)}, 2), ''), "
               f"NULLIF(regexp_extract({raw}, {q(parse.RATING_RE)}, 3), ''))")
    scale = f"TRY_CAST({scale_s} AS DOUBLE)"
    scaled = (f"(CASE WHEN {scale} IS NOT NULL AND {scale} <> 5 THEN {sql_r2(f'{v} / {scale} * 5')} "
              f"WHEN {scale} IS NOT NULL THEN {v} WHEN {v} > 5 THEN {sql_r2(f'{v} / 10 * 5')} ELSE {v} END)")
    clamped = sql_r2(f"least(5.0, greatest(0.0, {scaled}))")
    bad = f"({scale_s} IS NOT NULL AND ({scale} IS NULL OR {scale} = 0))"
    return (f"(CASE WHEN {pct} IS NOT NULL THEN {sql_r2(f'{pct} / 20')} WHEN {pct_any} <> '' THEN NULL "
            f"WHEN {bad} OR {v} IS NULL THEN NULL ELSE {clamped} END)")


def sql_rating_count(x: str) -> str:
    n = f"NULLIF(regexp_extract({x}, {q(parse.COUNT_RE)}, 1), '')"
    return f"TRY_CAST(replace({n}, ',', '') AS BIGINT)"


_URL_RE = url._URL_RE


def sql_normalize_url(x: str) -> str:
    u = f"lower(trim({x}))"
    scheme = f"regexp_extract({u}, {q(_URL_RE)}, 1)"
    netloc = f"regexp_extract({u}, {q(_URL_RE)}, 2)"
    path = (f"regexp_replace(regexp_replace(regexp_extract({u}, {q(_URL_RE)}, 3), ';[^/]*$', ''), '/+$', '')")
    query_ = f"regexp_extract({u}, {q(_URL_RE)}, 4)"
    tracking = "[" + ", ".join(q(p.lower()) for p in url.TRACKING_PARAMS) + "]"
    dec = lambda e: f"COALESCE(TRY(url_decode(replace({e}, '+', ' '))), {e})"
    enc = lambda e: f"replace(url_encode({e}), '%20', '+')"
    kv = (f"list_transform(list_filter(string_split({query_}, '&'), lambda s: contains(s, '=')), "
          f"lambda s, i: {{'pos': i, 'k': {dec('split_part(s, ' + q('=') + ', 1)')}, "
          f"'v': {dec('substr(s, instr(s, ' + q('=') + ') + 1)')}}})")
    kept = f"list_filter({kv}, lambda e: e.v <> '' AND NOT list_contains({tracking}, e.k))"
    ordered = (f"list_sort(list_transform({kept}, lambda e: {{'first': list_position(list_transform({kept}, "
               f"lambda z: z.k), e.k), 'pos': e.pos, 'k': e.k, 'v': e.v}}))")
    qs = f"array_to_string(list_transform({ordered}, lambda e: {enc('e.k')} || '=' || {enc('e.v')}), '&')"
    sch = f"(CASE WHEN {scheme} = '' THEN 'https' ELSE {scheme} END)"
    with_net = f"({netloc} <> '' OR {sch} IN ('http', 'https', 'ftp'))"
    path2 = f"(CASE WHEN {with_net} AND {path} <> '' AND NOT starts_with({path}, '/') THEN '/' || {path} ELSE {path} END)"
    base = f"({sch} || ':' || (CASE WHEN {with_net} THEN '//' || {netloc} ELSE '' END) || {path2})"
    out = f"(CASE WHEN {qs} <> '' THEN {base} || '?' || {qs} ELSE {base} END)"
    return f"(CASE WHEN {x} IS NULL OR {u} = '' THEN '' ELSE {out} END)"


def sql_clean_token(x: str) -> str:
    return f"regexp_replace(lower(COALESCE({x}, '')), '[^a-z0-9]+', '', 'g')"


def sql_field_fp(brand, name, model_number, price, cat) -> str:
    model = f"(CASE WHEN COALESCE({model_number}, '') <> '' THEN {model_number} ELSE COALESCE({name}, '') END)"
    p = f"(CASE WHEN {price} IS NULL OR {price} = 0 THEN '' ELSE CAST(CAST(round_even({price}, 0) AS BIGINT) AS VARCHAR) END)"
    key = f"concat_ws('|', {sql_clean_token(brand)}, {sql_clean_token(model)}, {sql_clean_token(cat)}, {p})"
    return f"substr(sha256({key}), 1, 16)"


def sql_brand(b, n) -> str:
    bl, nl = f"lower(COALESCE({b}, ''))", f"lower(COALESCE({n}, ''))"
    cases = [f"WHEN contains({bl}, {q(a)}) THEN {q(c)}" for a, c in sku.BRAND_ALIASES]
    cases += [f"WHEN contains({nl}, {q(a)}) THEN {q(c)}" for a, c in sku.BRAND_ALIASES]
    fallback = f"(CASE WHEN COALESCE({b}, '') <> '' THEN {sql_slug(b)} ELSE 'unknown' END)"
    return f"(CASE {' '.join(cases)} ELSE {fallback} END)"


_STORAGE = sku.STORAGE_RE.replace("(?iU)", "(?i)")
_COLOUR = sku.COLOUR_RE.replace("(?iU)", "(?i)")


def sql_model(b, model_number, name) -> str:
    src = f"(CASE WHEN COALESCE({model_number}, '') <> '' THEN {model_number} ELSE COALESCE({name}, '') END)"
    bl = f"lower(COALESCE({b}, ''))"
    lead = f"regexp_replace({src}, '^\\s+', '')"
    stripped = f"(CASE WHEN starts_with(lower({lead}), {bl}) THEN substr({lead}, length({bl}) + 1) ELSE {lead} END)"
    c = f"trim(regexp_replace({stripped}, '^\\s+', ''))"
    c = f"regexp_replace({c}, {q(_STORAGE)}, '', 'g')"
    c = f"regexp_replace({c}, {q(_COLOUR)}, '', 'g')"
    c = f"regexp_replace({c}, {q(sku.BRACKETS_RE)}, '', 'g')"
    slug = sql_slug(c)
    return f"(CASE WHEN {src} = '' THEN 'unknown-model' WHEN {slug} <> '' THEN {slug} ELSE {sql_slug(src)} END)"


def sql_variant(name, hint) -> str:
    text = f"(COALESCE({name}, '') || ' ' || COALESCE({hint}, ''))"
    amounts = f"regexp_extract_all({text}, {q(_STORAGE)}, 1)[1:2]"
    units = f"regexp_extract_all({text}, {q(_STORAGE)}, 2)"
    storage = f"list_transform({amounts}, lambda a, i: a || lower({units}[i]))"
    colour = f"lower(regexp_extract({text}, {q(_COLOUR)}, 1))"
    parts = f"list_concat({storage}, CASE WHEN {colour} <> '' THEN [{colour}] ELSE []::VARCHAR[] END)"
    return f"array_to_string({parts}, '-')"


def sql_sku_id(b, m, v) -> str:
    return f"concat_ws(':', NULLIF({b}, ''), NULLIF({m}, ''), NULLIF({v}, ''))"


# ---------------------------------------------------------------- SQL of the catalogue plan

PRODUCTS_SQL = f"""
products AS (SELECT listing_id AS seq, 'product' AS content_type, url, source_domain, seed_category,
  substr(trim(regexp_replace(product_name, '\\s+', ' ', 'g')), 1, 500) AS product_name,
  trim(regexp_replace(brand, '\\s+', ' ', 'g')) AS brand,
  trim(regexp_replace(model_number, '\\s+', ' ', 'g')) AS model_number, '' AS sku_hint,
  {sql_price_amount('price_raw')} AS price_amount, {sql_currency('price_raw')} AS price_currency,
  {sql_rating('rating_raw')} AS rating_value, {sql_rating_count('review_count_raw')} AS rating_count
  FROM listings),
fp AS (SELECT *, {sql_field_fp('brand', 'product_name', 'model_number', 'price_amount', 'seed_category')} AS content_hash,
  (CASE WHEN url <> '' THEN 1 ELSE 0 END) + (CASE WHEN source_domain <> '' THEN 1 ELSE 0 END)
  + (CASE WHEN seed_category <> '' THEN 1 ELSE 0 END) + (CASE WHEN product_name <> '' THEN 1 ELSE 0 END)
  + (CASE WHEN brand <> '' THEN 1 ELSE 0 END) + (CASE WHEN model_number <> '' THEN 1 ELSE 0 END) + 1 + 2 AS richness
  FROM products),
dedup AS (SELECT content_hash,
  {sql_normalize_url('first(url ORDER BY richness DESC, seq)')} AS url_normalized,
  list_sort(list_distinct(list({sql_normalize_url('url')}) FILTER (WHERE url <> ''))) AS source_urls,
  'product' AS content_type,
  first(seed_category ORDER BY richness DESC, seq) AS seed_category,
  first(source_domain ORDER BY richness DESC, seq) AS source_domain,
  COALESCE(first(product_name ORDER BY richness DESC, seq) FILTER (WHERE product_name <> ''), '') AS product_name,
  COALESCE(first(brand ORDER BY richness DESC, seq) FILTER (WHERE brand <> ''), '') AS brand,
  COALESCE(first(model_number ORDER BY richness DESC, seq) FILTER (WHERE model_number <> ''), '') AS model_number,
  '' AS sku_hint, '' AS description, '' AS availability,
  first(price_amount ORDER BY richness DESC, seq) AS price_amount,
  first(price_currency ORDER BY richness DESC, seq) AS price_currency,
  first(rating_value ORDER BY richness DESC, seq) AS rating_value,
  first(rating_count ORDER BY richness DESC, seq) AS rating_count,
  COUNT(*) AS merged_count, MIN(seq) AS seq
  FROM fp GROUP BY content_hash),
skurow AS (SELECT *, {sql_brand('brand', 'product_name')} AS sku_brand,
  {sql_model('brand', 'model_number', 'product_name')} AS sku_model,
  {sql_variant('product_name', 'sku_hint')} AS sku_variant FROM dedup),
skurow2 AS (SELECT *, {sql_sku_id('sku_brand', 'sku_model', 'sku_variant')} AS sku_id,
  rating_value IS NOT NULL AND rating_value <> 0 AS rated,
  CASE WHEN COALESCE(rating_count, 0) <> 0 THEN rating_count ELSE 1 END AS w FROM skurow),
skus AS (SELECT sku_id, first(sku_brand ORDER BY seq) AS brand, first(sku_model ORDER BY seq) AS model,
  first(sku_variant ORDER BY seq) AS variant,
  COALESCE(first(seed_category ORDER BY seq) FILTER (WHERE seed_category <> ''), '') AS category,
  MIN(price_amount) AS price_min, MAX(price_amount) AS price_max,
  first(price_currency ORDER BY seq) AS price_currency,
  CASE WHEN SUM(CASE WHEN rated THEN w END) IS NOT NULL
    THEN {R("SUM(CASE WHEN rated THEN rating_value * w END) / SUM(CASE WHEN rated THEN w END)", 2)}
    ELSE MAX(rating_value) END AS rating_avg,
  CAST(SUM(COALESCE(rating_count, 0)) AS BIGINT) AS rating_count_total,
  list_sort(list_distinct(flatten(list(source_urls)))) AS source_urls,
  list_sort(list_distinct(list(NULLIF(source_domain, '')) FILTER (WHERE NULLIF(source_domain, '') IS NOT NULL))) AS source_domains,
  list_sort(list_distinct(list(NULLIF(product_name, '')) FILTER (WHERE NULLIF(product_name, '') IS NOT NULL))) AS product_names,
  MIN(seq) AS seq
  FROM skurow2 GROUP BY sku_id),
levels AS (SELECT sku_id, COALESCE(NULLIF(category, ''), 'uncategorized') AS category,
  COALESCE(NULLIF(brand, ''), 'unknown') AS brand, COALESCE(NULLIF(model, ''), 'unknown-model') AS model,
  COALESCE(NULLIF(variant, ''), 'base') AS variant, price_min, price_max, price_currency, rating_avg,
  rating_count_total, source_urls, source_domains FROM skus)"""

CATALOG = f"WITH {fx.LISTINGS_CTE},{PRODUCTS_SQL}"


def _products(spark, sf):
    return catalog.products_from_listings(fx.listings(spark, sf))


def _dedup(spark, sf):
    return catalog.dedup_products(_products(spark, sf))


def _skus(spark, sf):
    return catalog.build_skus(_dedup(spark, sf))


def _j(c):
    return F.array_join(F.col(c), " ").alias(c)


# ---------------------------------------------------------------- scalar queries over listings


@query("parse_listing_fields", f"""WITH {fx.LISTINGS_CTE}
SELECT listing_id, {sql_price_amount('price_raw')} AS price_amount, {sql_currency('price_raw')} AS price_currency,
  {sql_rating('rating_raw')} AS rating_value, {sql_rating_count('review_count_raw')} AS rating_count,
  {sql_normalize_url('url')} AS url_normalized, substr(sha256({sql_normalize_url('url')}), 1, 16) AS url_fp,
  {sql_slug('product_name')} AS name_slug
FROM listings""")
def q_parse_listing_fields(spark, sf):
    """G2, G3, G4, G5, G6, G8 over every listing."""
    ls = fx.listings(spark, sf)
    p = parse.c_price("price_raw")
    return ls.select("listing_id", p["amount"].alias("price_amount"), p["currency"].alias("price_currency"),
                     parse.c_rating("rating_raw").alias("rating_value"),
                     parse.c_rating_count("review_count_raw").alias("rating_count"),
                     url.c_normalize_url("url").alias("url_normalized"), url.c_url_fp("url").alias("url_fp"),
                     c_slug("product_name").alias("name_slug"))


@query("sku_fields", f"""WITH {fx.LISTINGS_CTE}
SELECT listing_id, {sql_field_fp('brand', 'product_name', 'model_number', sql_price_amount('price_raw'), 'seed_category')} AS content_hash,
  {sql_brand('brand', 'product_name')} AS sku_brand, {sql_model('brand', 'model_number', 'product_name')} AS sku_model,
  {sql_variant('product_name', "''")} AS sku_variant,
  {sql_sku_id(sql_brand('brand', 'product_name'), sql_model('brand', 'model_number', 'product_name'), sql_variant('product_name', "''"))} AS sku_id
FROM listings""")
def q_sku_fields(spark, sf):
    """G7, G9, G10, G11, G12 over every listing."""
    ls = fx.listings(spark, sf)
    b = sku.c_brand("brand", "product_name")
    m = sku.c_model("brand", "model_number", "product_name")
    v = sku.c_variant("product_name", F.lit(""), F.array().cast("array<string>"))
    return ls.select("listing_id",
                     sku.c_field_fp("brand", "product_name", "model_number", parse.c_price("price_raw")["amount"],
                                    "seed_category").alias("content_hash"),
                     b.alias("sku_brand"), m.alias("sku_model"), v.alias("sku_variant"),
                     sku.c_sku_id(b, m, v).alias("sku_id"))


# ---------------------------------------------------------------- D6 / D7 / F6 / D8 / D11 / I2


@query("dedup_products", f"""{CATALOG}
SELECT content_hash, url_normalized, array_to_string(source_urls, ' ') AS source_urls, content_type, seed_category,
  source_domain, product_name, brand, model_number, sku_hint, description, availability, price_amount,
  price_currency, rating_value, rating_count, merged_count FROM dedup""")
def q_dedup_products(spark, sf):
    d = _dedup(spark, sf)
    return d.select("content_hash", "url_normalized", _j("source_urls"), "content_type", "seed_category",
                    "source_domain", *catalog.FILL_FIELDS, "price_amount", "price_currency", "rating_value",
                    "rating_count", "merged_count")


@query("build_skus", f"""{CATALOG}
SELECT sku_id, brand, model, variant, category, price_min, price_max, price_currency, rating_avg, rating_count_total,
  array_to_string(source_urls, ' ') AS source_urls, array_to_string(source_domains, ' ') AS source_domains,
  array_to_string(product_names, ' ') AS product_names FROM skus""")
def q_build_skus(spark, sf):
    s = _skus(spark, sf)
    return s.select("sku_id", "brand", "model", "variant", "category", "price_min", "price_max", "price_currency",
                    "rating_avg", "rating_count_total", _j("source_urls"), _j("source_domains"), _j("product_names"))


@query("sku_links", f"""{CATALOG}
SELECT DISTINCT sku_id, u AS url_normalized FROM (SELECT sku_id, unnest(source_urls) AS u FROM skurow2)""")
def q_sku_links(spark, sf):
    """D7/F3 in flat form: distinct (sku_id, url) pairs. Records are parsed once, for the links and for their SKUs."""
    p = written_once(catalog.keyed(_products(spark, sf)), "keyed_products")
    return catalog.sku_links(p, catalog.dedup_products(p))


@query("taxonomy_flat", f"""{CATALOG}
SELECT sku_id, category, brand, model, variant, {sql_slug('variant')} AS slug, price_min, price_max, price_currency,
  rating_avg, rating_count_total, array_to_string(source_urls, ' ') AS source_urls,
  array_to_string(source_domains, ' ') AS source_domains FROM levels""")
def q_taxonomy_flat(spark, sf):
    t = catalog.taxonomy_flat(_skus(spark, sf))
    return t.select(*[c for c in t.columns if c not in ("source_urls", "source_domains")],
                    _j("source_urls"), _j("source_domains"))


@query("taxonomy_counts", f"""{CATALOG},
r AS (
  SELECT 'model' AS level, category, brand, model, COUNT(*) AS child_count, COUNT(*) AS leaves, CAST(NULL AS BIGINT) AS total_nodes
  FROM levels GROUP BY category, brand, model
  UNION ALL
  SELECT 'brand', category, brand, NULL, COUNT(DISTINCT model), COUNT(*), NULL FROM levels GROUP BY category, brand
  UNION ALL
  SELECT 'category', category, NULL, NULL, COUNT(DISTINCT brand), COUNT(*), NULL FROM levels GROUP BY category
  UNION ALL
  SELECT 'root', NULL, NULL, NULL, COUNT(DISTINCT category), COUNT(*),
    COUNT(DISTINCT category) + (SELECT COUNT(*) FROM (SELECT DISTINCT category, brand FROM levels))
    + (SELECT COUNT(*) FROM (SELECT DISTINCT category, brand, model FROM levels)) + COUNT(*) FROM levels)
SELECT level, category, brand, model, CAST(child_count AS BIGINT) AS child_count, CAST(leaves AS BIGINT) AS leaves,
  CAST(total_nodes AS BIGINT) AS total_nodes FROM r""")
def q_taxonomy_counts(spark, sf):
    return catalog.taxonomy_counts(_skus(spark, sf))


@query("taxonomy_edges", f"""{CATALOG}
SELECT 'variant' AS type, concat_ws('/', category, brand, model) AS parent, sku_id AS name, {sql_slug('variant')} AS slug, CAST(0 AS BIGINT) AS child_count FROM levels
UNION ALL SELECT 'model', concat_ws('/', category, brand), model, {sql_slug('model')}, COUNT(*) FROM levels GROUP BY category, brand, model
UNION ALL SELECT 'brand', category, brand, {sql_slug('brand')}, COUNT(DISTINCT model) FROM levels GROUP BY category, brand
UNION ALL SELECT 'category', '', category, {sql_slug('category')}, COUNT(DISTINCT brand) FROM levels GROUP BY category""")
def q_taxonomy_edges(spark, sf):
    """F5 as parent-child rows."""
    return catalog.taxonomy_edges(_skus(spark, sf))


@query("run_stats", f"""{CATALOG}
SELECT (SELECT COUNT(*) FROM products) AS input, (SELECT COUNT(*) FROM dedup) AS output,
  (SELECT COUNT(*) FROM products) - (SELECT COUNT(*) FROM dedup) AS duplicates_removed,
  (SELECT COUNT(*) FROM dedup) AS deduped_loaded, (SELECT COUNT(*) FROM skus) AS unique_skus,
  (SELECT COUNT(DISTINCT category) FROM levels) + (SELECT COUNT(*) FROM (SELECT DISTINCT category, brand FROM levels))
    + (SELECT COUNT(*) FROM (SELECT DISTINCT category, brand, model FROM levels)) + (SELECT COUNT(*) FROM levels) AS nodes,
  (SELECT COUNT(*) FROM skus) AS leaves""")
def q_run_stats(spark, sf):
    return catalog.run_stats(_dedup(spark, sf))


@query("taxonomy_tree")
def q_taxonomy_tree(spark, sf):
    """F5 nested tree (rows-only check: nested arrays of structs; gold tests in pytest)."""
    return catalog.taxonomy_tree(_skus(spark, sf))
