"""The two derived inputs every panel / catalogue operator reads.

``actuals`` (the daily entity panel) is built from ``events``; ``listings`` (scraped product
records) from ``lineitem`` x ``part``. Both are plain DataFrame plans over the driver tables,
so their size grows with the data. The SQL text of the same views is kept next to them: the
DuckDB oracles in :mod:`shelfspark.plans.oracles` inline it as CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Category of an entity is chosen by entity_id % 7 in this order.
CATEGORIES = ["earbuds", "headphones", "smartphones", "smartwatches", "bluetooth_speakers",
              "tablets", "power_banks"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cat_of(c):
    e = F.lit(CATEGORIES[-1])
    for i in reversed(range(len(CATEGORIES) - 1)):
        e = F.when(c % 7 == i, F.lit(CATEGORIES[i])).otherwise(e)
    return e


def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel: one row per (entity_id, date) with the five indices and event columns.

    One aggregation over ``events`` (partial aggregation map-side, one shuffle on the key)."""
    ev = table(spark, sf_dir, "events")
    d = ev.select(
        F.col("user_id").cast("bigint").alias("entity_id"),
        F.to_date("ts").alias("date"),
        "event_id", "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    is_ = lambda t: F.col("event_type") == t
    g = d.groupBy("entity_id", "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("cents").alias("c"),
        F.sum(F.when(is_("purchase"), F.col("cents"))).alias("pc"),
        F.sum(F.when(is_("purchase"), 1).otherwise(0)).alias("np"),
        F.sum(F.when(is_("error"), 1).otherwise(0)).alias("ne"),
        F.sum(F.when(is_("view"), 1).otherwise(0)).alias("nv"),
        F.sum(F.when(is_("click"), 1).otherwise(0)).alias("nc"),
        F.max_by("event_type", "event_id").alias("event_type"))
    n, np_, ne = F.col("n"), F.col("np"), F.col("ne")
    et = F.col("event_type")
    return g.select(
        "entity_id", "date",
        F.concat(F.lit("Brand#"), (F.col("entity_id") % 25 + 1).cast("string")).alias("brand"),
        F.concat(F.lit("Model "), F.col("entity_id").cast("string")).alias("product_name"),
        _cat_of(F.col("entity_id")).alias("category"),
        (F.col("c").cast("double") / (100 * n)).alias("demand_index"),
        F.when(np_ > 0, F.col("pc").cast("double") / (100 * np_)).alias("price_index"),
        (1 - ne.cast("double") / n).alias("sentiment_index"),
        ((100 * F.col("nv")).cast("double") / n).alias("search_index"),
        ((100 * F.col("nc")).cast("double") / n).alias("ad_index"),
        et.alias("event_type"),
        F.concat(F.lit("Burst of "), et).alias("event_title"),
        F.concat(et, F.lit(" seen")).alias("event_description"),
        F.when(np_ > ne, "positive").when(np_ < ne, "negative").otherwise("neutral").alias("impact_direction"),
        F.when(np_ > ne, "demand uplift").when(np_ < ne, "demand softness").otherwise("").alias("event_effect_hint"),
        F.when(n >= 4, "high").otherwise("normal").alias("priority"),
        F.concat(F.lit("n="), n.cast("string")).alias("signal_story"))


# Listings of a task. A pair of keys is a few bytes in the shuffle and its listing hundreds, which the jobs behind sort by
# fingerprint: tasks sized by the bytes of the pairs would sort gigabytes.
LISTINGS_A_TASK = 200_000


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped product listings: one per distinct (part, supplier) pair of ``lineitem``."""
    sold = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    tasks = max(spark.sparkContext.defaultParallelism, -(-sold.count() // LISTINGS_A_TASK))
    li = sold.distinct().repartition(tasks, "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size",
                                               "p_retailprice")
    j = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    s, pk = F.col("l_suppkey"), F.col("p_partkey").cast("string")
    shop = F.concat(F.lit("www.shop"), (s % 5).cast("string"), F.lit(".example.com"))
    return j.select(
        (F.col("l_partkey") * 1000 + s).cast("bigint").alias("listing_id"),
        F.concat(F.lit("https://"), shop, F.lit("/product/"), pk, F.lit("/?utm_source=feed&sku="), pk).alias("url"),
        shop.alias("source_domain"),
        F.lower("p_type").alias("seed_category"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("GB")).alias("product_name"),
        F.when(s % 4 == 0, "").otherwise(F.col("p_brand")).alias("brand"),
        F.when(s % 3 == 0, F.concat(F.lit("M-"), (F.col("p_partkey") % 500).cast("string"))).otherwise("")
        .alias("model_number"),
        F.when(s % 2 == 0, F.concat(F.lit("Rs. "), F.floor("p_retailprice").cast("bigint").cast("string")))
        .otherwise("").alias("price_raw"),
        F.when(s % 4 == 0, "4.2 out of 5").when(s % 4 == 1, "84%").when(s % 4 == 2, "8.4/10").otherwise("")
        .alias("rating_raw"),
        F.concat(s.cast("string"), F.lit(" ratings")).alias("review_count_raw"))


# --- SQL text of the same views (DuckDB dialect), used by the oracles --------------------------

ACTUALS_CTE = """
_ev AS (
  SELECT CAST(user_id AS BIGINT) AS entity_id, CAST(ts AS DATE) AS date, event_id, event_type,
         CAST(ROUND(value*100) AS BIGINT) AS cents FROM events),
_evg AS (
  SELECT entity_id, date, COUNT(*) AS n, SUM(cents) AS c,
         SUM(CASE WHEN event_type='purchase' THEN cents END) AS pc,
         SUM(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) AS np,
         SUM(CASE WHEN event_type='error' THEN 1 ELSE 0 END) AS ne,
         SUM(CASE WHEN event_type='view' THEN 1 ELSE 0 END) AS nv,
         SUM(CASE WHEN event_type='click' THEN 1 ELSE 0 END) AS nc,
         max_by(event_type, event_id) AS event_type
  FROM _ev GROUP BY entity_id, date),
actuals AS (
SELECT entity_id, date,
  CONCAT('Brand#', CAST(entity_id % 25 + 1 AS VARCHAR(10))) AS brand,
  CONCAT('Model ', CAST(entity_id AS VARCHAR(10))) AS product_name,
  CASE entity_id % 7 WHEN 0 THEN 'earbuds' WHEN 1 THEN 'headphones' WHEN 2 THEN 'smartphones'
    WHEN 3 THEN 'smartwatches' WHEN 4 THEN 'bluetooth_speakers' WHEN 5 THEN 'tablets' ELSE 'power_banks' END AS category,
  CAST(c AS DOUBLE)/(100*n) AS demand_index,
  CASE WHEN np > 0 THEN CAST(pc AS DOUBLE)/(100*np) END AS price_index,
  1 - CAST(ne AS DOUBLE)/n AS sentiment_index,
  CAST(100*nv AS DOUBLE)/n AS search_index,
  CAST(100*nc AS DOUBLE)/n AS ad_index,
  event_type, CONCAT('Burst of ', event_type) AS event_title, CONCAT(event_type,' seen') AS event_description,
  CASE WHEN np > ne THEN 'positive' WHEN np < ne THEN 'negative' ELSE 'neutral' END AS impact_direction,
  CASE WHEN np > ne THEN 'demand uplift' WHEN np < ne THEN 'demand softness' ELSE '' END AS event_effect_hint,
  CASE WHEN n >= 4 THEN 'high' ELSE 'normal' END AS priority,
  CONCAT('n=', CAST(n AS VARCHAR(10))) AS signal_story
FROM _evg)"""

LISTINGS_CTE = """
_ls AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
listings AS (
SELECT CAST(l_partkey*1000 + l_suppkey AS BIGINT) AS listing_id,
  CONCAT('https://www.shop', CAST(l_suppkey % 5 AS VARCHAR(10)), '.example.com/product/', CAST(p_partkey AS VARCHAR(10)),
         '/?utm_source=feed&sku=', CAST(p_partkey AS VARCHAR(10))) AS url,
  CONCAT('www.shop', CAST(l_suppkey % 5 AS VARCHAR(10)), '.example.com') AS source_domain,
  LOWER(p_type) AS seed_category,
  CONCAT(p_name, ' ', CAST(p_size AS VARCHAR(10)), 'GB') AS product_name,
  CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE p_brand END AS brand,
  CASE WHEN l_suppkey % 3 = 0 THEN CONCAT('M-', CAST(p_partkey % 500 AS VARCHAR(10))) ELSE '' END AS model_number,
  CASE WHEN l_suppkey % 2 = 0 THEN CONCAT('Rs. ', CAST(CAST(FLOOR(p_retailprice) AS BIGINT) AS VARCHAR(12))) ELSE '' END AS price_raw,
  CASE l_suppkey % 4 WHEN 0 THEN '4.2 out of 5' WHEN 1 THEN '84%' WHEN 2 THEN '8.4/10' ELSE '' END AS rating_raw,
  CONCAT(CAST(l_suppkey AS VARCHAR(10)), ' ratings') AS review_count_raw
FROM _ls JOIN part ON l_partkey = p_partkey)"""
