"""Readers (A1-A6): crawl-queue JSON, JSON-lines records, seed configs, daily actuals CSV and the
serving tables. All use declared schemas (no inference pass over the data) and permissive modes
that drop malformed records instead of failing the job."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- schemas

ACTUALS_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()), T.StructField("entity_id", T.StringType()),
    T.StructField("brand", T.StringType()), T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in
      ("demand_index", "price_index", "sentiment_index", "search_index", "ad_index")],
    T.StructField("event_type", T.StringType()), T.StructField("event_title", T.StringType()),
    T.StructField("event_description", T.StringType()), T.StructField("impact_direction", T.StringType()),
    T.StructField("event_effect_hint", T.StringType()), T.StructField("priority", T.StringType()),
    T.StructField("signal_story", T.StringType())])

USER_DATA = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("page_type", T.StringType()),
    T.StructField("seed_category", T.StringType()), T.StructField("seed_domain", T.StringType()),
    T.StructField("origin_url", T.StringType()), T.StructField("depth", T.LongType()),
    T.StructField("max_depth", T.LongType()), T.StructField("parent_url", T.StringType()),
    T.StructField("product_hint", T.StringType()), T.StructField("crawled_at", T.StringType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])

QUEUE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("uniqueKey", T.StringType()),
    T.StructField("unique_key", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("method", T.StringType()), T.StructField("userData", USER_DATA),
    T.StructField("user_data", USER_DATA), T.StructField("label", T.StringType()),
    T.StructField("retryCount", T.LongType()), T.StructField("noRetry", T.BooleanType()),
    T.StructField("loadedUrl", T.StringType()), T.StructField("handledAt", T.StringType()),
    T.StructField("handled_at", T.StringType()), T.StructField("_corrupt_record", T.StringType())])

SEED_PRODUCT = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("brand", T.StringType()),
    T.StructField("model_id", T.StringType()), T.StructField("search_keywords", T.ArrayType(T.StringType())),
    T.StructField("known_urls", T.ArrayType(T.StringType()))])
SEED_SCHEMA = T.StructType([
    T.StructField("category", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("domains", T.ArrayType(T.StringType())), T.StructField("start_urls", T.ArrayType(T.StringType())),
    T.StructField("products", T.ArrayType(SEED_PRODUCT)), T.StructField("max_depth", T.LongType()),
    T.StructField("respect_robots", T.BooleanType()), T.StructField("_corrupt_record", T.StringType())])

# Categories a seed may declare; page types known to the crawler.
KNOWN_CATEGORIES = ["smartphones", "laptops", "tablets", "headphones", "earbuds", "smartwatches",
                    "bluetooth_speakers", "power_banks", "cameras", "televisions"]
GLOBAL_MAX_DEPTH = 4


def read_crawl_queue(spark: SparkSession, path: str, categories=None) -> DataFrame:
    """A1: crawl-queue request JSON files (one object per file, nested ``userData`` or
    ``user_data``), read recursively. Bad JSON and entries without url are dropped; page type is
    ``page_type``, else the label minus ``queue_``, else ``unknown``; domain defaults to the URL
    host. Handled and unhandled entries are both kept."""
    raw = (spark.read.schema(QUEUE_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
           .option("pathGlobFilter", "*.json").json(path))
    ud = F.coalesce(F.col("userData"), F.col("user_data"))
    label = F.coalesce(ud.getField("label"), F.col("label"))
    page_type = F.coalesce(F.nullif(ud.getField("page_type"), F.lit("")),
                           F.nullif(F.regexp_replace(label, r"^queue_", ""), F.lit("")), F.lit("unknown"))
    host = F.expr("try_parse_url(url, 'HOST')")
    df = (raw.filter(F.col("_corrupt_record").isNull() & F.col("url").isNotNull() & (F.trim("url") != ""))
          .select(F.coalesce("uniqueKey", "unique_key", "url").alias("unique_key"), "url",
                  F.coalesce("method", F.lit("GET")).alias("method"),
                  page_type.alias("page_type"),
                  F.coalesce(ud.getField("seed_category"), F.lit("")).alias("seed_category"),
                  F.coalesce(F.nullif(ud.getField("seed_domain"), F.lit("")), host, F.lit("")).alias("seed_domain"),
                  ud.getField("origin_url").alias("origin_url"),
                  F.coalesce(ud.getField("depth"), F.lit(0)).alias("depth"),
                  ud.getField("max_depth").alias("max_depth"),
                  ud.getField("parent_url").alias("parent_url"),
                  ud.getField("product_hint").alias("product_hint"),
                  F.coalesce("handledAt", "handled_at").alias("handled_at"),
                  F.input_file_name().alias("source_file")))
    if categories:
        df = df.filter(F.col("seed_category").isin(list(categories)))
    return df


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A2: JSON lines with a declared schema; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_seeds(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A3: seed config files (one JSON object each). Invalid seeds (unknown category, depth outside
    1..10, a non-absolute start URL, unparsable file) are dropped whole. Domains lose their scheme.
    Returns ``seeds``, ``products`` (one row per seed product) and ``keywords`` (one row per
    keyword, with its order inside the seed)."""
    raw = (spark.read.schema(SEED_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
           .withColumn("seed_file", F.input_file_name()))
    absolute = F.forall(F.coalesce("start_urls", F.array()), lambda u: u.rlike(r"^https?://[^/\s]+"))
    ok = (F.col("_corrupt_record").isNull() & F.lower("category").isin(KNOWN_CATEGORIES)
          & F.col("max_depth").between(1, 10) & absolute)
    seeds = raw.filter(ok).select(
        "seed_file", F.lower("category").alias("category"), "version",
        F.transform(F.coalesce("domains", F.array()),
                    lambda d: F.regexp_replace(F.lower(F.trim(d)), r"^https?://|/+$", "")).alias("domains"),
        "start_urls", "products", "max_depth", "respect_robots")
    products = seeds.select("seed_file", "category", F.posexplode("products").alias("product_ord", "p")) \
        .select("seed_file", "category", "product_ord", "p.*")
    keywords = products.select("seed_file", "category", "product_ord", "model_id",
                               F.posexplode(F.coalesce("search_keywords", F.array())).alias("kw_ord", "keyword"))
    return {"seeds": seeds, "products": products, "keywords": keywords}


def seed_frontier(seeds: DataFrame, global_max_depth: int = GLOBAL_MAX_DEPTH) -> DataFrame:
    """A4: one request per start URL at depth 0; effective max depth = min(seed, global)."""
    return seeds.select("category", F.explode("start_urls").alias("url"), "max_depth") \
        .select("url", F.col("category").alias("seed_category"),
                F.expr("try_parse_url(url, 'HOST')").alias("seed_domain"),
                F.col("url").alias("origin_url"), F.lit(0).cast("bigint").alias("depth"),
                F.least(F.col("max_depth"), F.lit(global_max_depth)).alias("max_depth"),
                F.lit(None).cast("string").alias("parent_url"), F.lit("SEED").alias("page_type"))


def read_actuals(spark: SparkSession, path: str) -> DataFrame:
    """A5: daily actuals CSV (declared schema, all strings), date normalised to a DATE, numbers
    cast with ``try_cast`` (bad -> NULL) and, as in the reference's log, missing numbers -> 0 and
    missing strings -> ''."""
    raw = spark.read.schema(ACTUALS_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)
    num = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = F.coalesce(F.expr("try_to_date(date, 'yyyy-MM-dd')"), F.expr("try_to_date(date, 'yyyy/MM/dd')"),
                   F.expr("try_to_date(date, 'dd-MM-yyyy')"), F.col("date").try_cast("timestamp").cast("date"))
    return raw.select(d.alias("date"), F.col("entity_id").try_cast("bigint").alias("entity_id"),
                      s("brand").alias("brand"), s("product_name").alias("product_name"),
                      s("category").alias("category"),
                      *[num(c).alias(c) for c in
                        ("demand_index", "price_index", "sentiment_index", "search_index", "ad_index")],
                      *[s(c).alias(c) for c in ("event_type", "event_title", "event_description",
                                                "impact_direction", "event_effect_hint", "priority",
                                                "signal_story")]) \
        .filter(F.col("date").isNotNull())


def read_if_any(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame | None:
    """A Parquet table, or None where the path does not exist or holds no file yet. Spark itself looks the
    path up, so any URI that Spark can read will do. Folders below the path are read too where a schema is given."""
    try:
        if schema is not None:
            return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


SERVING_TABLES = ("master", "forecast", "daily", "explanations", "alerts", "markers", "regime", "events")


def load_serving(spark: SparkSession, base_dir: str, schemas: dict[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """The serving tables as DataFrames; a missing table is an empty DataFrame (of its schema
    when one is given). Where the tick writes them (``sources.snapshots``), all are of the same commit."""
    from .snapshots import Snapshots
    store = Snapshots(spark, base_dir)
    at = store.entry()
    out = {}
    for name in SERVING_TABLES:
        if at is None:
            found = read_if_any(spark, f"{base_dir.rstrip('/')}/{name}")
        else:
            found = store.table({"forecast": "predictions"}.get(name, name), at)
        out[name] = spark.createDataFrame([], (schemas or {}).get(name, T.StructType([]))) if found is None else found
    return out


def next_date(actuals: DataFrame, pointer) -> DataFrame:
    """E5: the first date strictly after the pointer (NULL when exhausted)."""
    return actuals.filter(F.col("date") > F.lit(pointer).cast("date")).agg(F.min("date").alias("next_date"))


def ingest_date(actuals: DataFrame, date) -> DataFrame:
    """E5: all rows of one date (partition-pruned when the table is partitioned by date)."""
    return actuals.filter(F.col("date") == F.lit(date).cast("date"))


def ingest_order(actuals: DataFrame) -> DataFrame:
    """E5 for every pointer at once: per ingested date its row count and the next date. The
    window runs over the per-date table (one row per date)."""
    per = actuals.groupBy("date").agg(F.count(F.lit(1)).alias("rows_ingested"))
    return per.withColumn("next_date", F.lead("date").over(Window.orderBy("date")))
