"""Readers and writers (A1-A10), the extension surface (2.L) and the model operators."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF0001
from shelfspark import fixtures as fx
from shelfspark.functions import classify as cl
from shelfspark.operators import catalog, models
from shelfspark.sources import readers, writers


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_crawl_queue(spark, tmpdir_path):
    q = os.path.join(tmpdir_path, "queue")
    _write(f"{q}/a/1.json", json.dumps({"uniqueKey": "k1", "url": "https://www.amazon.in/dp/B0ABCDEFGH",
                                        "userData": {"label": "queue_product_page", "seed_category": "smartphones",
                                                     "depth": 1, "max_depth": 4}, "handledAt": "2024-01-01"}))
    _write(f"{q}/b/2.json", json.dumps({"unique_key": "k2", "url": "https://x.example.com/c",
                                        "user_data": {"page_type": "category_page", "seed_category": "laptops",
                                                      "seed_domain": "x.example.com"}}))
    _write(f"{q}/b/3.json", "{not json")
    _write(f"{q}/b/4.json", json.dumps({"uniqueKey": "k4", "userData": {"label": "x"}}))      # no url
    df = readers.read_crawl_queue(spark, q)
    got = {r.unique_key: (r.page_type, r.seed_domain, r.seed_category) for r in df.collect()}
    assert got == {"k1": ("product_page", "www.amazon.in", "smartphones"),
                   "k2": ("category_page", "x.example.com", "laptops")}
    assert readers.read_crawl_queue(spark, q, categories=["laptops"]).count() == 1


def test_read_seeds_and_frontier(spark, tmpdir_path):
    s = os.path.join(tmpdir_path, "seeds")
    good = {"category": "smartphones", "version": "1", "domains": ["https://www.Amazon.in/", "flipkart.com"],
            "start_urls": ["https://www.amazon.in/s?k=phones"], "max_depth": 6,
            "products": [{"name": "Galaxy S24", "brand": "Samsung", "model_id": "galaxy-s24",
                          "search_keywords": ["s24", "galaxy s24"], "known_urls": []}]}
    bad = dict(good, max_depth=11)
    _write(f"{s}/good.json", json.dumps(good))
    _write(f"{s}/bad.json", json.dumps(bad))
    out = readers.read_seeds(spark, s)
    seeds = out["seeds"].collect()
    assert len(seeds) == 1 and seeds[0].domains == ["www.amazon.in", "flipkart.com"]
    assert [r.keyword for r in out["keywords"].orderBy("kw_ord").collect()] == ["s24", "galaxy s24"]
    fr = readers.seed_frontier(out["seeds"]).first()
    assert (fr.depth, fr.max_depth, fr.seed_domain) == (0, 4, "www.amazon.in")


def test_read_actuals_csv_and_ingest(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "query.csv")
    _write(p, "date,entity_id,brand,product_name,category,demand_index,price_index,sentiment_index,search_index,"
              "ad_index,event_type,event_title,event_description,impact_direction,event_effect_hint,priority,signal_story\n"
              "2024-01-02,1,B,P,c,10,,0.5,40,x,view,t,d,positive,uplift,high,s\n"
              "2024/01/01,2,B,P,c,20,5,0.5,40,30,view,t,d,neutral,,normal,s\n")
    a = readers.read_actuals(spark, p)
    rows = {r.entity_id: r for r in a.collect()}
    assert str(rows[2].date) == "2024-01-01" and rows[1].price_index == 0.0 and rows[1].ad_index == 0.0
    assert str(readers.next_date(a, "2024-01-01").first()[0]) == "2024-01-02"
    assert readers.ingest_date(a, "2024-01-02").count() == 1


def test_read_records_drops_bad_lines(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "products.jsonl")
    _write(p, '{"url": "a", "brand": "x"}\n\nnot json\n{"url": "b"}\n')
    df = readers.read_records(spark, p, "url string, brand string")
    assert sorted(r.url for r in df.collect()) == ["a", "b"]


def test_writers(spark, tmpdir_path):
    recs = spark.createDataFrame([("products", '{"a":1}'), ("reviews", '{"b":2}'), ("unclassified", '{"c":3}')],
                                 "output string, value string")
    out = os.path.join(tmpdir_path, "out")
    writers.write_by_type(recs, out)
    writers.write_by_type(recs, out)            # append
    assert sorted(n for n in os.listdir(out) if n.startswith("output=")) == \
        ["output=products", "output=reviews", "output=unclassified"]
    assert spark.read.text(f"{out}/output=products").count() == 2
    # keyed upsert: only the touched date partition is rewritten, last row per key wins
    t = os.path.join(tmpdir_path, "master")
    import datetime as dt
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    first = spark.createDataFrame([(1, d1, "a"), (2, d2, "b")], "entity_id int, date date, v string")
    writers.upsert_table(spark, t, first, ["entity_id", "date"])
    writers.upsert_table(spark, t, spark.createDataFrame([(2, d2, "B"), (3, d2, "c")], "entity_id int, date date, v string"),
                         ["entity_id", "date"])
    got = sorted((r.entity_id, str(r.date), r.v) for r in spark.read.parquet(t).collect())
    assert got == [(1, "2024-01-01", "a"), (2, "2024-01-02", "B"), (3, "2024-01-02", "c")]
    # the same on a URI: nothing that is stored is lost
    u = f"file://{tmpdir_path}/master_uri"
    for rows in (first, spark.createDataFrame([(5, d1, "e")], first.schema)):
        writers.upsert_table(spark, u, rows, ["entity_id", "date"])
    assert sorted(r.entity_id for r in spark.read.parquet(u).collect()) == [1, 2, 5]
    assert readers.load_serving(spark, f"file://{tmpdir_path}")["master"].count() == 3


def test_write_catalog_and_load_serving(spark, tmpdir_path):
    p = catalog.products_from_listings(fx.listings(spark, SF0001))
    d = catalog.dedup_products(p)
    s = catalog.build_skus(d)
    out = os.path.join(tmpdir_path, "cat")
    stats = writers.write_catalog(d, s, out)
    want = catalog.run_stats(d).first()
    assert all(stats[n] == want[n] for n in ("input", "output", "duplicates_removed", "unique_skus", "leaves")) and stats["input"] == p.count()
    assert stats["categories"] == spark.read.json(f"{out}/hierarchy").count()
    assert spark.read.json(f"{out}/sku_registry").count() == s.count()
    assert spark.read.json(f"{out}/hierarchy_flat").count() == s.count()
    serving = readers.load_serving(spark, tmpdir_path)
    assert serving["master"].count() == 0         # missing table = empty


def test_records_are_counted_by_their_own_write(spark, tmpdir_path):
    rows = [("products", "{}")] * 7 + [("ads", "{}"), ("ads", None), ("strange", "{}"), (None, "{}")]
    df = spark.createDataFrame(rows, "output string, value string").repartition(3)
    want = {"records": 11, "products": 7, "reviews": 0, "ads": 2, "trends": 0, "unclassified": 0, "other": 2, "blank": 1}
    assert writers.write_by_type(df, f"{tmpdir_path}/a") == want
    assert writers.write_by_type(df, f"{tmpdir_path}/a") == want                     # the second write counts its own records
    assert spark.read.text(f"{tmpdir_path}/a").count() == 22
    for none in (df.limit(0), df.filter("output = 'nothing'")):
        assert set(writers.write_by_type(none, f"{tmpdir_path}/b").values()) == {0}


def test_page_rules_extension(spark):
    rules = cl.PageRules(url=[(r"(?i)/deal/", cl.AD)] + cl.URL_RULES)
    df = spark.createDataFrame([("https://x.com/deal/1",), ("https://x.com/product/a",)], "u string")
    assert [r[0] for r in df.select(cl.c_page_type_url("u", rules)).collect()] == ["ad_creative", "product_page"]


def test_model_fit_has_tasks_by_rows(spark, monkeypatch):
    """A fit is hundreds of jobs: few rows in many partitions must not make as many tasks in each."""
    seen = []
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count())))
    train = spark.range(400).select(*[F.col("id").cast("double").alias(c) for c in [models.TARGET, *models.FEATURES]]).repartition(40)
    models.fit_demand_model(train)
    monkeypatch.setattr(models, "FIT_ROWS", 30)
    models.fit_demand_model(train)
    assert seen == [(1, 400), (14, 400)]


def test_model_fit_score_save_load(spark, tmpdir_path):
    a = fx.actuals(spark, SF0001)
    train = models.training_set(a)
    m = models.fit_demand_model(train)
    mae = models.training_mae(m.transform(train)).first().training_mae
    mu = train.agg(F.avg("demand_index")).first()[0]
    base = train.agg(F.avg(F.abs(F.col("demand_index") - F.lit(mu)))).first()[0]
    assert mae < base                             # better than predicting the mean
    path = models.save_model(m, tmpdir_path, "v1.1")
    assert os.path.isdir(path)
    again = models.load_model(tmpdir_path, "v1.1")
    s1 = sorted(r.pred_demand for r in models.score(train, m).collect())
    s2 = sorted(r.pred_demand for r in models.score(train, again).collect())
    assert s1 == s2
    assert models.fit_demand_model(train.limit(3)) is None      # fewer than 5 rows: skipped
    # every panel row gets a forecast: by the model, or by the naive formula where a feature is missing
    fc = models.model_forecast(a, m, "v1.1").collect()
    assert len(fc) == a.count() and all(r.pred_demand is not None for r in fc)
    naive = {(r.entity_id, r.date): r.pred_demand for r in models.score(a.filter("price_index IS NULL"), None).collect()}
    import datetime as dt
    got = {(r.entity_id, r.target_date - dt.timedelta(days=1)): r.pred_demand for r in fc}
    assert naive and all(got[k] == v for k, v in naive.items())


def test_sql_udf_registration(spark):
    from shelfspark.functions.text import register_udfs
    register_udfs(spark)
    assert spark.sql("SELECT clean_text('a &amp;  b') AS t").first().t == "a & b"
