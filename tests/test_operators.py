"""Gold rows and properties for the DataFrame operators."""

import datetime as dt

from pyspark.sql import functions as F

from shelfspark.operators import catalog, keys, panel, views
from shelfspark.plans import backtest as bt
from shelfspark.session import written_once

D1, D2, D3 = dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3)


def test_latest_last_non_null(spark):
    df = spark.createDataFrame([(1, D1, 1, "a"), (1, D2, None, "b")], "entity_id int, date date, x int, y string")
    r = keys.latest(df).first()
    assert (r.date, r.x, r.y) == (D2, 1, "b")
    r2 = keys.latest(df, mode="last_row").first()
    assert (r2.x, r2.y) == (None, "b")


def test_upsert_keeps_new_and_cuts_columns(spark):
    old = spark.createDataFrame([(1, D1, "old"), (2, D1, "keep")], "entity_id int, date date, v string")
    new = spark.createDataFrame([(1, D1, "new", 9)], "entity_id int, date date, v string, extra int")
    out = sorted(tuple(r) for r in keys.upsert(old, new, ["entity_id", "date"]).collect())
    assert out == [(1, D1, "new"), (2, D1, "keep")]


def test_project_available_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1)], "a double, b int")
    r = keys.project_available(df, ["b", "zz", "a"])
    assert r.columns == ["b", "a"] and r.first().a is None


def _products(spark, rows):
    df = spark.createDataFrame(rows, "listing_id long, url string, source_domain string, seed_category string, "
                                     "product_name string, brand string, model_number string, price_raw string, "
                                     "rating_raw string, review_count_raw string")
    return catalog.products_from_listings(df)


def test_dedup_richness_and_fill(spark):
    p = _products(spark, [
        (1, "https://a.com/x/?utm_source=1", "a.com", "phones", "Phone X", "", "", "Rs. 100", "", "3 ratings"),
        (2, "https://b.com/x", "b.com", "phones", "Phone X", "", "", "Rs. 100", "4.0 out of 5", "3 ratings"),
    ])
    d = catalog.dedup_products(p).collect()
    assert len(d) == 1
    r = d[0]
    assert r.merged_count == 2 and r.source_urls == ["https://a.com/x", "https://b.com/x"]
    # both rows are equally rich; input order decides the base (row 1)
    assert r.url_normalized == "https://a.com/x" and r.rating_value is None


def test_dedup_order_independent(spark):
    rows = [(i, f"https://s{i % 3}.com/p/{i % 7}", f"s{i % 3}.com", "c", f"Name {i % 7}", "" if i % 2 else "Brand",
             "", f"Rs. {100 + i % 7}", "84%", f"{i} ratings") for i in range(60)]
    p = _products(spark, rows)
    a = sorted(map(tuple, catalog.build_skus(catalog.dedup_products(p)).drop("extra").collect()), key=repr)
    b = sorted(map(tuple, catalog.build_skus(catalog.dedup_products(p.repartition(7).orderBy(F.rand(3))))
                   .drop("extra").collect()), key=repr)
    assert a == b


def test_sku_links_of_keyed_records(spark):
    """Records that have their keys give the links of raw ones, and nothing is parsed again."""
    rows = [(i, [None, "", f"https://S{i % 3}.com/p/{i % 7}/?utm_source=x"][min(i % 9, 2)], f"s{i % 3}.com", "c", f"Name {i % 7}",
             "" if i % 2 else "Brand", None, f"Rs. {100 + i % 7}", "84%", f"{i} ratings") for i in range(90)]
    p = _products(spark, rows)
    k = written_once(catalog.keyed(p), "test_keyed")
    once, twice = catalog.sku_links(k, catalog.dedup_products(k)), catalog.sku_links(p, catalog.dedup_products(p))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) and once.count() > 20
    assert sorted(map(repr, catalog.dedup_products(k).collect())) == sorted(map(repr, catalog.dedup_products(p).collect()))
    assert "sha2(" not in once._jdf.queryExecution().executedPlan().toString()


def test_sku_weighted_rating(spark):
    deduped = spark.createDataFrame(
        [(1, "Acme", "Widget", "", "c", 10.0, "INR", 4.0, 3, ["u1"], "a.com", 1),
         (2, "Acme", "Widget", "", "c", 12.0, "INR", 5.0, 1, ["u2"], "b.com", 1)],
        "seq long, brand string, product_name string, model_number string, seed_category string, "
        "price_amount double, price_currency string, rating_value double, rating_count long, "
        "source_urls array<string>, source_domain string, merged_count long") \
        .withColumn("sku_hint", F.lit("")).withColumn("bullet_points", F.array().cast("array<string>"))
    r = catalog.build_skus(deduped).first()
    assert (r.rating_avg, r.rating_count_total, r.price_min, r.price_max) == (4.25, 4, 10.0, 12.0)
    assert r.source_urls == ["u1", "u2"] and r.source_domains == ["a.com", "b.com"]


def test_taxonomy(spark):
    skus = spark.createDataFrame(
        [("b:m1:v1", "b", "m1", "v1", "c"), ("b:m1:v2", "b", "m1", "v2", "c"), ("b:m2", "b", "m2", "", "")],
        "sku_id string, brand string, model string, variant string, category string")
    for c, t in [("price_min", "double"), ("price_max", "double"), ("price_currency", "string"),
                 ("rating_avg", "double"), ("rating_count_total", "long")]:
        skus = skus.withColumn(c, F.lit(None).cast(t))
    skus = skus.withColumn("source_urls", F.array().cast("array<string>")) \
        .withColumn("source_domains", F.array().cast("array<string>"))
    flat = {r.sku_id: r for r in catalog.taxonomy_flat(skus).collect()}
    assert (flat["b:m2"].category, flat["b:m2"].variant, flat["b:m2"].slug) == ("uncategorized", "base", "base")
    root = catalog.taxonomy_counts(skus).filter("level = 'root'").first()
    # two categories (c, uncategorized), 2 brand nodes, 2 model nodes, 3 leaves
    assert (root.total_nodes, root.leaves) == (9, 3)
    tree = {r.name: r for r in catalog.taxonomy_tree(skus).collect()}
    assert tree["c"].data.brand_count == 1
    assert [v.name for v in tree["c"].children[0].children[0].children] == ["v1", "v2"]


def test_single_category_counts(spark):
    # FIXTURES.md: 1 category, 1 brand, 2 models, 3 variants -> nodes 7, leaves 3
    skus = spark.createDataFrame([("b:m1:v1", "b", "m1", "v1", "c"), ("b:m1:v2", "b", "m1", "v2", "c"),
                                  ("b:m2:v3", "b", "m2", "v3", "c")],
                                 "sku_id string, brand string, model string, variant string, category string")
    for c, t in [("price_min", "double"), ("price_max", "double"), ("price_currency", "string"),
                 ("rating_avg", "double"), ("rating_count_total", "long")]:
        skus = skus.withColumn(c, F.lit(None).cast(t))
    skus = skus.withColumn("source_urls", F.array().cast("array<string>")) \
        .withColumn("source_domains", F.array().cast("array<string>"))
    root = catalog.taxonomy_counts(skus).filter("level = 'root'").first()
    assert (root.total_nodes, root.leaves) == (7, 3)


def _panel(spark):
    rows = []
    for d in (D1, D2, D3):
        for e in (1, 2):
            rows.append((e, d, "B", "P", "cat", 10.0 * e + d.day, None if d == D2 else 5.0, 0.5, 40.0, 20.0,
                         "view", "Burst of view", "view seen", "positive" if e == 1 else "neutral",
                         "demand uplift" if e == 1 else "", "high", "n=4"))
    return spark.createDataFrame(rows, "entity_id long, date date, brand string, product_name string, category string, "
                                       "demand_index double, price_index double, sentiment_index double, "
                                       "search_index double, ad_index double, event_type string, event_title string, "
                                       "event_description string, impact_direction string, event_effect_hint string, "
                                       "priority string, signal_story string")


def test_forecast_vs_actual(spark):
    a = _panel(spark)
    fva = {(r.entity_id, r.date): r for r in panel.forecast_vs_actual(a, panel.next_day_forecast(a)).collect()}
    assert fva[(1, D1)].model_version == "v1.0" and fva[(1, D1)].pred_demand is None
    r = fva[(1, D2)]            # forecast from D1: 11 * 1.02
    assert r.pred_demand == 11.22 and abs(r.demand_error - (12.0 - 11.22)) < 1e-9 and r.actual_price is None
    assert fva[(1, D3)].pred_price is None    # D2 had no price


def test_backtest_equals_stepwise(spark):
    a = _panel(spark)
    whole = bt.advance(a)
    first = bt.advance(a.filter(F.col("date") <= D2))
    second = bt.advance(a.filter(F.col("date") == D3), first["fva"], first["days"], first["predictions"])
    got = sorted(map(tuple, first["fva"].unionByName(second["fva"]).collect()), key=repr)
    assert got == sorted(map(tuple, whole["fva"].collect()), key=repr)
    days = sorted(map(tuple, first["days"].unionByName(second["days"]).collect()))
    assert days == sorted(map(tuple, whole["days"].collect()))


def test_conversation_history(spark):
    msgs = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(25)],
                                 "conv_id long, turn long, role string, text string")
    r = views.conversation_history(msgs, 20, "first").first()
    lines = r.history.split("\n")
    assert r.n_turns == 20 and lines[0] == "User: m0" and lines[1] == "Assistant: m1" and lines[-1] == "Assistant: m19"
    last = views.conversation_history(msgs, 20, "last").first().history.split("\n")
    assert last[0] == "Assistant: m5" and last[-1] == "User: m24"


def test_daily_summary_and_alerts(spark):
    a = _panel(spark)
    d = {r.date: r for r in panel.daily_summary(a).collect()}
    assert d[D1].total_stat_events == 2 and d[D1].total_top_peaks == 1 and d[D2].avg_actual_price is None
    top = views.top_alerts(panel.alerts(a), 3).collect()
    assert len(top) == 3 and all(r.event_severity_score == 2.5 for r in top)
    ex = {(r.entity_id, r.date): r.event_explanation for r in panel.explanations(a).collect()}
    assert "burst of view" in ex[(1, D1)] and ex[(2, D1)] == "Signal: n=4"


def test_single_entity_views(spark):
    a = _panel(spark)
    m = panel.to_master(a)
    lt = keys.latest(m)
    ov = views.product_overview(lt, 1).first()
    assert ov.list_price == 0.0 and ov.price_index == 5.0 and ov.demand_index == 13.0
    assert [r.date for r in views.product_series(m, 2).collect()] == [D1, D2, D3]
    ex = panel.explanations(a)
    assert "uplift" not in views.explain_lookup(ex, 2, "2024-01-01").first().answer
    assert views.explain_lookup(ex, 9, "2024-01-01").first().answer == views.NO_EXPLANATION
    cur = views.current_drift(spark.createDataFrame([(1, 2.0), (2, 6.0)], "sim_day int, combined_drift double")).first()
    assert (cur.drift_score, cur.drift_flag) == (6.0, True)


def test_drift_modes(spark):
    """Q1/Q2: coded drift = demand MAE over the last N rows; documented = 7-day window, combined."""
    import datetime as dt
    rows = [(dt.date(2024, 1, d), e, 10.0, 10.0 + d, float(d), 100.0, 100.0 + d, float(d))
            for d in range(1, 11) for e in (1, 2)]
    fva = spark.createDataFrame(rows, "date date, entity_id int, pred_demand double, actual_demand double, "
                                      "abs_demand_error double, pred_price double, actual_price double, abs_price_error double")
    # last 7 rows: dates 10,10,9,9,8,8,7 -> mean 8.714..
    assert panel.drift_last_rows(fva, 7).first().drift_score == 8.7143
    combined = panel.drift_last_rows(fva, 7, mode="combined").first().drift_score
    assert combined > 4.3 and combined < 4.4            # 0.5*8.714 + 0.5*(8.714/108.7)
    roll = {r.date.day: r for r in panel.drift_rolling(fva, 7, mode="demand").collect()}
    assert roll[10].rolling_mae_demand == 7.0 and roll[10].combined_drift == 7.0   # days 4..10
    assert roll[1].rolling_mae_demand == 1.0


def test_catalog_job_and_filters(spark):
    from conftest import SF0001
    from shelfspark import fixtures as fx
    p = catalog.products_from_listings(fx.listings(spark, SF0001))
    assert set(catalog.catalog_job(p, dedup_only=True)) == {"deduped"}
    out = catalog.catalog_job(p)
    assert out["leaves"].count() == out["skus"].count()
    m = panel.to_master(_panel(spark))
    fv = views.filter_values(m, keys.latest(m))
    assert [r.category for r in fv["categories"].collect()] == ["cat"] and fv["entities"].count() == 2


def test_listings_have_tasks_by_rows(spark, monkeypatch):
    """A listing is sorted by fingerprint behind its join: its task must not grow with the few bytes of its keys."""
    from conftest import SF0001
    from shelfspark import fixtures as fx
    sold = fx.table(spark, SF0001, "lineitem").count()
    want = sorted(r.listing_id for r in fx.listings(spark, SF0001).collect())
    monkeypatch.setattr(fx, "LISTINGS_A_TASK", 100)
    listings = fx.listings(spark, SF0001)
    assert listings.rdd.getNumPartitions() == -(-sold // 100)
    assert sorted(r.listing_id for r in listings.collect()) == want
