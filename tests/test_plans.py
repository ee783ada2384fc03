"""Physical-plan properties that the scale design relies on."""

from pyspark.sql import functions as F

from conftest import SF0001
from shelfspark import fixtures as fx
from shelfspark.operators import keys, panel, views

# queries that run streams / fits / crawl loops when called (their plans are checked elsewhere)
EAGER = {"crawl_plan", "crawl_site", "model_scores", "training_mae", "model_forecast", "fitted_registry"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_joins(spark):
    import __spark_entry__ as E
    for name, fn in E.queries().items():
        if name in EAGER or name.startswith("stream_"):
            continue
        p = plan(fn(spark, SF0001))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_top_k_per_group_is_limited_before_the_shuffle(spark):
    m = panel.to_master(fx.actuals(spark, SF0001))
    p = plan(keys.keep_last(m, ["entity_id"], ["date"]))
    assert "WindowGroupLimit" in p and "Partial" in p
    conv = plan(views.conversation_history(fx.table(spark, SF0001, "conversations")))
    assert "WindowGroupLimit" in conv


def test_latest_is_an_aggregate_not_a_window(spark):
    p = plan(keys.latest(panel.to_master(fx.actuals(spark, SF0001))))
    assert "Window" not in p and "Aggregate" in p


def test_filters_and_columns_reach_the_scan(spark):
    m = panel.to_master(fx.actuals(spark, SF0001))
    p = plan(views.product_series(m, 5))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,5)]" in p
    cs = plan(panel.category_summary(keys.latest(m)))
    assert "props" not in cs.split("ReadSchema:")[1].split("\n")[0]     # unused column pruned


def test_global_top_k_is_take_ordered(spark):
    p = plan(views.top_alerts(panel.alerts(fx.actuals(spark, SF0001)), 20))
    assert "TakeOrderedAndProject" in p
    _ = F


def test_scrape_reads_pages_once(spark):
    """All outputs of the scrape come from one page scan and one extraction."""
    import __spark_entry__ as E
    plan = E.queries()["scrape_records"](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("MapInPandas") == 1


def test_sku_links_parse_records_once(spark):
    """Links and SKUs come from one written table of keyed records."""
    import __spark_entry__ as E
    p = plan(E.queries()["sku_links"](spark, SF0001))
    assert "keyed_products" in p and "sha2(" not in p and "lineitem.parquet" not in p


def test_backtest_compares_once(spark):
    """The comparison of all dates: two scans of the events and few exchanges, none of them for a stored forecast."""
    from shelfspark.plans import backtest as bt
    plan = bt.backtest(fx.actuals(spark, SF0001))["fva"]._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[0]
    assert initial.count("FileScan parquet") <= 2, initial.count("FileScan parquet")
    assert initial.count("Exchange hashpartitioning") + initial.count("Exchange SinglePartition") + initial.count("BroadcastExchange") <= 9
