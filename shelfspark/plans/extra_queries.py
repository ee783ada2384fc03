"""Registered streaming (K1-K6) and model (J1-J6, D12, B15) queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import crawl, models, views
from ..session import checkpoint_dir, cut_lineage
from ..sources.snapshots import Snapshots
from ..streaming import feed, joined
from ..streaming.seen import SeenUrls, run_seen_urls
from . import backtest as bt
from .crawl_queries import LINKS_SQL, sql_page_type
from .panel_queries import _BT_SQL, _FVA
from .registry import R, ORACLES, query


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stream_state(spark, sf, max_files=32, **tick):
    """Split the actuals panel into feed files, two or more a date, and run the tick stream over them in several
    micro-batches, which cut dates apart; the manifest tells when a date is whole."""
    base = _scratch(spark, "tick")
    feed.write_feed(fx.actuals(spark, sf), f"{base}/feed", files_per_date=2, manifest=f"{base}/manifest")
    feed.run_tick_stream(spark, f"{base}/feed", f"{base}/state", max_files_per_trigger=max_files, manifest=f"{base}/manifest", **tick)
    return Snapshots(spark, f"{base}/state")


@query("stream_tick_fva")
def q_stream_tick_fva(spark, sf):
    """K1 + K2: the daily feed as a stream, ticked by foreachBatch; must equal the batch backtest."""
    return _stream_state(spark, sf).table("fva").select(*bt.panel.FVA_COLS)


@query("stream_tick_days")
def q_stream_tick_days(spark, sf):
    """K2 + D4 + G22 + G23: per-day drift / retrain / version rows written by the stream."""
    return _stream_state(spark, sf).table("days").select("sim_day", "date", "rows_ingested", "drift_score",
                                                         "drift_flag", "retrained", "model_version")


#: Retraining by the calendar alone: on the given tables the drift rule asks for a model nearly every day, a fit of 100 trees each.
_PERIODIC = {"fit": models.fit_demand_model, "retrain_threshold": float("inf")}


@query("stream_registry")
def q_stream_registry(spark, sf):
    """I4 + J1-J3 + J6: the models that the tick fits, saves and registers with their error (rows-only: Spark's trees are its own)."""
    return _stream_state(spark, sf, **_PERIODIC).table("registry").select("model_version", "created_seq", "date", "rows_seen", "training_mae", "retrain_reason")


@query("stream_join_fva", f"{_FVA}\nSELECT * EXCLUDE (model_version) FROM fva")
def q_stream_join_fva(spark, sf):
    """C1 + K2: actuals and the forecasts made from them as two streams, joined on entity and day under watermarks."""
    base = _scratch(spark, "joined")
    joined.write_ordered_feed(cut_lineage(fx.actuals(spark, sf)), f"{base}/feed", [f.name for f in feed.ACTUALS_STREAM_SCHEMA.fields],
                              days_at_once=6, files=2, close_after=5)
    sides = [feed.daily_feed(spark, f"{base}/feed", max_files_per_trigger=2) for _ in range(2)]
    return feed.run_to_table(joined.join_forecasts(sides[0], joined.forecast_stream(sides[1]), "3 days"), f"{base}/out")


@query("stream_daily_summary", """
SELECT CAST(ts AS DATE) AS date, COUNT(*) AS events, COUNT_IF(event_type = 'purchase') AS purchases,
  CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS value_cents
FROM events GROUP BY 1""")
def q_stream_daily_summary(spark, sf):
    """K6: one-day tumbling windows over the whole stream, every day emitted."""
    schema = fx.table(spark, sf, "events").schema
    ev = spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/events*.parquet")
    out = feed.run_to_latest(feed.daily_event_summary(ev))
    return out.select("date", "events", "purchases", F.col("value_cents").cast("bigint").alias("value_cents"))


@query("stream_seen_urls", f"WITH {LINKS_SQL}\nSELECT DISTINCT link AS url FROM edges")
def q_stream_seen_urls(spark, sf):
    """K4: discovered links streamed through ``dropDuplicatesWithinWatermark``."""
    return feed.run_to_table(feed.seen_url_dedup(_links_stream(spark, sf, 1), delay="2 days")).select("url")


def _links_stream(spark, sf, days):
    """Discovered links as a stream of three files; event time: by hash, through so many days."""
    base = _scratch(spark, "links")
    edges = crawl.link_edges(crawl.extract_links(fx.table(spark, sf, "pages")))
    ts = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.xxhash64("url", "link"), F.lit(86_400 * days)))
    edges.select(F.col("link").alias("url"), ts.alias("ts")).repartition(3).write.parquet(base)
    return spark.readStream.schema("url string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(base)


@query("stream_new_urls", f"WITH {LINKS_SQL}\nSELECT DISTINCT link AS url FROM edges")
def q_stream_new_urls(spark, sf):
    """The same links over a month against the table of all URLs ever seen; none comes twice."""
    seen = SeenUrls(spark, _scratch(spark, "seen"))
    return run_seen_urls(_links_stream(spark, sf, 30), seen).select("url")


@query("stream_pages", f"SELECT page_id, {sql_page_type('url', 'html')} AS page_type FROM pages")
def q_stream_pages(spark, sf):
    """K5: pages typed as a stream; page types equal the batch classification."""
    out = feed.run_to_table(feed.typed_page_stream(spark, f"{sf.rstrip('/')}/pages*.parquet"))
    return out.select("page_id", F.col("page_type_hint").alias("page_type"))


# ---------------------------------------------------------------- models


@query("naive_scores", f"""WITH {fx.ACTUALS_CTE}
SELECT date, entity_id, {R("COALESCE(search_index * 0.4 + ad_index * 0.3 + sentiment_index * 100 * 0.2 + 30 * 0.1, COALESCE(search_index, 0.0) * 0.5 + 25.0) + 0.0", 4)} AS pred_demand
FROM actuals""")
def q_naive_scores(spark, sf):
    """J4 fallback (G27) over every panel row."""
    a = fx.actuals(spark, sf)
    return models.score(a, None).select("date", "entity_id", "pred_demand")


@query("residual_bias", f"""{_FVA}
SELECT entity_id, {R("SUM(CAST(ROUND(" + R("demand_error", 6) + " * 1000000.0) AS BIGINT)) / (COUNT(demand_error) * 1000000.0)", 4)} AS bias FROM fva
WHERE date > (SELECT MAX(date) FROM fva) - INTERVAL 7 DAY GROUP BY entity_id""")
def q_residual_bias(spark, sf):
    """Mean recent demand error per entity (last 7 days of comparisons)."""
    a = fx.actuals(spark, sf)
    fva = bt.panel.forecast_vs_actual(a, bt.panel.next_day_forecast(a))
    return models.residual_bias(fva, 7)


def _registry(days):
    """Registry rows (one per retrain) from the day table: version, sequence, rows seen so far."""
    w = Window.orderBy("date")
    cum = days.withColumn("rows_seen", F.sum("rows_ingested").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    h = models.retrain_history(cum.select("sim_day", "date", "model_version", "drift_score", "retrained", "rows_seen"))
    return h.join(cum.select("date", "rows_seen"), "date").select(
        "model_version", "created_seq", F.col("rows_seen").cast("bigint").alias("rows_seen"),
        F.lit(None).cast("double").alias("training_mae"), "retrain_reason")


_REG_SQL = f"""{_BT_SQL},
cum AS (SELECT *, SUM(rows_ingested) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rows_seen FROM days),
reg AS (SELECT model_version, row_number() OVER (ORDER BY date) AS created_seq, CAST(rows_seen AS BIGINT) AS rows_seen,
  CAST(NULL AS DOUBLE) AS training_mae, CASE WHEN sim_day % 7 = 0 THEN 'periodic' ELSE 'drift' END AS retrain_reason
  FROM cum WHERE retrained)"""


@query("retrain_registry", f"{_REG_SQL}\nSELECT * FROM reg")
def q_retrain_registry(spark, sf):
    """J3 registry rows produced by the backtest's retrain decisions."""
    return _registry(bt.backtest(fx.actuals(spark, sf))["days"])


@query("model_status", f"""{_REG_SQL}
SELECT arg_max(model_version, created_seq) AS current_version, arg_max(rows_seen, created_seq) AS rows_seen,
  arg_max(training_mae, created_seq) AS rolling_mae, arg_max(retrain_reason, created_seq) AS retrain_reason,
  array_to_string(list(model_version ORDER BY created_seq), ' ') AS all_versions FROM reg""")
def q_model_status(spark, sf):
    """B15 over the registry (versions list joined with spaces for the value check)."""
    st = views.model_status(_registry(bt.backtest(fx.actuals(spark, sf))["days"]))
    return st.withColumn("all_versions", F.array_join("all_versions", " "))


@query("model_scores")
def q_model_scores(spark, sf):
    """J1 + J2 + J4: boosted trees fitted on the whole training set and scored on it
    (rows-only: Spark's GBT numbers are its own)."""
    a = fx.actuals(spark, sf)
    train = models.training_set(a)
    m = models.fit_demand_model(train)
    return models.score(train, m).select("date", "entity_id", "demand_index", "pred_demand")


@query("model_forecast")
def q_model_forecast(spark, sf):
    """G18 by the model: next-day forecasts of every panel row, with each entity's recent bias (rows-only)."""
    a = fx.actuals(spark, sf)
    fva = bt.panel.forecast_vs_actual(a, bt.panel.next_day_forecast(a))
    return models.model_forecast(a, models.fit_demand_model(models.training_set(a)), "v1.1", models.residual_bias(fva, 7))


@query("fitted_registry")
def q_fitted_registry(spark, sf):
    """J3 with a fitted model: version, order, rows seen, in-sample error and reason of one fit (rows-only)."""
    train = models.training_set(fx.actuals(spark, sf))
    m = models.fit_demand_model(train)
    r = models.training_mae(m.transform(train)).first() if m else None
    return models.registry_row(spark, "v1.1", 1, r.rows_seen if r else 0, r.training_mae if r else float("nan"), "initial")


@query("training_mae")
def q_training_mae(spark, sf):
    """In-sample MAE of the fitted model and rows seen (rows-only)."""
    a = fx.actuals(spark, sf)
    train = models.training_set(a)
    m = models.fit_demand_model(train)
    return models.training_mae(m.transform(train))


def _copy_oracle(dst: str, src: str) -> None:
    ORACLES[dst] = ORACLES[src]


_copy_oracle("stream_tick_fva", "backtest_fva")
_copy_oracle("stream_tick_days", "backtest_days")
