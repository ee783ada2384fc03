"""Registered panel queries (daily market panel, serving tables, read views, backtest)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import keys, panel, views
from ..sources import writers
from . import backtest as bt
from .registry import R, query

# ---------------------------------------------------------------- shared SQL fragments

_HEALTH = R("COALESCE(sentiment_index, 0.7) * 100 * 0.4 + COALESCE(demand_index, 50.0) * 0.3 "
            "+ COALESCE(search_index, 50.0) * 0.3", 2)
MASTER_SQL = f"""
master AS (SELECT entity_id, date, COALESCE(brand,'') AS brand, COALESCE(product_name,'') AS product_name,
  COALESCE(category,'') AS category, demand_index, price_index, sentiment_index, search_index, ad_index,
  {_HEALTH} AS health_index, demand_index * 0.98 AS xgb_pred_demand, price_index * 1.01 AS xgb_pred_price,
  CAST(0 AS BIGINT) AS change_point, CAST(0 AS DOUBLE) AS shift_strength, 'none' AS marker_type,
  COALESCE(event_description,'') AS event_explanation, COALESCE(signal_story,'') AS narrative
  FROM actuals)"""
_LATEST_COLS = ",\n  ".join(
    f"arg_max({c}, CASE WHEN {c} IS NOT NULL THEN date END) AS {c}" for c in panel.MASTER_COLS[2:])
LATEST_SQL = f"""
latest AS (SELECT entity_id, MAX(date) AS date,
  {_LATEST_COLS}
  FROM master GROUP BY entity_id)"""
PANEL = f"WITH {fx.ACTUALS_CTE},{MASTER_SQL},{LATEST_SQL}"

PREDS_SQL = f"""
preds AS (SELECT CAST(date + INTERVAL 1 DAY AS DATE) AS target_date, entity_id,
  {R("demand_index * CASE impact_direction WHEN 'positive' THEN 1.02 WHEN 'negative' THEN 0.98 ELSE 1.0 END", 4)} AS pred_demand,
  {R("price_index * (1 + 0.0)", 4)} AS pred_price, 'v1.0' AS model_version FROM actuals)"""

FVA_SQL = """
_pd AS (SELECT DISTINCT target_date FROM preds),
fva AS (SELECT a.date, a.entity_id, p.pred_demand, a.demand_index AS actual_demand,
  a.demand_index - p.pred_demand AS demand_error, ABS(a.demand_index - p.pred_demand) AS abs_demand_error,
  p.pred_price, a.price_index AS actual_price,
  a.price_index - p.pred_price AS price_error, ABS(a.price_index - p.pred_price) AS abs_price_error,
  COALESCE(a.event_type,'') AS event_type, COALESCE(a.event_effect_hint,'') AS event_effect_hint,
  CASE WHEN d.target_date IS NULL THEN 'v1.0' ELSE COALESCE(p.model_version,'') END AS model_version
  FROM actuals a LEFT JOIN preds p ON a.entity_id = p.entity_id AND a.date = p.target_date
  LEFT JOIN _pd d ON a.date = d.target_date)"""

ALERTS_SQL = f"""
alerts AS (SELECT date, entity_id, COALESCE(brand,'') AS brand, COALESCE(category,'') AS category,
  COALESCE(event_type,'realtime_signal') AS marker_type, COALESCE(event_title,'Realtime Signal') AS alert_title,
  COALESCE(event_description,'') AS event_explanation, COALESCE(signal_story,'') AS narrative,
  {R("2.5 + 0.0", 4)} AS event_severity_score, demand_index, price_index, sentiment_index, search_index, ad_index
  FROM actuals WHERE priority = 'high')"""


def _actuals(spark, sf):
    return fx.actuals(spark, sf)


def _master(spark, sf):
    return panel.to_master(fx.actuals(spark, sf))


def _latest(spark, sf):
    return keys.latest(_master(spark, sf))


# ---------------------------------------------------------------- E1 / G19 / D5


@query("category_summary", f"""{PANEL}
SELECT category, COUNT(*) AS count, {R("AVG(demand_index)", 2)} AS avg_demand, {R("AVG(price_index)", 2)} AS avg_price,
  {R("AVG(sentiment_index) * 100", 1)} AS avg_sentiment, {R("AVG(ad_index)", 2)} AS avg_ad_index,
  {R("AVG(health_index)", 2)} AS avg_health,
  first(brand ORDER BY health_index DESC, entity_id ASC) AS top_brand
FROM latest GROUP BY category""")
def q_category_summary(spark, sf):
    return panel.category_summary(_latest(spark, sf))


@query("category_summary_one", f"""{PANEL}
SELECT category, COUNT(*) AS count, {R("AVG(demand_index)", 2)} AS avg_demand, {R("AVG(price_index)", 2)} AS avg_price,
  {R("AVG(sentiment_index) * 100", 1)} AS avg_sentiment, {R("AVG(ad_index)", 2)} AS avg_ad_index,
  {R("AVG(health_index)", 2)} AS avg_health,
  first(brand ORDER BY health_index DESC, entity_id ASC) AS top_brand
FROM latest WHERE lower(category) = 'smartphones' GROUP BY category""")
def q_category_summary_one(spark, sf):
    return panel.category_summary(_latest(spark, sf), category="SmartPhones")


@query("category_products", f"""{PANEL}
SELECT category, entity_id, brand, product_name, demand_index, price_index, sentiment_index, health_index
FROM latest ORDER BY category, health_index DESC, entity_id""")
def q_category_products(spark, sf):
    return panel.category_products(_latest(spark, sf))


@query("latest_master", f"{PANEL}\nSELECT * FROM latest")
def q_latest_master(spark, sf):
    return _latest(spark, sf)


@query("latest_last_row", f"""{PANEL}
SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) AS _rn
FROM master) WHERE _rn = 1""")
def q_latest_last_row(spark, sf):
    return keys.latest(_master(spark, sf), mode="last_row")


@query("master", f"{PANEL}\nSELECT * FROM master")
def q_master(spark, sf):
    return _master(spark, sf)


@query("actuals", f"WITH {fx.ACTUALS_CTE}\nSELECT * FROM actuals")
def q_actuals(spark, sf):
    return fx.actuals(spark, sf)


# ---------------------------------------------------------------- B2 filters


@query("filter_categories", f"{PANEL}\nSELECT DISTINCT category FROM master ORDER BY category")
def q_filter_categories(spark, sf):
    return views.filter_categories(_master(spark, sf))


@query("filter_brands", f"{PANEL}\nSELECT DISTINCT brand FROM master ORDER BY brand")
def q_filter_brands(spark, sf):
    return views.filter_brands(_master(spark, sf))


@query("filter_entities", f"{PANEL}\nSELECT entity_id, brand, product_name, category FROM latest ORDER BY brand, entity_id")
def q_filter_entities(spark, sf):
    return views.filter_entities(_latest(spark, sf))


# ---------------------------------------------------------------- D1 / B3, D2 / B4, G18


_DAILY_SQL = f"""
SELECT date, {R("AVG(demand_index)", 4)} AS avg_actual_demand, {R("AVG(demand_index) * 0.98", 4)} AS avg_predicted_demand,
  {R("AVG(price_index)", 4)} AS avg_actual_price, {R("AVG(price_index) * 1.01", 4)} AS avg_predicted_price,
  {R("AVG(sentiment_index)", 6)} AS avg_sentiment, {R("AVG(ad_index)", 4)} AS avg_ad_index,
  COUNT(*) AS total_stat_events, COUNT_IF(impact_direction = 'positive') AS total_top_peaks,
  COUNT_IF(impact_direction = 'negative') AS total_bottom_peaks, CAST(0 AS BIGINT) AS change_point,
  CAST(0 AS DOUBLE) AS shift_strength
FROM actuals GROUP BY date"""


@query("daily_summary", f"WITH {fx.ACTUALS_CTE}{_DAILY_SQL}")
def q_daily_summary(spark, sf):
    return panel.daily_summary(_actuals(spark, sf))


@query("daily_summary_view", f"WITH {fx.ACTUALS_CTE}, daily AS ({_DAILY_SQL})\nSELECT * FROM daily ORDER BY date")
def q_daily_summary_view(spark, sf):
    return views.daily_summary_view(panel.daily_summary(_actuals(spark, sf)).orderBy("date"))


@query("next_day_forecast", f"WITH {fx.ACTUALS_CTE},{PREDS_SQL}\nSELECT * FROM preds")
def q_next_day_forecast(spark, sf):
    return panel.next_day_forecast(_actuals(spark, sf))


@query("forecast_avg", f"""WITH {fx.ACTUALS_CTE},{PREDS_SQL}
SELECT target_date AS date, {R("SUM(CAST(ROUND(pred_price * 10000.0) AS BIGINT)) / (COUNT(pred_price) * 10000.0)", 4)} AS forecast_avg_price FROM preds GROUP BY target_date""")
def q_forecast_avg(spark, sf):
    return panel.forecast_avg(panel.next_day_forecast(_actuals(spark, sf)))


@query("forecast_view", f"""WITH {fx.ACTUALS_CTE},{PREDS_SQL}
SELECT target_date AS date, {R("SUM(CAST(ROUND(pred_price * 10000.0) AS BIGINT)) / (COUNT(pred_price) * 10000.0)", 4)} AS forecast_avg_price FROM preds GROUP BY target_date ORDER BY 1""")
def q_forecast_view(spark, sf):
    return views.forecast_view(panel.forecast_avg(panel.next_day_forecast(_actuals(spark, sf))).orderBy("date"))


# ---------------------------------------------------------------- C1 / A10 / B13 / D3 / E8


def _fva(spark, sf):
    a = _actuals(spark, sf)
    return panel.forecast_vs_actual(a, panel.next_day_forecast(a))


_FVA = f"WITH {fx.ACTUALS_CTE},{PREDS_SQL},{FVA_SQL}"


@query("forecast_vs_actual", f"{_FVA}\nSELECT * FROM fva")
def q_forecast_vs_actual(spark, sf):
    return _fva(spark, sf)


@query("fva_serving", f"{_FVA}\nSELECT * FROM fva ORDER BY date, entity_id")
def q_fva_serving(spark, sf):
    return writers.fva_serving(_fva(spark, sf))


@query("recent_fva", f"""{_FVA}
SELECT date, entity_id, pred_demand, actual_demand, demand_error, abs_demand_error, pred_price, actual_price,
  price_error, event_type, event_effect_hint, model_version
FROM fva ORDER BY date DESC, entity_id DESC LIMIT 50""")
def q_recent_fva(spark, sf):
    return views.recent_fva(_fva(spark, sf), 50)


@query("drift_last_rows", f"""{_FVA}
SELECT COALESCE({R("AVG(abs_demand_error)", 4)}, 0.0) AS drift_score, COUNT(*) AS rows_used FROM (
  SELECT * FROM fva WHERE abs_demand_error IS NOT NULL ORDER BY date DESC, entity_id DESC LIMIT 7)""")
def q_drift_last_rows(spark, sf):
    return panel.drift_last_rows(_fva(spark, sf), 7)


@query("drift_snapshot", f"""{_FVA}
SELECT drift_score AS rolling_mae_demand, CAST(0 AS DOUBLE) AS rolling_mae_price, drift_score AS combined_drift,
  drift_score > 5.0 AS drift_flag FROM (
SELECT COALESCE({R("AVG(abs_demand_error)", 4)}, 0.0) AS drift_score FROM (
  SELECT * FROM fva WHERE abs_demand_error IS NOT NULL ORDER BY date DESC, entity_id DESC LIMIT 7))""")
def q_drift_snapshot(spark, sf):
    return panel.drift_snapshot(panel.drift_last_rows(_fva(spark, sf), 7))


@query("drift_rolling", f"""{_FVA},
per AS (SELECT date, SUM(abs_demand_error) sd, COUNT(abs_demand_error) nd, SUM(abs_price_error) sp,
  COUNT(abs_price_error) np, SUM(actual_price) sa, COUNT(actual_price) na FROM fva GROUP BY date),
r AS (SELECT date,
  SUM(sd) OVER w AS sd, SUM(nd) OVER w AS nd, SUM(sp) OVER w AS sp, SUM(np) OVER w AS np,
  SUM(sa) OVER w AS sa, SUM(na) OVER w AS na FROM per
  WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))
SELECT date, {R("sd / NULLIF(nd, 0)", 4)} AS rolling_mae_demand, {R("sp / NULLIF(np, 0)", 4)} AS rolling_mae_price,
  {R("0.5 * COALESCE(sd / NULLIF(nd, 0), 0.0) + 0.5 * COALESCE((sp / NULLIF(np, 0)) / NULLIF(sa / NULLIF(na, 0), 0), 0.0)", 4)} AS combined_drift
FROM r""")
def q_drift_rolling(spark, sf):
    return panel.drift_rolling(_fva(spark, sf), 7, "combined")


# ---------------------------------------------------------------- G20 / G21 / B6 / B10 / B12


_EXPL_SQL = """
SELECT entity_id, date, COALESCE(brand,'') AS brand, COALESCE(category,'') AS category,
  COALESCE(event_type,'') AS marker_type,
  CASE WHEN COALESCE(impact_direction,'') = 'positive' AND contains(lower(COALESCE(event_effect_hint,'')), 'uplift')
         THEN 'Demand beat the forecast following ' || lower(COALESCE(event_title,'')) || ' and stronger search interest. ' || COALESCE(signal_story,'')
       WHEN COALESCE(impact_direction,'') = 'negative' AND contains(lower(COALESCE(event_effect_hint,'')), 'softness')
         THEN 'Demand fell short of the forecast, probably because of ' || lower(COALESCE(event_title,'')) || ' or fading momentum. ' || COALESCE(signal_story,'')
       WHEN COALESCE(signal_story,'') <> '' THEN 'Signal: ' || signal_story
       ELSE 'No significant deviation.' END AS event_explanation,
  COALESCE(signal_story,'') AS narrative, demand_index, price_index
FROM actuals"""


@query("explanations", f"WITH {fx.ACTUALS_CTE}{_EXPL_SQL}")
def q_explanations(spark, sf):
    return panel.explanations(_actuals(spark, sf))


@query("explain_all", f"""WITH {fx.ACTUALS_CTE}, expl AS ({_EXPL_SQL}),
asked AS (SELECT entity_id, date FROM actuals UNION SELECT entity_id, CAST(date + INTERVAL 1 DAY AS DATE) FROM actuals)
SELECT a.entity_id, a.date, COALESCE(e.event_explanation, 'No detailed explanation available.') AS answer
FROM asked a LEFT JOIN expl e ON a.entity_id = e.entity_id AND a.date = e.date""")
def q_explain_all(spark, sf):
    """B12 for every row of the panel and the day after it, which often has no explanation."""
    a = _actuals(spark, sf)
    asked = a.select("entity_id", "date").union(a.select("entity_id", F.date_add("date", 1)))
    return views.explain_all(panel.explanations(a), asked)


@query("alerts", f"WITH {fx.ACTUALS_CTE},{ALERTS_SQL}\nSELECT * FROM alerts")
def q_alerts(spark, sf):
    return panel.alerts(_actuals(spark, sf))


@query("top_alerts", f"""WITH {fx.ACTUALS_CTE},{ALERTS_SQL}
SELECT * FROM alerts ORDER BY event_severity_score DESC NULLS LAST, date, entity_id LIMIT 20""")
def q_top_alerts(spark, sf):
    return views.top_alerts(panel.alerts(_actuals(spark, sf)), 20)


@query("top_alerts_brand", f"""WITH {fx.ACTUALS_CTE},{ALERTS_SQL}
SELECT * FROM alerts WHERE lower(brand) = 'brand#3'
ORDER BY event_severity_score DESC NULLS LAST, date, entity_id LIMIT 20""")
def q_top_alerts_brand(spark, sf):
    return views.top_alerts(panel.alerts(_actuals(spark, sf)), 20, brand="BRAND#3")


@query("product_alerts_all", f"""WITH {fx.ACTUALS_CTE},{ALERTS_SQL}
SELECT entity_id, date, marker_type, alert_title, event_explanation, narrative, event_severity_score,
  demand_index, price_index, sentiment_index FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY event_severity_score DESC NULLS LAST, date) AS rn
  FROM alerts) WHERE rn <= 10""")
def q_product_alerts_all(spark, sf):
    """B10 for every entity at once."""
    return views.product_alerts(panel.alerts(_actuals(spark, sf)))


# ---------------------------------------------------------------- B7 / B8 for every entity


@query("product_overview_all", f"""{PANEL}
SELECT entity_id, brand, product_name, category, {R("demand_index", 2)} AS demand_index, {R("price_index", 2)} AS price_index,
  {R("sentiment_index", 4)} AS sentiment_index, {R("search_index", 2)} AS search_index, {R("ad_index", 2)} AS ad_index,
  {R("health_index", 2)} AS health_index, CAST(0 AS DOUBLE) AS list_price FROM latest""")
def q_product_overview_all(spark, sf):
    return views.product_overview(_latest(spark, sf))


@query("product_series_all", f"""{PANEL}
SELECT entity_id, date, demand_index, price_index, sentiment_index, search_index, ad_index, health_index,
  change_point, shift_strength FROM master ORDER BY entity_id, date""")
def q_product_series_all(spark, sf):
    return views.product_series(_master(spark, sf))


# ---------------------------------------------------------------- E9 / E11 / D13


@query("zscore_alerts", f"""{PANEL},
st AS (SELECT entity_id, AVG(demand_index) AS mu, STDDEV_SAMP(demand_index) AS sd FROM master GROUP BY entity_id),
z AS (SELECT m.*, (m.demand_index - st.mu) / NULLIF(st.sd, 0) AS zscore FROM master m JOIN st USING (entity_id))
SELECT entity_id, date, brand, category, demand_index, {R("zscore", 4)} AS zscore FROM z WHERE ABS(zscore) > 2.5""")
def q_zscore_alerts(spark, sf):
    return panel.zscore_alerts(_master(spark, sf), 2.5)


@query("panel_features", f"""{PANEL},{ALERTS_SQL},
ev AS (SELECT DISTINCT entity_id, date FROM alerts),
f AS (SELECT entity_id, date, category, demand_index,
  first(demand_index) OVER (PARTITION BY entity_id ORDER BY date RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS lag_1,
  first(demand_index) OVER (PARTITION BY entity_id ORDER BY date RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND INTERVAL 2 DAY PRECEDING) AS lag_2,
  first(demand_index) OVER (PARTITION BY entity_id ORDER BY date RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 3 DAY PRECEDING) AS lag_3,
  first(demand_index) OVER (PARTITION BY entity_id ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING) AS lag_7,
  AVG(demand_index) OVER w7 AS mu, STDDEV_SAMP(demand_index) OVER w7 AS sd,
  AVG(demand_index) OVER (PARTITION BY entity_id ORDER BY date RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) AS mu3,
  AVG(demand_index) OVER (PARTITION BY entity_id ORDER BY date RANGE BETWEEN INTERVAL 13 DAY PRECEDING AND CURRENT ROW) AS mu14,
  dense_rank() OVER (PARTITION BY category, date ORDER BY demand_index DESC) AS rank_in_category
  FROM master WINDOW w7 AS (PARTITION BY entity_id ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))
SELECT f.entity_id, f.date, category, demand_index, lag_1, lag_2, lag_3, lag_7, {R("mu3", 4)} AS roll_mean_3,
  {R("mu", 4)} AS roll_mean_7, {R("mu14", 4)} AS roll_mean_14,
  {R("(demand_index - mu) / NULLIF(sd, 0)", 4)} AS zscore, {R("demand_index / NULLIF(lag_1, 0) - 1", 4)} AS momentum,
  rank_in_category, ev.entity_id IS NOT NULL AS event_flag
FROM f LEFT JOIN ev ON f.entity_id = ev.entity_id AND f.date = ev.date""")
def q_panel_features(spark, sf):
    """E11; the events are the panel's alerts."""
    a = _actuals(spark, sf)
    return panel.panel_features(panel.to_master(a), events=panel.alerts(a))


def _market_sql(days: int, regime: str = "CAST(NULL AS DATE)") -> str:
    return f"""{PANEL},{ALERTS_SQL},
mx AS (SELECT MAX(date) AS d FROM master),
cat AS (SELECT category, {R("AVG(demand_index)", 2)} AS avg_demand, {R("AVG(sentiment_index) * 100", 1)} AS avg_sentiment,
  {R(f"(AVG(CASE WHEN date > mx.d - INTERVAL {days} DAY THEN price_index END) / NULLIF(AVG(CASE WHEN date <= mx.d - INTERVAL {days} DAY AND date > mx.d - INTERVAL {2 * days} DAY THEN price_index END), 0) - 1) * 100", 1)} AS price_change_pct
  FROM master, mx GROUP BY category),
b AS (SELECT category, brand, AVG(demand_index) AS bd FROM master GROUP BY category, brand),
sv AS (SELECT category, brand, MAX(event_severity_score) AS max_alert_severity FROM alerts GROUP BY category, brand),
top AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY bd DESC, brand) AS brand_rank FROM b)
SELECT top.category, avg_demand, avg_sentiment, price_change_pct, brand_rank, top.brand, {R("bd", 2)} AS brand_demand,
  max_alert_severity, {regime} AS latest_regime_shift
FROM top LEFT JOIN sv ON top.category = sv.category AND top.brand = sv.brand JOIN cat ON top.category = cat.category
WHERE brand_rank <= 6"""


@query("market_context", _market_sql(30))
def q_market_context(spark, sf):
    a = _actuals(spark, sf)
    return panel.market_context(panel.to_master(a), panel.alerts(a), 6, 30)


@query("market_context_week", _market_sql(7, "(SELECT MAX(date) FROM alerts)"))
def q_market_context_week(spark, sf):
    """D13 over weeks, which the panel's 30 days hold several of; the alert dates stand for regime shifts."""
    a = _actuals(spark, sf)
    alerts = panel.alerts(a)
    return panel.market_context(panel.to_master(a), alerts, 6, 7, regimes=alerts.select("date"))


# ---------------------------------------------------------------- A8 / F1 / E2 upsert, J1 / E3


@query("upsert_master", f"""{PANEL}
SELECT m.entity_id, m.date, m.brand, m.product_name, m.category, m.demand_index, m.price_index, m.sentiment_index,
  m.search_index, m.ad_index, m.health_index, m.xgb_pred_demand, m.xgb_pred_price, m.change_point, m.shift_strength,
  m.marker_type, m.event_explanation,
  CASE WHEN a.priority = 'high' THEN 'revised: ' || m.narrative ELSE m.narrative END AS narrative
FROM master m JOIN actuals a ON m.entity_id = a.entity_id AND m.date = a.date""")
def q_upsert_master(spark, sf):
    a = _actuals(spark, sf)
    existing = panel.to_master(a)
    revised = panel.to_master(a.filter(F.col("priority") == "high")) \
        .withColumn("narrative", F.concat(F.lit("revised: "), "narrative")) \
        .withColumn("extra_col", F.lit(1))       # not in the existing table: cut away
    return keys.upsert(existing, revised, ["entity_id", "date"])


@query("training_set", f"""WITH {fx.ACTUALS_CTE}
SELECT date, entity_id, demand_index, price_index, sentiment_index, search_index, ad_index FROM actuals
WHERE demand_index IS NOT NULL AND price_index IS NOT NULL AND sentiment_index IS NOT NULL
  AND search_index IS NOT NULL AND ad_index IS NOT NULL""")
def q_training_set(spark, sf):
    from ..operators.models import training_set
    a = _actuals(spark, sf)
    return training_set(a, a.filter(F.col("date") == a.select(F.max("date")).scalar()))


# ---------------------------------------------------------------- I5 backtest, D4, G22, G23, B14, B16

_BT_SQL = f"""WITH {fx.ACTUALS_CTE},{PREDS_SQL},{FVA_SQL},
nn AS (SELECT date, entity_id, abs_demand_error, row_number() OVER (ORDER BY date, entity_id) AS rn
  FROM fva WHERE abs_demand_error IS NOT NULL),
roll AS (SELECT date, AVG(abs_demand_error) OVER (ORDER BY rn ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m, rn FROM nn),
lastd AS (SELECT date, arg_max(m, rn) AS m FROM roll GROUP BY date),
per AS (SELECT date, COUNT(*) AS rows_ingested FROM actuals GROUP BY date),
d0 AS (SELECT per.date, rows_ingested,
  COALESCE({R("last_value(lastd.m IGNORE NULLS) OVER (ORDER BY per.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", 4)}, 0.0) AS drift_score,
  row_number() OVER (ORDER BY per.date) AS sim_day
  FROM per LEFT JOIN lastd ON per.date = lastd.date),
d1 AS (SELECT *, (sim_day > 0 AND sim_day % 7 = 0) OR drift_score > 8.0 AS retrained FROM d0),
days AS (SELECT sim_day, date, rows_ingested, drift_score, drift_score > 5.0 AS drift_flag, retrained,
  printf('v%.1f', 1.0 + SUM(CAST(retrained AS INTEGER)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 0.1) AS model_version
  FROM d1)"""


@query("backtest_days", f"{_BT_SQL}\nSELECT * FROM days")
def q_backtest_days(spark, sf):
    return bt.backtest(_actuals(spark, sf))["days"]


@query("backtest_fva", f"""{_BT_SQL},
fva2 AS (SELECT f.* EXCLUDE (model_version),
  CASE WHEN d.date IS NULL THEN 'v1.0' WHEN f.pred_demand IS NULL THEN '' ELSE d.model_version END AS model_version
  FROM fva f LEFT JOIN days d ON f.date = d.date + INTERVAL 1 DAY)
SELECT * FROM fva2""")
def q_backtest_fva(spark, sf):
    return bt.backtest(_actuals(spark, sf))["fva"]


@query("drift_history", f"""{_BT_SQL}
SELECT sim_day, date, drift_score AS combined_drift, drift_flag FROM days ORDER BY sim_day DESC LIMIT 30""")
def q_drift_history(spark, sf):
    days = bt.backtest(_actuals(spark, sf))["days"]
    return views.drift_history(days.withColumnRenamed("drift_score", "combined_drift"), 30)


@query("current_drift", f"""{_BT_SQL}
SELECT COALESCE(arg_max(drift_score, sim_day), 0.0) AS drift_score, COALESCE(arg_max(drift_score, sim_day), 0.0) > 5.0 AS drift_flag,
  CAST(5.0 AS DOUBLE) AS threshold FROM days""")
def q_current_drift(spark, sf):
    days = bt.backtest(_actuals(spark, sf))["days"]
    return views.current_drift(days.withColumnRenamed("drift_score", "combined_drift"))


@query("engine_state", f"""{_BT_SQL}
SELECT (SELECT MAX(date) FROM actuals) AS latest_ingested_date, (SELECT COUNT(*) FROM actuals) AS rows_processed,
  (SELECT COUNT(DISTINCT date) FROM actuals) AS sim_days,
  (SELECT MAX(sim_day) FROM days WHERE retrained) AS last_retrain_sim_day""")
def q_engine_state(spark, sf):
    a = _actuals(spark, sf)
    return views.engine_state(a, bt.backtest(a)["days"])


@query("ingest_order", f"""WITH {fx.ACTUALS_CTE}
SELECT date, COUNT(*) AS rows_ingested, lead(date) OVER (ORDER BY date) AS next_date FROM actuals GROUP BY date""")
def q_ingest_order(spark, sf):
    """E5 over every pointer: the date that follows each ingested date."""
    from ..sources.readers import ingest_order
    return ingest_order(_actuals(spark, sf))


# ---------------------------------------------------------------- B17 / B18 / B19


@query("list_conversations", "SELECT DISTINCT conv_id FROM conversations")
def q_list_conversations(spark, sf):
    return views.list_conversations(fx.table(spark, sf, "conversations"))


@query("conversation_history", """
SELECT conv_id, COUNT(*) AS n_turns,
  string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || COALESCE(text, ''), chr(10) ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 20
GROUP BY conv_id""")
def q_conversation_history(spark, sf):
    return views.conversation_history(fx.table(spark, sf, "conversations"), 20, "first")


@query("conversation_history_last", """
SELECT conv_id, COUNT(*) AS n_turns,
  string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || COALESCE(text, ''), chr(10) ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 20
GROUP BY conv_id""")
def q_conversation_history_last(spark, sf):
    return views.conversation_history(fx.table(spark, sf, "conversations"), 20, "last")


@query("conversation_history_short", """
SELECT conv_id, COUNT(*) AS n_turns,
  string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || COALESCE(text, ''), chr(10) ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3
GROUP BY conv_id""")
def q_conversation_history_short(spark, sf):
    """B18 with a limit below the length of the conversations, which hold at most eight turns."""
    return views.conversation_history(fx.table(spark, sf, "conversations"), 3, "last")


@query("actuals_log", f"WITH {fx.ACTUALS_CTE}\nSELECT * FROM actuals ORDER BY date, entity_id")
def q_actuals_log(spark, sf):
    return views.read_log(_actuals(spark, sf))
