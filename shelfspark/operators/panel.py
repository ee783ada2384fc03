"""Daily market panel: master rows, forecasts, forecast-vs-actual, drift, serving aggregates,
explanations and alerts (G17-G21, C1, D1-D5, D13, E8, E9, E11).

Every operator is a set-based DataFrame plan over the whole panel (all dates at once); the
reference's one-date-per-tick loop is the special case of filtering one date first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import (DRIFT_FLAG_THRESHOLD, c_hash_noise, c_health, c_momentum,
                                 round_half_up)
from .keys import keep_last
from .ranks import dense_rank_desc

INDEX_COLS = ["demand_index", "price_index", "sentiment_index", "search_index", "ad_index"]

# Column lists of the master panel and the serving tables.
MASTER_COLS = ["entity_id", "date", "brand", "product_name", "category", "demand_index", "price_index",
               "sentiment_index", "search_index", "ad_index", "health_index", "xgb_pred_demand",
               "xgb_pred_price", "change_point", "shift_strength", "marker_type", "event_explanation",
               "narrative"]
FVA_COLS = ["date", "entity_id", "pred_demand", "actual_demand", "demand_error", "abs_demand_error",
            "pred_price", "actual_price", "price_error", "abs_price_error", "event_type",
            "event_effect_hint", "model_version"]
DEFAULT_VERSION = "v1.0"


def _s(c: str):
    """Missing strings become '' (the reference wrote the text "nan"; deliberate fix)."""
    return F.coalesce(F.col(c), F.lit(""))


def to_master(actuals: DataFrame) -> DataFrame:
    """Master row per actual: health index, placeholder model columns, zeros."""
    return actuals.select(
        "entity_id", "date", _s("brand").alias("brand"), _s("product_name").alias("product_name"),
        _s("category").alias("category"), *INDEX_COLS,
        c_health().alias("health_index"),
        (F.col("demand_index") * 0.98).alias("xgb_pred_demand"),
        (F.col("price_index") * 1.01).alias("xgb_pred_price"),
        F.lit(0).cast("bigint").alias("change_point"),
        F.lit(0.0).alias("shift_strength"),
        F.lit("none").alias("marker_type"),
        _s("event_description").alias("event_explanation"),
        _s("signal_story").alias("narrative"))


def next_day_forecast(actuals: DataFrame, version=DEFAULT_VERSION, noise: float = 0.0, demand: Column | None = None) -> DataFrame:
    """Momentum forecast for date + 1 per (entity, date).

    ``version`` is a literal or a Column (the backtest passes the version in force that day).
    ``noise`` is the amplitude of a deterministic hash noise on price (0 = none); ``demand`` replaces the momentum forecast."""
    v = F.lit(version) if isinstance(version, str) else version
    target, demand, price = forecast_columns(noise, demand)
    return actuals.select(target.alias("target_date"), "entity_id", demand.alias("pred_demand"), price.alias("pred_price"),
                          v.alias("model_version"))


def forecast_columns(noise: float = 0.0, demand: Column | None = None) -> tuple[Column, Column, Column]:
    """Target date, demand (momentum unless given) and price of a panel row's forecast for the next day."""
    return (F.date_add("date", 1), round_half_up(F.col("demand_index") * c_momentum(), 4) if demand is None else demand,
            round_half_up(F.col("price_index") * (1 + c_hash_noise(noise, "entity_id", "date")), 4))


def forecast_vs_actual(actuals: DataFrame, predictions: DataFrame) -> DataFrame:
    """Actuals LEFT JOIN predictions on (entity_id, date = target_date).

    Predictions are first reduced to one row per key (the reference's log had no key and could
    fan rows out). A date with no prediction at all gets version ``v1.0``; an entity missing from
    an otherwise predicted date gets ''. The join is an equi-join on both keys: AQE picks
    broadcast or sort-merge from runtime sizes and splits skewed partitions."""
    order = ["prediction_ts"] if "prediction_ts" in predictions.columns else ["model_version"]
    p = keep_last(predictions, ["entity_id", "target_date"], order) \
        .select(F.col("target_date").alias("date"), "entity_id", "pred_demand", "pred_price",
                F.col("model_version").alias("_pv"))
    predicted_dates = predictions.select(F.col("target_date").alias("date")).distinct() \
        .withColumn("_has_pred", F.lit(True))
    j = actuals.join(p, ["entity_id", "date"], "left").join(predicted_dates, "date", "left")
    d_err = F.col("demand_index") - F.col("pred_demand")
    p_err = F.col("price_index") - F.col("pred_price")
    return j.select(
        "date", "entity_id", "pred_demand", F.col("demand_index").alias("actual_demand"),
        d_err.alias("demand_error"), F.abs(d_err).alias("abs_demand_error"),
        "pred_price", F.col("price_index").alias("actual_price"),
        p_err.alias("price_error"), F.abs(p_err).alias("abs_price_error"),
        _s("event_type").alias("event_type"), _s("event_effect_hint").alias("event_effect_hint"),
        F.when(F.col("_has_pred").isNull(), F.lit(DEFAULT_VERSION))
         .otherwise(F.coalesce(F.col("_pv"), F.lit(""))).alias("model_version"))


def daily_summary(actuals: DataFrame) -> DataFrame:
    """One row per date (partial aggregation map-side, one shuffle on date)."""
    d = F.avg("demand_index")
    p = F.avg("price_index")
    return actuals.groupBy("date").agg(
        round_half_up(d, 4).alias("avg_actual_demand"),
        round_half_up(d * 0.98, 4).alias("avg_predicted_demand"),
        round_half_up(p, 4).alias("avg_actual_price"),
        round_half_up(p * 1.01, 4).alias("avg_predicted_price"),
        round_half_up(F.avg("sentiment_index"), 6).alias("avg_sentiment"),
        round_half_up(F.avg("ad_index"), 4).alias("avg_ad_index"),
        F.count(F.lit(1)).alias("total_stat_events"),
        F.count_if(F.col("impact_direction") == "positive").alias("total_top_peaks"),
        F.count_if(F.col("impact_direction") == "negative").alias("total_bottom_peaks"),
        F.lit(0).cast("bigint").alias("change_point"),
        F.lit(0.0).alias("shift_strength"))


def avg_fixed(c, digits: int):
    """Exact mean of values that carry at most ``digits`` decimals: sum them as scaled integers
    (order-free, so every partitioning gives the same bits), divide once."""
    m = float(10 ** digits)
    return F.sum(F.round(F.col(c) * m).cast("bigint")) / (F.count(c) * m)


def forecast_avg(predictions: DataFrame) -> DataFrame:
    """Average predicted price per target date, rounded to 4 (NULL prices skipped).
    Predictions carry 4 decimals, so the mean is computed exactly (see ``avg_fixed``)."""
    return predictions.groupBy(F.col("target_date").alias("date")) \
        .agg(round_half_up(avg_fixed("pred_price", 4), 4).alias("forecast_avg_price"))


# Own wording; the branch logic and slots follow the reference.
def explanations(actuals: DataFrame) -> DataFrame:
    """One explanation per (entity, date)."""
    hint = F.lower(_s("event_effect_hint"))
    title = F.lower(_s("event_title"))
    story = _s("signal_story")
    direction = _s("impact_direction")
    text = (F.when((direction == "positive") & hint.contains("uplift"),
                   F.concat(F.lit("Demand beat the forecast following "), title,
                            F.lit(" and stronger search interest. "), story))
            .when((direction == "negative") & hint.contains("softness"),
                  F.concat(F.lit("Demand fell short of the forecast, probably because of "), title,
                           F.lit(" or fading momentum. "), story))
            .when(story != "", F.concat(F.lit("Signal: "), story))
            .otherwise(F.lit("No significant deviation.")))
    return actuals.select("entity_id", "date", _s("brand").alias("brand"), _s("category").alias("category"),
                          _s("event_type").alias("marker_type"), text.alias("event_explanation"),
                          story.alias("narrative"), "demand_index", "price_index")


def alerts(actuals: DataFrame, noise: float = 0.0) -> DataFrame:
    """Alert rows for high-priority events (all rows if there is no priority column).
    Severity is 2.5 plus a deterministic noise in [0, noise)."""
    src = actuals.filter(F.col("priority") == "high") if "priority" in actuals.columns else actuals
    sev = F.lit(2.5) + (c_hash_noise(noise / 2, "entity_id", "date") + noise / 2 if noise else F.lit(0.0))
    return src.select(
        "date", "entity_id", _s("brand").alias("brand"), _s("category").alias("category"),
        F.coalesce(F.col("event_type"), F.lit("realtime_signal")).alias("marker_type"),
        F.coalesce(F.col("event_title"), F.lit("Realtime Signal")).alias("alert_title"),
        _s("event_description").alias("event_explanation"), _s("signal_story").alias("narrative"),
        round_half_up(sev, 4).alias("event_severity_score"), *INDEX_COLS)


def drift_last_rows(fva: DataFrame, window_rows: int = 7, mode: str = "demand") -> DataFrame:
    """D3: drift over the last ``window_rows`` comparison rows with a demand error (insertion
    order = (date, entity_id)); 0.0 when there are none. A global top-k (TakeOrderedAndProject:
    k rows per partition, merged), then one tiny aggregate."""
    last = (fva.filter(F.col("abs_demand_error").isNotNull())
            .orderBy(F.col("date").desc(), F.col("entity_id").desc()).limit(window_rows))
    agg = last.agg(F.avg("abs_demand_error").alias("mae_d"), F.avg("abs_price_error").alias("mae_p"),
                   F.avg("actual_price").alias("avg_p"), F.count(F.lit(1)).alias("n"))
    score = F.col("mae_d")
    if mode == "combined":
        score = 0.5 * F.col("mae_d") + 0.5 * F.coalesce(F.try_divide(F.col("mae_p"), F.col("avg_p")), F.lit(0.0))
    return agg.select(F.coalesce(round_half_up(score, 4), F.lit(0.0)).alias("drift_score"),
                      F.col("n").alias("rows_used"))


def drift_snapshot(drift: DataFrame, threshold: float = DRIFT_FLAG_THRESHOLD) -> DataFrame:
    """Snapshot columns from a drift score (and optional sim_day/date columns)."""
    keep = [c for c in ("sim_day", "date") if c in drift.columns]
    return drift.select(*keep, F.col("drift_score").alias("rolling_mae_demand"),
                        F.lit(0.0).alias("rolling_mae_price"),
                        F.col("drift_score").alias("combined_drift"),
                        (F.col("drift_score") > threshold).alias("drift_flag"))


def per_day_drift_last_rows(fva: DataFrame, window_rows: int = 7) -> DataFrame:
    """Drift as the tick loop saw it: after comparing date D, the mean error of the last
    ``window_rows`` non-null rows with date <= D, for every date of ``fva``.

    Only the last ``window_rows`` rows of each date can ever be in such a window, so we keep
    those (a per-date top-k, pre-limited map-side; rows without an error last, so that every date is
    there) and run the rolling window over that small table: it holds at most ``window_rows`` x #dates
    rows whatever the panel size."""
    err = F.col("abs_demand_error")
    w_top = Window.partitionBy("date").orderBy(err.isNull(), F.col("entity_id").desc())
    tops = (fva.select("date", "entity_id", "abs_demand_error").withColumn("_r", F.row_number().over(w_top))
            .filter(F.col("_r") <= window_rows))
    # Bounded table (window_rows x #dates): ordered windows are fine here.
    w = Window.partitionBy(err.isNull()).orderBy("date", "entity_id").rowsBetween(-(window_rows - 1), 0)
    rolled = tops.withColumn("_m", F.avg("abs_demand_error").over(w))
    last_of_day = rolled.groupBy("date").agg(F.max_by("_m", F.when(err.isNotNull(), F.col("entity_id"))).alias("_m"))
    # dates with no non-null row inherit the previous window (carry forward)
    wd = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (last_of_day.withColumn("_m", F.last("_m", ignorenulls=True).over(wd))
            .select("date", F.coalesce(round_half_up("_m", 4), F.lit(0.0)).alias("drift_score")))


def drift_rolling(fva: DataFrame, window_days: int = 7, mode: str = "combined") -> DataFrame:
    """E8 (documented form): per day, mean absolute error over the last ``window_days`` calendar
    days. Sums and counts per date first (partial aggregation), then a range window over the
    per-date table (one row per date)."""
    per = fva.groupBy("date").agg(
        F.sum("abs_demand_error").alias("sd"), F.count("abs_demand_error").alias("nd"),
        F.sum("abs_price_error").alias("sp"), F.count("abs_price_error").alias("np"),
        F.sum("actual_price").alias("sa"), F.count("actual_price").alias("na"))
    per = per.withColumn("_day", F.unix_date("date"))
    w = Window.orderBy("_day").rangeBetween(-(window_days - 1), 0)   # one row per date
    r = per.select("date", *[F.sum(c).over(w).alias(c) for c in ("sd", "nd", "sp", "np", "sa", "na")])
    mae_d = F.try_divide(F.col("sd"), F.col("nd"))
    mae_p = F.try_divide(F.col("sp"), F.col("np"))
    rel_p = F.try_divide(mae_p, F.try_divide(F.col("sa"), F.col("na")))
    combined = 0.5 * F.coalesce(mae_d, F.lit(0.0)) + 0.5 * F.coalesce(rel_p, F.lit(0.0)) \
        if mode == "combined" else F.coalesce(mae_d, F.lit(0.0))
    return r.select("date", round_half_up(mae_d, 4).alias("rolling_mae_demand"),
                    round_half_up(mae_p, 4).alias("rolling_mae_price"),
                    round_half_up(combined, 4).alias("combined_drift"))


def zscore_alerts(master: DataFrame, threshold: float = 2.5, value: str = "demand_index") -> DataFrame:
    """E9 (documented-only): rows whose value is more than ``threshold`` sample standard
    deviations from the entity's mean. Stats by a partial aggregate + equi-join (skew-safe),
    not a window that would pull a whole entity into one task."""
    stats = master.groupBy("entity_id").agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    z = F.try_divide(F.col(value) - F.col("_mu"), F.col("_sd"))
    return (master.join(stats, "entity_id")
            .withColumn("zscore", z)
            .filter(F.abs(F.col("zscore")) > threshold)
            .select("entity_id", "date", "brand", "category", F.col(value),
                    round_half_up("zscore", 4).alias("zscore")))


def panel_features(master: DataFrame, lags=(1, 2, 3, 7), value: str = "demand_index", roll_days=(3, 7, 14),
                   z_days: int = 7, events: DataFrame | None = None) -> DataFrame:
    """E11 (documented-only): calendar-day lags, rolling means over each of ``roll_days``, z-score over ``z_days``,
    momentum, rank within category per day, event flag: a row of ``events`` (entity_id, date) or, without that table, a
    marker in the row itself.

    Windows are per entity ordered by day number; the panel is unique on (entity, date), so one
    entity holds at most #days rows and the window partitions are bounded. A category may hold any number of entities a
    day: its ranks are made by ``ranks.dense_rank_desc``."""
    base = master.withColumn("_day", F.unix_date("date"))
    if events is None:
        flag = F.col("marker_type") != "none" if "marker_type" in master.columns else F.lit(False)
    else:
        marked = events.select("entity_id", "date").distinct().withColumn("_event", F.lit(True))
        base, flag = base.join(marked, ["entity_id", "date"], "left"), F.coalesce("_event", F.lit(False))
    w = Window.partitionBy("entity_id").orderBy("_day")
    over = lambda n: w.rangeBetween(-(n - 1), 0)
    out = base.select(
        "entity_id", "date", "category", value, *[F.first(value).over(w.rangeBetween(-k, -k)).alias(f"lag_{k}") for k in lags],
        *[round_half_up(F.avg(value).over(over(n)), 4).alias(f"roll_mean_{n}") for n in roll_days],
        F.stddev_samp(value).over(over(z_days)).alias("_sd"), F.avg(value).over(over(z_days)).alias("_mu"),
        flag.alias("event_flag"))
    out = dense_rank_desc(out, ["category", "date"], value, "rank_in_category")
    return out.select(
        "entity_id", "date", "category", value, *[f"lag_{k}" for k in lags], *[f"roll_mean_{n}" for n in roll_days],
        round_half_up(F.try_divide(F.col(value) - F.col("_mu"), F.col("_sd")), 4).alias("zscore"),
        round_half_up(F.try_divide(F.col(value), F.col("lag_1")) - 1, 4).alias("momentum"),
        "rank_in_category", "event_flag")


def category_summary(latest_rows: DataFrame, category: str | None = None) -> DataFrame:
    """Per category over the latest row of each entity: count, means, top brand by health
    (largest health, smallest entity id on ties). One hash aggregate; ``max_by`` is partial, so a
    hot category is combined map-side. ``category`` filters case-insensitively."""
    df = latest_rows
    if category is not None:
        df = df.filter(F.lower("category") == category.lower())
    return df.groupBy("category").agg(
        F.count(F.lit(1)).alias("count"),
        round_half_up(F.avg("demand_index"), 2).alias("avg_demand"),
        round_half_up(F.avg("price_index"), 2).alias("avg_price"),
        round_half_up(F.avg("sentiment_index") * 100, 1).alias("avg_sentiment"),
        round_half_up(F.avg("ad_index"), 2).alias("avg_ad_index"),
        round_half_up(F.avg("health_index"), 2).alias("avg_health"),
        F.max_by("brand", F.struct(F.col("health_index"), -F.col("entity_id"))).alias("top_brand"))


def category_products(latest_rows: DataFrame, category: str | None = None) -> DataFrame:
    """D5 product list: the category's entities by health descending. Returned as a flat,
    globally sorted table (range partitioning splits a hot category across tasks) instead of one
    collected array per category."""
    df = latest_rows
    if category is not None:
        df = df.filter(F.lower("category") == category.lower())
    return df.select("category", "entity_id", "brand", "product_name", "demand_index", "price_index",
                     "sentiment_index", "health_index") \
        .orderBy("category", F.col("health_index").desc_nulls_last(), "entity_id")


def market_context(master: DataFrame, alert_rows: DataFrame, top_n: int = 6, days: int = 30,
                   regimes: DataFrame | None = None) -> DataFrame:
    """Per category: mean demand, mean sentiment (%), price change between the last
    ``days`` days and the ``days`` before, and the top ``top_n`` brands by mean demand with
    their strongest alert. One row per (category, brand rank). ``latest_regime_shift`` is the last date of ``regimes``
    (date, ...), null without that table."""
    # latest date as a scalar subquery (no join, no driver round trip)
    m = master.withColumn("_maxd", master.agg(F.max("date")).scalar())
    recent = F.col("date") > F.date_sub("_maxd", days)
    prior = (F.col("date") <= F.date_sub("_maxd", days)) & (F.col("date") > F.date_sub("_maxd", 2 * days))
    cat = m.groupBy("category").agg(
        round_half_up(F.avg("demand_index"), 2).alias("avg_demand"),
        round_half_up(F.avg("sentiment_index") * 100, 1).alias("avg_sentiment"),
        F.avg(F.when(recent, F.col("price_index"))).alias("_pr"),
        F.avg(F.when(prior, F.col("price_index"))).alias("_pp"))
    cat = cat.select("category", "avg_demand", "avg_sentiment",
                     round_half_up((F.try_divide(F.col("_pr"), F.col("_pp")) - 1) * 100, 1)
                     .alias("price_change_pct"))
    brands = master.groupBy("category", "brand").agg(F.avg("demand_index").alias("_bd"))
    sev = alert_rows.groupBy("category", "brand").agg(F.max("event_severity_score").alias("max_alert_severity"))
    wb = Window.partitionBy("category").orderBy(F.col("_bd").desc(), F.col("brand"))
    top = (brands.withColumn("brand_rank", F.row_number().over(wb))
           .filter(F.col("brand_rank") <= top_n)
           .join(sev, ["category", "brand"], "left"))
    return top.join(cat, "category").select(
        "category", "avg_demand", "avg_sentiment", "price_change_pct",
        F.col("brand_rank").cast("bigint").alias("brand_rank"), "brand",
        round_half_up("_bd", 2).alias("brand_demand"), "max_alert_severity",
        (regimes.agg(F.max("date")).scalar() if regimes is not None else F.lit(None).cast("date")).alias("latest_regime_shift"))
