"""Read queries over the serving tables (B1-B19). Each is a projection / filter / top-k that
Catalyst pushes into the scan; entity and date filters prune ``date``-partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import DRIFT_FLAG_THRESHOLD, round_half_up
from .keys import project_available

# Column lists of the read views, in the order they are served.
DAILY_VIEW = ["date", "avg_actual_demand", "avg_predicted_demand", "avg_actual_price", "avg_predicted_price",
              "avg_sentiment", "avg_ad_index", "total_stat_events", "total_top_peaks", "total_bottom_peaks",
              "change_point", "shift_strength"]
REGIME_VIEW = ["date", "regime_type", "shift_strength", "marker_label", "event_explanation", "narrative"]
ALERT_VIEW = ["date", "entity_id", "brand", "category", "marker_type", "alert_title", "event_explanation",
              "narrative", "event_severity_score", "demand_index", "price_index", "sentiment_index",
              "search_index", "ad_index"]
SERIES_VIEW = ["date", "demand_index", "price_index", "sentiment_index", "search_index", "ad_index",
               "health_index", "change_point", "shift_strength"]
MARKER_VIEW = ["date", "marker_type", "marker_label", "event_severity_score", "combined_marker_severity",
               "shift_strength", "demand_index", "price_index", "sentiment_index", "search_index", "ad_index",
               "event_explanation", "narrative"]
PRODUCT_ALERT_VIEW = ["date", "marker_type", "alert_title", "event_explanation", "narrative",
                      "event_severity_score", "demand_index", "price_index", "sentiment_index"]
EVENT_VIEW = ["date", "brand", "product_name", "event_type", "event_title", "event_description",
              "impact_direction", "priority", "linked_marker_date", "linked_marker_type", "signal_story"]
FVA_VIEW = ["date", "entity_id", "pred_demand", "actual_demand", "demand_error", "abs_demand_error",
            "pred_price", "actual_price", "price_error", "event_type", "event_effect_hint", "model_version"]
NO_EXPLANATION = "No detailed explanation available."


def filter_categories(master: DataFrame) -> DataFrame:
    """B2: sorted distinct categories."""
    return master.select("category").distinct().orderBy("category")


def filter_brands(master: DataFrame) -> DataFrame:
    """B2: sorted distinct brands."""
    return master.select("brand").distinct().orderBy("brand")


def filter_entities(latest_rows: DataFrame) -> DataFrame:
    """B2: latest entities sorted by brand (entity id breaks ties)."""
    return latest_rows.select("entity_id", "brand", "product_name", "category").orderBy("brand", "entity_id")


def daily_summary_view(daily: DataFrame) -> DataFrame:
    """B3."""
    return project_available(daily, DAILY_VIEW)


def forecast_view(forecast: DataFrame) -> DataFrame:
    """B4."""
    return project_available(forecast, ["date", "forecast_avg_price"])


def regime_view(regime: DataFrame) -> DataFrame:
    """B5."""
    return project_available(regime, REGIME_VIEW)


def top_alerts(alert_rows: DataFrame, limit: int = 20, brand: str | None = None) -> DataFrame:
    """Optional case-insensitive brand filter, severity descending (nulls last), top ``limit``.
    Ties are made deterministic by (date, entity_id). Planned as TakeOrderedAndProject."""
    df = alert_rows
    if brand:
        df = df.filter(F.lower("brand") == brand.lower())
    df = df.orderBy(F.col("event_severity_score").desc_nulls_last(), "date", "entity_id").limit(limit)
    return project_available(df, ALERT_VIEW)


def product_overview(latest_rows: DataFrame, entity_id=None) -> DataFrame:
    """The latest row of one entity (of each, without one) with per-column rounding; absent columns default to 0."""
    df = latest_rows if entity_id is None else latest_rows.filter(F.col("entity_id") == F.lit(entity_id))

    def r(c, d):
        return round_half_up(F.col(c), d) if c in latest_rows.columns else F.lit(0.0)
    return df.select("entity_id", "brand", "product_name", "category",
                     r("demand_index", 2).alias("demand_index"), r("price_index", 2).alias("price_index"),
                     r("sentiment_index", 4).alias("sentiment_index"), r("search_index", 2).alias("search_index"),
                     r("ad_index", 2).alias("ad_index"), r("health_index", 2).alias("health_index"),
                     r("list_price", 2).alias("list_price"))


def product_series(master: DataFrame, entity_id=None) -> DataFrame:
    """One entity's time series by date; without an entity every series, by entity and date."""
    if entity_id is None:
        return project_available(master.orderBy("entity_id", "date"), ["entity_id", *SERIES_VIEW])
    df = master.filter(F.col("entity_id") == F.lit(entity_id)).orderBy("date")
    return project_available(df, SERIES_VIEW)


def product_markers(markers: DataFrame, entity_id) -> DataFrame:
    """B9."""
    return project_available(markers.filter(F.col("entity_id").cast("string") == str(entity_id)), MARKER_VIEW)


def product_alerts(alert_rows: DataFrame, entity_id=None, limit: int = 10) -> DataFrame:
    """One entity's alerts, severity descending, then date and type, top ``limit``; without an entity the top of
    each (a per-entity top-k, limited before the shuffle too)."""
    order = [F.col("event_severity_score").desc_nulls_last(), F.col("date"), F.col("marker_type")]
    if entity_id is None:
        w = Window.partitionBy("entity_id").orderBy(*order)
        top = alert_rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
        return project_available(top, ["entity_id", *PRODUCT_ALERT_VIEW])
    df = (alert_rows.filter(F.col("entity_id").cast("string") == str(entity_id))
          .orderBy(*order).limit(limit))
    return project_available(df, PRODUCT_ALERT_VIEW)


def product_events(events: DataFrame, entity_id) -> DataFrame:
    """B11."""
    return project_available(events.filter(F.col("entity_id").cast("string") == str(entity_id)), EVENT_VIEW)


def explain_lookup(expl: DataFrame, entity_id, date) -> DataFrame:
    """Explanation text for (entity, date), or a default sentence. Always one row."""
    hit = (expl.filter((F.col("entity_id") == F.lit(entity_id)) & (F.col("date") == F.lit(date).cast("date")))
           .agg(F.min_by("event_explanation", "event_explanation").alias("t")))
    return hit.select(F.coalesce("t", F.lit(NO_EXPLANATION)).alias("answer"))


def explain_all(expl: DataFrame, keys: DataFrame) -> DataFrame:
    """B12 for every (entity_id, date) of ``keys``: its explanation, or the default sentence where there is none."""
    hit = expl.groupBy("entity_id", "date").agg(F.min("event_explanation").alias("t"))
    return (keys.select("entity_id", "date").distinct().join(hit, ["entity_id", "date"], "left")
            .select("entity_id", "date", F.coalesce("t", F.lit(NO_EXPLANATION)).alias("answer")))


def recent_fva(fva: DataFrame, limit: int = 50) -> DataFrame:
    """Newest comparison rows first."""
    return project_available(fva.orderBy(F.col("date").desc(), F.col("entity_id").desc()).limit(limit), FVA_VIEW)


def drift_history(snaps: DataFrame, limit: int = 30) -> DataFrame:
    """Most recent drift snapshots."""
    return snaps.orderBy(F.col("sim_day").desc()).limit(limit) \
        .select("sim_day", "date", "combined_drift", "drift_flag")


def current_drift(snaps: DataFrame, threshold: float = DRIFT_FLAG_THRESHOLD) -> DataFrame:
    """Latest drift with flag and threshold (0.0 when there is no snapshot)."""
    last = snaps.agg(F.max_by("combined_drift", "sim_day").alias("d"))
    d = F.coalesce(F.col("d"), F.lit(0.0))
    return last.select(d.alias("drift_score"), (d > threshold).alias("drift_flag"),
                       F.lit(threshold).alias("threshold"))


def model_status(registry: DataFrame) -> DataFrame:
    """Current version's metadata plus the list of versions.
    Registry rows are one per version, so the collected list is bounded by the version count."""
    return registry.agg(
        F.max_by("model_version", "created_seq").alias("current_version"),
        F.max_by("rows_seen", "created_seq").alias("rows_seen"),
        F.max_by("training_mae", "created_seq").alias("rolling_mae"),
        F.max_by("retrain_reason", "created_seq").alias("retrain_reason"),
        F.sort_array(F.collect_list(F.struct("created_seq", "model_version")))
        .getField("model_version").alias("all_versions"))


def engine_state(actuals_log: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Latest ingested date, rows processed, simulated days (distinct dates), last retrain day."""
    a = actuals_log.agg(F.max("date").alias("latest_ingested_date"),
                        F.count(F.lit(1)).alias("rows_processed"),
                        F.count_distinct("date").alias("sim_days"))
    if jobs is None:
        return a.withColumn("last_retrain_sim_day", F.lit(None).cast("bigint"))
    j = jobs.filter("retrained").agg(F.max("sim_day").cast("bigint").alias("last_retrain_sim_day"))
    return a.withColumn("last_retrain_sim_day", j.scalar())


def list_conversations(msgs: DataFrame) -> DataFrame:
    """Distinct conversation ids."""
    return msgs.select("conv_id").distinct()


def conversation_history(msgs: DataFrame, limit: int = 20, take: str = "first") -> DataFrame:
    """Per conversation, ``limit`` turns (first or last by turn) rendered as
    ``User: ...`` / ``Assistant: ...`` lines joined by newline.

    ``row_number() <= limit`` becomes a WindowGroupLimit before the shuffle, so at most ``limit``
    rows per conversation and map task are shuffled and the collected array is bounded by
    ``limit``."""
    o = F.col("turn").asc() if take == "first" else F.col("turn").desc()
    w = Window.partitionBy("conv_id").orderBy(o)
    top = msgs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "),
                    F.coalesce("text", F.lit("")))
    return (top.groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), line.alias("l")))).alias("_t"),
                 F.count(F.lit(1)).alias("n_turns"))
            .select("conv_id", "n_turns", F.array_join(F.col("_t").getField("l"), "\n").alias("history")))


def read_log(df: DataFrame, date_col: str = "date", date=None, order=("date", "entity_id")) -> DataFrame:
    """Whole log ordered, or one date (partition-pruned when the table is partitioned by it)."""
    if date is not None:
        df = df.filter(F.col(date_col) == F.lit(date).cast("date"))
    return df.orderBy(*order)


def filter_values(master: DataFrame, latest_rows: DataFrame) -> dict[str, DataFrame]:
    """B2 as one call: sorted categories, sorted brands, latest entities sorted by brand."""
    return {"categories": filter_categories(master), "brands": filter_brands(master),
            "entities": filter_entities(latest_rows)}
