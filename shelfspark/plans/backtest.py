"""I5 backtest and I4 tick: the daily loop as set-based plans.

The reference ingests one date per tick: compare with yesterday's forecast, compute drift,
decide on retraining, forecast tomorrow, refresh serving tables. All of that only looks back,
so any number of dates can be processed at once: the forecast from day d is joined to day d+1,
drift is a window over a small per-date table, and the model version in force is a running count
of retrains. ``advance`` does this for a block of new dates on top of the state left by earlier
blocks; the batch backtest is ``advance`` from an empty state and the streaming tick (K2) calls
it once per micro-batch, so stream and batch give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import (DRIFT_FLAG_THRESHOLD, DRIFT_RETRAIN_THRESHOLD, RETRAIN_EVERY_N_DAYS,
                                 c_should_retrain, c_version_after)
from ..operators import panel
from ..operators.keys import keep_last


def decisions(fva: DataFrame, window_rows: int = 7, every: int = RETRAIN_EVERY_N_DAYS,
              retrain_threshold: float = DRIFT_RETRAIN_THRESHOLD, flag_threshold: float = DRIFT_FLAG_THRESHOLD,
              sim_day0=0, retrains0=0, after=None) -> DataFrame:
    """One row per date of ``fva`` (later than ``after``, if given): sim_day, drift, flag, retrain decision and the
    model version in force after the decision. ``fva`` holds the new comparison rows plus the tail of earlier ones.
    ``sim_day0`` / ``retrains0`` carry the counters of earlier blocks. The ordered windows run over one row per date."""
    drift = panel.per_day_drift_last_rows(fva, window_rows)
    if after is not None:
        drift = drift.filter(F.col("date") > after)
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    w = Window.orderBy("date")
    d = drift.withColumn("sim_day", (F.row_number().over(w) + as_col(sim_day0)).cast("bigint"))
    d = d.withColumn("retrained", c_should_retrain("sim_day", "drift_score", every, retrain_threshold))
    n = F.sum(F.col("retrained").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + as_col(retrains0)
    return d.select("sim_day", "date", "drift_score", (F.col("drift_score") > flag_threshold).alias("drift_flag"),
                    "retrained", c_version_after(n).alias("model_version"))


def compare(actuals: DataFrame, stored: DataFrame | None, noise: float, demand: Column | None = None) -> DataFrame:
    """Comparison rows of a block, without their version: each row against the forecast of the entity's row on the day
    before (the last row by date, if it is that day's), else against a stored forecast. One shuffle by entity.

    ``own``: the forecast is the block's; ``stored_version``: the version of a stored one; ``demand``: the demand that each row
    forecasts for the next day (a model's), by default the momentum forecast."""
    w = Window.partitionBy("entity_id").orderBy("date")
    made = F.struct(*[f.alias(n) for n, f in zip(("target_date", "pred_demand", "pred_price"), panel.forecast_columns(noise, demand), strict=True)])
    j = actuals.withColumn("_made", made).withColumn("_before", F.lag("_made").over(w)).drop("_made")
    j = j.withColumn("_before", F.when(F.col("_before.target_date") == F.col("date"), F.col("_before")))
    if stored is not None:
        s = keep_last(stored, ["entity_id", "target_date"], ["model_version"]).select(
            F.col("target_date").alias("date"), "entity_id", F.struct("pred_demand", "pred_price", "model_version").alias("_stored"))
        j = j.join(s, ["entity_id", "date"], "left")
    else:
        j = j.withColumn("_stored", F.lit(None).cast("struct<pred_demand:double,pred_price:double,model_version:string>"))
    pick = lambda c: F.when(F.col("_before").isNotNull(), F.col(f"_before.{c}")).otherwise(F.col(f"_stored.{c}"))
    d_err, p_err = F.col("demand_index") - pick("pred_demand"), F.col("price_index") - pick("pred_price")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return j.select("date", "entity_id", pick("pred_demand").alias("pred_demand"), F.col("demand_index").alias("actual_demand"),
                    d_err.alias("demand_error"), F.abs(d_err).alias("abs_demand_error"), pick("pred_price").alias("pred_price"),
                    F.col("price_index").alias("actual_price"), p_err.alias("price_error"), F.abs(p_err).alias("abs_price_error"),
                    text("event_type").alias("event_type"), text("event_effect_hint").alias("event_effect_hint"),
                    F.col("_before").isNotNull().alias("own"), F.col("_stored.model_version").alias("stored_version"))


def decide(new_actuals: DataFrame, prev_fva: DataFrame | None = None, prev_days: DataFrame | None = None,
           prev_preds: DataFrame | None = None, window_rows: int = 7, noise: float = 0.0, demand: Column | None = None,
           counters: tuple[int, int] = (0, 0), **rule) -> tuple[DataFrame, DataFrame]:
    """Comparison rows of a block (without their version) and its decisions, one row a date. ``rule``: thresholds of
    ``decisions``; the rest as in ``advance``."""
    fva0 = compare(new_actuals, prev_preds, noise, demand)
    history, after = fva0.select("date", "entity_id", "abs_demand_error"), None
    if prev_fva is not None:
        tail = (prev_fva.filter(F.col("abs_demand_error").isNotNull())
                .orderBy(F.col("date").desc(), F.col("entity_id").desc()).limit(window_rows))
        history = tail.select(*history.columns).unionByName(history)
        after = F.coalesce(tail.agg(F.max("date")).scalar(), F.lit("0001-01-01").cast("date"))
    sim0, ret0 = counters
    if prev_days is not None:
        sim0 = F.coalesce(prev_days.agg(F.max("sim_day")).scalar(), F.lit(0))
        ret0 = F.coalesce(prev_days.agg(F.count_if("retrained")).scalar(), F.lit(0))
    return fva0, decisions(history, window_rows, sim_day0=sim0, retrains0=ret0, after=after, **rule)


def label(new_actuals: DataFrame, fva0: DataFrame, chosen: DataFrame, prev_preds: DataFrame | None = None, noise: float = 0.0,
          demand: Column | None = None) -> dict[str, DataFrame]:
    """``fva``, ``days`` and ``predictions`` of a block from its comparison rows and decisions: forecast values do not depend
    on the version label, which comes from the table of days."""
    versions = chosen.select(F.date_add("date", 1).alias("date"), F.col("model_version").alias("_own_version"))
    fva = fva0.join(versions, "date", "left")
    predicted = F.col("_own_version").isNotNull()
    if prev_preds is not None:
        fva = fva.join(prev_preds.select(F.col("target_date").alias("date"), F.lit(True).alias("_was")).distinct(), "date", "left")
        predicted = predicted | F.coalesce("_was", F.lit(False))
    version = (F.when(F.col("own"), F.col("_own_version")).when(F.col("stored_version").isNotNull(), F.col("stored_version"))
               .when(predicted, F.lit("")).otherwise(F.lit(panel.DEFAULT_VERSION)))
    rows = new_actuals.groupBy("date").agg(F.count(F.lit(1)).alias("rows_ingested"))
    days = rows.join(chosen, "date").select("sim_day", "date", F.col("rows_ingested").cast("bigint").alias("rows_ingested"), "drift_score",
                                            "drift_flag", "retrained", "model_version")
    preds = panel.next_day_forecast(new_actuals.join(chosen.select("date", F.col("model_version").alias("_v")), "date"), F.col("_v"), noise, demand)
    return {"fva": fva.withColumn("model_version", version).select(*panel.FVA_COLS), "days": days, "predictions": preds}


def advance(new_actuals: DataFrame, prev_fva: DataFrame | None = None, prev_days: DataFrame | None = None,
            prev_preds: DataFrame | None = None, window_rows: int = 7, noise: float = 0.0) -> dict[str, DataFrame]:
    """Process a block of new dates on top of earlier state.

    ``prev_fva``: earlier comparison rows (only the last ``window_rows`` with an error are used), all dated before the
    block; ``prev_days``: earlier day rows (for the sim-day and retrain counters); ``prev_preds``: earlier
    forecasts (those targeting the new dates are used). Returns ``fva``, ``days`` and
    ``predictions`` for the new block."""
    fva0, chosen = decide(new_actuals, prev_fva, prev_days, prev_preds, window_rows, noise)
    return label(new_actuals, fva0, chosen, prev_preds, noise)


def backtest(actuals: DataFrame, window_rows: int = 7, noise: float = 0.0) -> dict[str, DataFrame]:
    """Every tick at once (``advance`` from an empty state)."""
    return advance(actuals, window_rows=window_rows, noise=noise)
