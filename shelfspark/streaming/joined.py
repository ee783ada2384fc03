"""C1 as a stream-stream join: each day's actuals against the forecasts made for it the day before.

Both sides are streams with a watermark, joined on entity and day. The day is the event time of both sides, so that the
watermark bounds what either keeps: a row waits until the watermark passes its day, and the state is that of the last
``delay`` and the days not yet closed, however long the feed. An actual that met no forecast by then is emitted without
one (left outer). Rows that come later than ``delay`` after the newest day are dropped, as everywhere with watermarks.

Cases: null errors where a value is null; an actual without an entity meets no forecast; the panel is unique on entity and
day, repeated rows would each be joined; an empty feed gives no rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import panel


def forecast_stream(actuals: DataFrame) -> DataFrame:
    """The forecasts that a stream of actuals gives rise to: one row for the next day of each (stateless)."""
    return panel.next_day_forecast(actuals)


def join_forecasts(actuals: DataFrame, forecasts: DataFrame, delay: str = "3 days") -> DataFrame:
    """Comparison rows (those of ``panel.forecast_vs_actual`` without the model version, which the tick decides)."""
    a = actuals.withColumn("_day", F.col("date").cast("timestamp")).withWatermark("_day", delay)
    p = (forecasts.select(F.col("entity_id").alias("_entity"), F.col("target_date").cast("timestamp").alias("_target"), "pred_demand", "pred_price")
         .withWatermark("_target", delay))
    j = a.join(p, (F.col("entity_id") == F.col("_entity")) & (F.col("_day") == F.col("_target")), "left")
    d_err, p_err = F.col("demand_index") - F.col("pred_demand"), F.col("price_index") - F.col("pred_price")
    return j.select("date", "entity_id", "pred_demand", F.col("demand_index").alias("actual_demand"), d_err.alias("demand_error"),
                    F.abs(d_err).alias("abs_demand_error"), "pred_price", F.col("price_index").alias("actual_price"),
                    p_err.alias("price_error"), F.abs(p_err).alias("abs_price_error"),
                    F.coalesce("event_type", F.lit("")).alias("event_type"), F.coalesce("event_effect_hint", F.lit("")).alias("event_effect_hint"))


def write_ordered_feed(actuals: DataFrame, feed_dir: str, columns: list[str], days_at_once: int, files: int, close_after: int) -> None:
    """A feed whose files appear in the order of their days, ``files`` for some days at a time; last a row of a
    made-up entity, so many days on, which closes the days before it, and one more, whose batch sees them closed. (A row without
    an entity would not do: the join's null filter on the forecasts' side goes before the watermark.)"""
    days = sorted(r.date for r in actuals.select("date").distinct().collect())            # one row a day
    rows = actuals.select(*columns)
    for i in range(0, len(days), days_at_once):
        part = rows.filter(F.col("date").between(days[i], days[min(i + days_at_once, len(days)) - 1]))
        part.repartition(files).write.mode("append").parquet(feed_dir)
    for nobody, after in ((-1, close_after), (-2, close_after + 1)) if days else ():
        last = {"date": F.lit(days[-1] + timedelta(days=after)), "entity_id": F.lit(nobody).cast("long")}
        end = rows.limit(1).select(*[last.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema.fields])
        end.repartition(files).write.mode("append").parquet(feed_dir)
