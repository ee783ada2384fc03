"""Structured Streaming (K1-K6).

K1  daily feed: a file source over per-date actuals files; the source checkpoint is the file
    pointer (each file is consumed exactly once, new files are picked up by the next trigger).
    A date may come in any number of files and over any number of micro-batches.
K2  tick: ``foreachBatch`` adds the micro-batch to the rows that wait (the inbox) and runs ``plans.backtest`` on the
    dates that are complete. With a manifest (date, rows) a date is complete once the inbox
    holds its rows and every earlier date of the manifest is complete too; without one, once a later
    date has been seen (``flush`` takes the rest at the end of the feed). Each commit writes all tables into folders
    of its own and becomes visible with its entry (``sources.snapshots``). A batch reads what the commit before it
    carried on: waiting rows, open forecasts, the drift window, and counters; never the feed so far.
    With ``fit``, a retrain decision fits a model on all committed rows, registers it with its error, and
    forecasts from the next day on are the model's.
K3  late rows: rows of a date that is not after the last committed one go to a ``late`` table.
K4  seen-URL dedup: ``dropDuplicatesWithinWatermark`` on the URL; ``streaming.seen`` never forgets one.
K5  page parsing as a stream: the same stateless extraction on a streaming DataFrame.
K6  streaming daily summary: one-day tumbling windows, every day emitted (complete mode; the state is one
    row a day) or, in append mode with a watermark, each day once it is closed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import RETRAIN_EVERY_N_DAYS
from ..operators import models, panel
from ..plans import backtest as bt
from ..session import checkpoint_dir
from ..sources.readers import read_if_any
from ..sources.snapshots import Snapshots
from ..sources.writers import salted

ACTUALS_STREAM_SCHEMA = T.StructType([
    T.StructField("entity_id", T.LongType()), T.StructField("date", T.DateType()),
    T.StructField("brand", T.StringType()), T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in panel.INDEX_COLS],
    *[T.StructField(c, T.StringType()) for c in ("event_type", "event_title", "event_description",
                                                  "impact_direction", "event_effect_hint", "priority",
                                                  "signal_story")]])


def daily_feed(spark: SparkSession, feed_dir: str, max_files_per_trigger: int | None = 1,
               fmt: str = "parquet") -> DataFrame:
    """K1: streaming DataFrame over the per-date actuals files in ``feed_dir``."""
    r = spark.readStream.schema(ACTUALS_STREAM_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        r = r.option("header", True)
    return r.load(feed_dir)


def _ready(pending: DataFrame, manifest: DataFrame | None, flush: bool) -> DataFrame:
    """Dates of ``pending`` (date, ...) that are complete; neither it nor the manifest holds committed dates."""
    if flush:
        return pending.select("date").distinct()
    if manifest is None:
        return pending.select("date").distinct().filter(F.col("date") < pending.agg(F.max("date")).scalar())
    here = pending.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    state = manifest.groupBy("date").agg(F.sum("rows").alias("rows")).join(here, "date", "left")
    open_ = state.filter(F.coalesce("n", F.lit(0)) < F.col("rows")).agg(F.min("date")).scalar()
    return state.filter(F.col("n") >= F.col("rows")).filter(open_.isNull() | (F.col("date") < open_)).select("date")


class Tick:
    """K2 + K3: the ``foreachBatch`` body over the state tables in ``state_dir`` (any URI).

    A batch that failed before its commit leaves nothing visible and is done again; a batch whose commit is there is
    skipped when Spark (or a caller) runs it again, so no model is fitted twice. A stream with a new checkpoint is a new
    run and starts from nothing. ``fit``: fits a model to training rows (``models.fit_demand_model``), None for the momentum
    forecast throughout; ``rule``: thresholds of ``backtest.decisions``; ``keep``: commits that readers may still ask for."""

    CARRIED = ("inbox", "tail", "predictions_open")

    def __init__(self, state_dir: str, manifest: str | None = None, window_rows: int = 7, noise: float = 0.0, fit=None,
                 keep: int | None = None, **rule):
        self.dir, self.manifest, self.window_rows, self.noise = state_dir.rstrip("/"), manifest, window_rows, noise
        self.fit, self.keep, self.rule = fit, keep, rule

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = Snapshots(spark, self.dir).entry()
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or (at.run if at else "direct")
        if at is not None and at.run != run:
            at = None                                              # another checkpoint: everything is done anew
        if at is not None and at.batch_id >= batch_id:
            if not at.done and at.batch_id == batch_id:            # it failed between two commits: its rows are in the inbox
                self.advance(spark, run, batch_id, at, None)
            return
        batch = batch.persist()
        try:
            self.advance(spark, run, batch_id, at, batch)
        finally:
            batch.unpersist()

    def flush(self, spark: SparkSession) -> None:
        """Commits every date that still waits, as a part of the last batch."""
        at = Snapshots(spark, self.dir).entry()
        if at is not None:
            self.advance(spark, at.run, at.batch_id, at, None, flush=True)

    def advance(self, spark: SparkSession, run: str, batch_id: int, at: Row | None, incoming: DataFrame | None, flush: bool = False) -> None:
        """One commit, or with ``fit`` one for each model that the complete dates ask for."""
        store = Snapshots(spark, self.dir)
        while True:
            seq = self._seq(store)
            waiting = store.written_by("inbox", at) if at else None
            pending, late = waiting, None
            if incoming is not None:
                last = F.lit(at.last_date if at else None).cast("date")
                late = incoming.filter(F.col("date") <= last)
                fresh = incoming.filter(F.coalesce(F.col("date") > last, F.lit(True)))
                pending = fresh if waiting is None else waiting.unionByName(fresh.select(*waiting.columns))
            if pending is None:
                return
            manifest = read_if_any(spark, self.manifest) if self.manifest else None
            if manifest is not None and at is not None and at.last_date is not None:
                manifest = manifest.filter(F.col("date") > F.lit(at.last_date))
            pending = pending.persist()
            try:
                ready = sorted(r.date for r in _ready(pending, manifest, flush).collect())        # dates
                if not ready and incoming is None:
                    return
                at = self._commit(store, run, seq, batch_id, at, pending, ready, late)
            finally:
                pending.unpersist()
            if self.keep:
                store.expire(self.keep, self.CARRIED)
            if at.done:
                return
            incoming = None

    @staticmethod
    def _seq(store: Snapshots) -> int:
        last = store.entry()
        return last.seq + 1 if last else 1

    def _commit(self, store: Snapshots, run: str, seq: int, batch_id: int, at: Row | None, pending: DataFrame, ready: list, late) -> Row:
        """Commits the ready dates, or those up to the first that asks for a new model."""
        spark, empty = store.spark, Row(last_date=None, sim_days=0, retrains=0, model=None)
        was = at or empty
        out, entry = {}, {"last_date": was.last_date, "sim_days": was.sim_days, "retrains": was.retrains, "model": was.model}
        until = ready[-1] if ready else None
        if ready:
            tail, open_ = (store.written_by(n, at) if at else None for n in ("tail", "predictions_open"))
            new = pending.filter(F.col("date") <= F.lit(until))
            made = None
            if self.fit:
                model = models.load_model(f"{self.dir}/models/run={run}", was.model) if was.model else None
                if model is not None:
                    new, made = models.score(new, model).withColumnRenamed("pred_demand", "_made"), F.col("_made")
            args = (tail, None, open_, self.window_rows, self.noise, made, (was.sim_days, was.retrains))
            fva0, chosen = bt.decide(new, *args, **self.rule)
            chosen = spark.createDataFrame(chosen.collect(), chosen.schema)                        # a row a date
            if self.fit:
                first = chosen.filter("retrained").agg(F.min("date")).first()[0]
                if first is not None and first < until:
                    until = first
                    keep = F.col("date") <= F.lit(until)
                    new, fva0, chosen = new.filter(keep), fva0.filter(keep), chosen.filter(keep)
            out = bt.label(new, fva0, chosen, open_, self.noise, made)
            plain = new.drop("_made")
            out["fva"] = store.write("fva", out["fva"], run, seq)
            errors = out["fva"].filter(F.col("abs_demand_error").isNotNull())
            if tail is not None:
                errors = errors.unionByName(tail.select(*errors.columns))
            out |= {"master": panel.to_master(plain), "daily": panel.daily_summary(plain), "explanations": panel.explanations(plain),
                    "alerts": panel.alerts(plain, self.noise),
                    "tail": errors.orderBy(F.col("date").desc(), F.col("entity_id").desc()).limit(self.window_rows),
                    # a forecast is for the day after its date: later ones than the last date are open
                    "predictions_open": out["predictions"].filter(F.col("target_date") > F.lit(until))}
            for name in out:
                if name != "fva":
                    out[name] = store.write(name, out[name], run, seq)
            entry |= {"last_date": until, "sim_days": was.sim_days + chosen.count(), "retrains": was.retrains + chosen.filter("retrained").count()}
            if self.fit:
                decided = chosen.filter("retrained").first()
                if decided is not None:
                    entry["model"] = self._retrain(store, run, seq, decided, entry["retrains"]) or was.model
        elif at is not None:                                       # nothing is complete: what is carried stays
            for name in ("tail", "predictions_open"):
                if (held := store.written_by(name, at)) is not None:
                    store.write(name, held, run, seq)
        rest = pending if until is None else pending.filter(F.col("date") > F.lit(until))
        store.write("inbox", rest, run, seq)
        if late is not None and not late.isEmpty():
            store.write("late", late, run, seq)
        row = Row(seq=seq, run=run, batch_id=batch_id, done=until is None or until == ready[-1], **entry)
        store.commit(row)
        return row

    def _retrain(self, store: Snapshots, run: str, seq: int, day: Row, number: int) -> str | None:
        """Fits a model on all rows up to the day, saves it by version and registers it with its in-sample error."""
        history = store.table("master", Row(seq=seq, run=run))
        train = models.training_set(history).persist()
        try:
            model = self.fit(train)
            if model is None:
                return None
            err = models.training_mae(model.transform(train)).first()
        finally:
            train.unpersist()
        models.save_model(model, f"{self.dir}/models/run={run}", day.model_version)
        reason = "periodic" if day.sim_day > 0 and day.sim_day % self.rule.get("every", RETRAIN_EVERY_N_DAYS) == 0 else "drift"
        row = models.registry_row(store.spark, day.model_version, number, err.rows_seen, err.training_mae, reason)
        store.write("registry", row.withColumn("date", F.lit(day.date)), run, seq)
        return day.model_version


def run_tick_stream(spark: SparkSession, feed_dir: str, state_dir: str, checkpoint: str | None = None,
                    max_files_per_trigger: int | None = 1, window_rows: int = 7, manifest: str | None = None, **tick_args) -> None:
    """K1 -> K2 with ``Trigger.AvailableNow``: process every file present, then stop. Without a manifest the
    feed is taken as ended, and the dates still open are committed."""
    ck = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/tick-{uuid.uuid4().hex}"
    tick = Tick(state_dir, manifest, window_rows, **tick_args)
    q = (daily_feed(spark, feed_dir, max_files_per_trigger).writeStream.foreachBatch(tick)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    if manifest is None:
        tick.flush(spark)


def seen_url_dedup(stream: DataFrame, url_col: str = "url", ts_col: str = "ts", delay: str = "1 day") -> DataFrame:
    """K4: first sighting of each URL within the watermark delay; state is bounded by the delay."""
    return stream.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark([url_col])


def page_stream(spark: SparkSession, pages_dir: str) -> DataFrame:
    """K5: parsed pages as a stream (stateless: extraction + typing on each micro-batch)."""
    from ..plans.scrape import pages_with_hints, parse_pages
    return parse_pages(pages_with_hints(_pages(spark, pages_dir)))


def typed_page_stream(spark: SparkSession, pages_dir: str) -> DataFrame:
    """K5 where only the page type is asked for: Columns alone, no extraction."""
    from ..plans.scrape import pages_with_hints
    return pages_with_hints(_pages(spark, pages_dir)).select("page_id", "url", "page_type_hint")


def _pages(spark: SparkSession, pages_dir: str) -> DataFrame:
    return spark.readStream.schema("page_id long, url string, html string").parquet(pages_dir)


def daily_event_summary(events: DataFrame, delay: str | None = None) -> DataFrame:
    """K6: per UTC day: events, purchases and value (cents) in one-day tumbling windows. With a ``delay`` a
    watermark closes a day that long after its end (append mode emits it then, and later rows are dropped);
    without one no row is ever late (complete mode: ``run_to_latest``)."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))      # event time must be TIMESTAMP (session zone UTC)
    if delay is not None:
        events = events.withWatermark("ts", delay)
    return (events.groupBy(F.window("ts", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("events"),
                 F.count_if(F.col("event_type") == "purchase").alias("purchases"),
                 F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("value_cents"))
            .select(F.to_date(F.col("w.start")).alias("date"), "events", "purchases", "value_cents"))


def run_to_latest(df: DataFrame, path: str | None = None) -> DataFrame:
    """Drive a streaming aggregate to completion in complete mode: every batch writes the whole result under its
    own id (a retried batch replaces its own), and the last one is returned."""
    spark = df.sparkSession
    base = path or f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/batch_id={batch_id}")

    q = (df.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{base}/_ck")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    done = read_if_any(spark, f"{base}/data")
    if done is None:
        return spark.createDataFrame([], df.schema)
    return done.join(done.agg(F.max("batch_id").alias("batch_id")), "batch_id", "left_semi").select(*df.columns)


def run_to_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Drive a streaming DataFrame to completion (``Trigger.AvailableNow``) into a parquet file sink
    in the shared checkpoint folder and return it as a batch table. The file sink is exactly-once
    (its own commit log) and nothing is collected on the driver."""
    spark = df.sparkSession
    base = path or f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = (df.writeStream.format("parquet").option("path", f"{base}/data").outputMode("append")
         .option("checkpointLocation", f"{base}/_ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/data")


def write_feed(actuals: DataFrame, feed_dir: str, files_per_date: int | None = None, manifest: str | None = None) -> None:
    """Split a panel into files per date (the shape of the daily feed); ``manifest`` gets the rows of each date."""
    rows = actuals.select(*[f.name for f in ACTUALS_STREAM_SCHEMA.fields])
    salted(rows, "date", files_per_date).write.mode("overwrite").partitionBy("date").parquet(feed_dir)
    if manifest:
        rows.groupBy("date").agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(manifest)
